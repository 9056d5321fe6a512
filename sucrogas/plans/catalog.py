"""All registered queries of the core with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sucrogas.plans import calibration, chain, exchange, extras, jobs, loading, more, places, problems, registry, reports, screening, validation

_MODULES = (chain, places, calibration, registry, loading, extras, jobs, exchange, more, screening, validation, reports, problems)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that ``entry`` runs."""
    return chain.mass_balance(spark, sf_dir)
