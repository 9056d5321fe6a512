"""Queries that read tables through the registry and exchange readers, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.session import table
from sucrogas.sources import files, registry_files

MONTHLY = "anp_monthly_sp_plants_from_pilar2b"
PROJECTS = "projects_capex_proposed_r07"


def parameter_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter table as text with its typed twins."""
    raw = table(spark, sf_dir, "parameters").select(*registry_files.PARAMETER_COLUMNS).distinct()
    return registry_files.typed_twins(raw).select("id", "unit", "raw_central", "central", "raw_low", "low", "raw_high", "high")


def thousands_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investments written with commas between thousands come back as numbers."""
    p = table(spark, sf_dir, PROJECTS).select("id", F.format_number("investment_total_brl_m", 3).alias("total"), F.concat(F.format_number("bndes_brl_m", 2), F.when(F.col("id") % 5 == 0, " ca").otherwise("")).alias("loan")).distinct()
    return registry_files.without_thousands(p, ["total", "loan", "other"])


def degree_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates as text, some out of range, some no numbers."""
    m = table(spark, sf_dir, "municipalities")
    raw = m.select("ibge_code", F.when(F.length("municipio") % 7 == 0, "n/d").otherwise(F.col("lat").cast("string")).alias("y"), (F.col("lon") * F.when(F.length("municipio") % 5 == 0, 4).otherwise(1)).cast("string").alias("x"))
    return registry_files.points(raw, "y", "x")


def candidate_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipalities as further candidates, checked as a whole."""
    m = table(spark, sf_dir, "municipalities")
    return registry_files.extra_candidates(m.select(F.col("ibge_code").alias("id"), F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"), F.when(F.col("uf") == "SP", "state").alias("kind"), F.col("municipio").alias("name")))


def exchange_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of parts from an exchange table."""
    p = table(spark, sf_dir, "part")
    raw = p.select("p_partkey", F.round(F.col("p_size") / 50, 6).cast("string").alias("n_size"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise("0.5").alias("n_blank"), F.when(F.col("p_partkey") % 9 == 0, "True").when(F.col("p_partkey") % 10 == 0, "1").alias("excluded"))
    return registry_files.criteria(raw, "p_partkey")


def plant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of the plant with the smallest id."""
    m = table(spark, sf_dir, MONTHLY).select("plant_id", "date", "vol_biogas_m3d", "cap_biogas_m3d", "util_pct").distinct()
    plant = m.agg(F.min("plant_id")).first()[0]
    return registry_files.plant_series(m, plant, "plant_id", "date", ["vol_biogas_m3d", "cap_biogas_m3d", "util_pct"])


def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables as they would stand in a manifest; a table hashes to the same whatever its order."""
    rows = []
    for name in ("nation", "region", "supplier", "customer"):
        df = table(spark, sf_dir, name)
        n, digest = files.content_hash(df)
        rows.append((name, n, digest == files.content_hash(df.repartition(3))[1], len(files.canonical_hash({"n": n})) == 16))
    return spark.createDataFrame(rows, "name string, n long, same_in_any_order boolean, has_id boolean")


QUERIES = {f.__name__: f for f in (parameter_twins, thousands_commas, degree_points, candidate_sites, exchange_criteria, plant_series, table_fingerprints)}
_T = lambda c: f"coalesce(trim({c}), '') AS raw_{c}, try_cast(CASE WHEN regexp_matches(trim({c}), '^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$') THEN trim({c}) END AS DOUBLE) AS {c}"
SQL = {
    "parameter_twins": f"SELECT id, coalesce(trim(unit), '') AS unit, {_T('central')}, {_T('low')}, {_T('high')} FROM (SELECT DISTINCT id, module, parameter, central, low, high, unit, source, confidence, notes, page, quote FROM parameters)",
    "thousands_commas": f"SELECT DISTINCT id, round(investment_total_brl_m, 3) AS total, CASE WHEN id % 5 <> 0 THEN round(bndes_brl_m, 2) END AS loan FROM {PROJECTS}",
    "degree_points": "SELECT ibge_code, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN x END AS lon FROM (SELECT *, length(municipio) % 7 <> 0 AND x BETWEEN -180 AND 180 AS ok FROM (SELECT ibge_code, municipio, lat, lon * CASE WHEN length(municipio) % 5 = 0 THEN 4 ELSE 1 END AS x FROM municipalities))",
    "candidate_sites": "SELECT ibge_code AS id, CASE WHEN uf = 'SP' THEN 'state' ELSE 'extra' END AS kind, municipio AS name, '' AS code, lat, lon FROM municipalities",
    "exchange_criteria": "WITH p AS (SELECT p_partkey, coalesce(p_partkey % 9 = 0 OR p_partkey % 10 = 0, false) AS excluded, round(p_size / 50e0, 6) AS s FROM part) SELECT p_partkey, excluded, 'size' AS criterion, s AS value FROM p UNION ALL SELECT p_partkey, excluded, 'blank', CASE WHEN p_partkey % 4 <> 0 THEN 0.5e0 END FROM p",
    "plant_series": f"SELECT DISTINCT strftime(date, '%Y-%m') AS month, vol_biogas_m3d, cap_biogas_m3d, util_pct FROM {MONTHLY} WHERE plant_id = (SELECT min(plant_id) FROM {MONTHLY})",
    "table_fingerprints": "SELECT 'nation' AS name, count(*) AS n, true AS same_in_any_order, true AS has_id FROM nation UNION ALL SELECT 'region', count(*), true, true FROM region UNION ALL SELECT 'supplier', count(*), true, true FROM supplier UNION ALL SELECT 'customer', count(*), true, true FROM customer",
}
