"""Queries of the subpackage's problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.llm.mixing import mix, mix_report
from sucrogas.llm.names_link import name_classes, variant_pairs
from sucrogas.llm.packing import pack, packing_report
from sucrogas.llm.projects import match_projects
from sucrogas.llm.splitting import split_documents
from sucrogas.llm.titles import gazetteer
from sucrogas.llm.tokens import with_token_counts
from sucrogas.session import ensure_checkpoint_dir, table

MONTHLY = "anp_monthly_sp_plants_from_pilar2b"
SNAPSHOTS = "anp_biomethane_plants_latest_from_pilar2b"
PROJECTS = "projects_capex_proposed_r07"
MAX_LIMITS = 100


def company_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Company names of both plant tables, and project titles."""
    names = table(spark, sf_dir, SNAPSHOTS).select(F.col("razao_social").alias("name")).unionByName(table(spark, sf_dir, MONTHLY).select(F.col("operator").alias("name")))
    return names, table(spark, sf_dir, PROJECTS).select(F.col("project").alias("name"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different strings that name one company."""
    return variant_pairs(company_classes(spark, sf_dir))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string with the class of the company it names (one row for each company, if it names several)."""
    return company_classes(spark, sf_dir)


def company_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of all company names and project titles."""
    names, titles = company_names(spark, sf_dir)
    return name_classes(names, titles, gazetteer(table(spark, sf_dir, "municipalities"), "municipio"))


def p4_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project rows with the plant they are about and the confidence of the match."""
    return match_projects(table(spark, sf_dir, PROJECTS), table(spark, sf_dir, SNAPSHOTS), company_classes(spark, sf_dir), table(spark, sf_dir, "municipalities"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of ``p4_confidence`` without their confidence."""
    return p4_confidence(spark, sf_dir).select("id", "cnpj")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their token counts; kept, because packing and mixing read them more than once."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull())
    return with_token_counts(docs.select("doc_id", "source", "text"), "text").select("doc_id", "source", "tokens").checkpoint()


def limits(spark: SparkSession, sf_dir: str, purpose: str) -> list[tuple[str, int, int]]:
    """The limits of one purpose: a handful of rows of a fixed table, each of which costs a pass; more than ``MAX_LIMITS`` are refused."""
    rows = table(spark, sf_dir, "token_limits").where(F.col("purpose") == purpose).select("limit_id", "capacity_tokens", "overlap_tokens").orderBy("limit_id").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits for {purpose}")
    return [(r[0], int(r[1]), int(r[2] or 0)) for r in rows]


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container under each pack limit."""
    return packed(spark, sf_dir)[0]


def packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """The packing of ``p7_pack`` with its plans."""
    return pack(token_counts(spark, sf_dir), "doc_id", "tokens", [(n, c) for n, c, _ in limits(spark, sf_dir, "pack")])


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and fill of each pack limit."""
    return packing_report(*packed(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of every mix in schedule order."""
    return mix(token_counts(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of every source in every mix."""
    return mix_report(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pieces of every document above a split limit."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return split_documents(docs, "doc_id", "text", limits(spark, sf_dir, "split"))


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, tokens and kinds of cuts per split limit."""
    levels = ["token", "word", "clause", "sentence", "line", "paragraph"]
    pieces = p9_split(spark, sf_dir)
    return pieces.groupBy("limit_id").agg(
        F.count_distinct("doc_id").alias("documents"), F.count("*").alias("pieces"), F.max("tokens").alias("most_tokens"), F.avg("tokens").alias("mean_tokens"),
        *[F.sum((F.col("cut_level") == i).cast("long")).alias(f"cuts_at_{n}") for i, n in enumerate(levels)],
    )


QUERIES = {
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p4_confidence": p4_confidence,
    "p7_pack": p7_pack,
    "p7_report": p7_report,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_split": p9_split,
    "p9_report": p9_report,
}
SQL: dict[str, str] = {}
