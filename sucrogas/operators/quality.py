"""Data-quality rules as issue rows; referential and duplicate checks; exclusion closure; totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sucrogas.session import ensure_checkpoint_dir


def issues(df: DataFrame, file: str, row: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row per broken rule: ``rules`` are (level, condition that must not hold, message).

    All rules are evaluated in one pass over the table: broken ones are gathered in an array per row and exploded.
    """
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(level).alias("level"), message.alias("message"))) for level, bad, message in rules]))
    return df.select(F.lit(file).alias("file"), F.col(row).cast("string").alias("row"), F.explode(found).alias("_i")).select("file", "row", "_i.level", "_i.message")


def parameter_rules() -> list[tuple[str, Column, Column]]:
    """Rules of a parameter registry: identifiers, flags, units, order of the values, numbers, evidence, dates."""
    c = F.col
    lo, ce, hi = c("low").try_cast("double"), c("central").try_cast("double"), c("high").try_cast("double")
    return [
        ("error", c("id").isNull() | (F.trim("id") == ""), F.lit("id is missing")),
        ("error", ~c("confidence").isin("V", "S", "K", "D"), F.concat(F.lit("unknown confidence flag "), F.coalesce("confidence", F.lit("")))),
        ("error", c("confidence").isNull(), F.lit("confidence is missing")),
        ("error", c("unit").isNull() | (F.trim("unit") == ""), F.lit("unit is missing")),
        ("error", (lo > ce) | (ce > hi) | (lo > hi), F.lit("low, central and high are not in order")),
        ("warning", c("central").isNotNull() & ce.isNull(), F.lit("central is no plain number")),
        ("error", (c("confidence") == "V") & (c("page").isNull() | c("quote").isNull()), F.lit("verified without page and quote")),
        ("error", c("verified_on").isNotNull() & ~c("verified_on").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("verified_on is no date")),
    ]


def duplicates(df: DataFrame, key: str, line: str) -> DataFrame:
    """Rows whose key occurs again, with the first line that has it."""
    w = Window.partitionBy(key)
    return df.select(key, line, F.count("*").over(w).alias("n"), F.min(line).over(w).alias("first_line")).where("n > 1")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def conflicts(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose values differ by more than a share of the largest."""
    g = df.groupBy(*keys).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count("*").alias("n"))
    return g.where(F.try_divide(F.col("highest") - F.col("lowest"), F.col("highest")) > tolerance)


def two_domains(df: DataFrame, key: str, domain: str) -> DataFrame:
    """Keys with fewer than two distinct domains."""
    return df.groupBy(key).agg(F.count_distinct(domain).alias("domains")).where("domains < 2")


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Two-way counts with totals; a missing label is "missing", the totals are "total"."""
    labelled = df.select(F.coalesce(F.col(row).cast("string"), F.lit("missing")).alias("_r"), F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("_c"))
    return labelled.cube("_r", "_c").agg(F.count("*").alias("n")).select(F.coalesce("_r", F.lit("total")).alias("row_label"), F.coalesce("_c", F.lit("total")).alias("column_label"), "n")


def closure(edges: DataFrame, start: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Everything that depends on the start nodes, directly or not, with the least number of steps.

    ``edges``: ``node``, ``depends_on``; ``start``: ``node``.  Each round joins only the nodes found last; the frontier and the
    result are checkpointed, cycles end by themselves.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    found = start.select("node").distinct().withColumn("steps", F.lit(0)).checkpoint()
    last = found
    for step in range(1, most_rounds + 1):
        new = edges.join(last.select(F.col("node").alias("depends_on")), "depends_on").select("node").distinct().join(found, "node", "left_anti").withColumn("steps", F.lit(step)).checkpoint()
        if new.isEmpty():
            return found
        found, last = found.unionByName(new).checkpoint(), new
    raise RuntimeError("the closure is deeper than most_rounds")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns missing from a frame are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def against_totals(rows: DataFrame, keys: list[str], value: str, totals: DataFrame, total: str, tolerance: float) -> DataFrame:
    """Sums of a table against its printed totals: keys, ``n`` rows, ``sum``, the printed total, ``difference`` and ``ok``; keys on one side only are not ok."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))
    j = g.join(totals.select(*keys, F.col(total).alias("printed")), keys, "full_outer")
    d = F.col("sum") - F.col("printed")
    return j.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "sum", "printed", d.alias("difference"), F.coalesce(F.abs(d) <= tolerance, F.lit(False)).alias("ok"))
