"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str, payload: list[str]) -> DataFrame:
    """One row per key: the one with the latest ``version``.

    The choice is an aggregate, so copies of a hot key are combined before the shuffle.
    Rows with equal ``version`` are told apart by their payload (largest wins), which makes
    the result the same on every run; a NULL version counts as the earliest.  Rows with a
    NULL key are left out.
    """
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    best = present.groupBy(*keys).agg(F.max(F.struct(version, *payload)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[p].alias(p) for p in payload])


def snapshot_calendar(df: DataFrame, snapshot: str) -> DataFrame:
    """The distinct snapshot dates numbered from 1; as many rows as there are snapshots."""
    dates = df.where(F.col(snapshot).isNotNull()).select(snapshot).distinct()
    return dates.select(snapshot, F.row_number().over(Window.orderBy(snapshot)).alias("_no"))


def validity_intervals(rows: DataFrame, key: str, number: str, values: list[str]) -> DataFrame:
    """Gaps and islands: the maximal runs of consecutive snapshots in which a key's row hash stays.

    ``rows`` has one row per key and snapshot number.  Returns key, ``from_no``, ``to_no`` and
    the values of the run.  The hash covers NULL as a value of its own.
    """
    order = Window.partitionBy(key).orderBy(number)
    hashed = rows.withColumn("_hash", F.xxhash64(*[F.coalesce(F.col(v).cast("string"), F.lit("\0")) for v in values]))
    opens = (F.lag(number).over(order).isNull()) | (F.lag(number).over(order) != F.col(number) - 1) | (F.lag("_hash").over(order) != F.col("_hash"))
    islands = hashed.withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(order))
    return islands.groupBy(key, "_island").agg(F.min(number).alias("from_no"), F.max(number).alias("to_no"), *[F.first(v).alias(v) for v in values]).drop("_island")


def snapshot_changes(df: DataFrame, snapshot: str, key: Column, value: str, version: str, tolerance: float) -> DataFrame:
    """Records added, removed or changed between each snapshot and the one before.

    Per snapshot and key the row with the latest ``version`` counts.  Validity intervals of
    equal rows are built by gaps and islands; their starts, ends and adjacencies become the
    events ``added``, ``removed`` and ``changed``.  ``changed`` needs both values stated and
    further apart than ``tolerance``.  The first snapshot yields nothing; a key that returns is
    added again; rows with a NULL key or snapshot are ignored (a snapshot counts even if all
    its keys are NULL); an empty table gives an empty result.

    Returns ``snapshot_no``, the snapshot date (named as in the input), ``key``, ``change``,
    ``value_before``, ``value_after``.
    """
    keyed = df.select(F.col(snapshot), key.alias("_key"), F.col(value).alias("_value"), F.col(version).alias("_version"))
    calendar = snapshot_calendar(df, snapshot)
    valid = latest(keyed, [snapshot, "_key"], "_version", ["_value"]).join(calendar, snapshot)
    runs = validity_intervals(valid.select("_key", "_no", "_value"), "_key", "_no", ["_value"])
    order = Window.partitionBy("_key").orderBy("from_no")
    seen = runs.select(
        "*",
        F.lag("to_no").over(order).alias("_before_no"),
        F.lag("_value").over(order).alias("_before"),
        F.lead("from_no").over(order).alias("_next_no"),
    )
    adjacent = F.col("_before_no") == F.col("from_no") - 1
    event = lambda when, no, kind, a, b: F.when(when, F.struct(no.alias("no"), F.lit(kind).alias("change"), a.cast("double").alias("a"), b.cast("double").alias("b")))
    null = F.lit(None)
    events = F.array_compact(
        F.array(
            event((F.col("from_no") > 1) & ~F.coalesce(adjacent, F.lit(False)), F.col("from_no"), "added", null, F.col("_value")),
            event(adjacent & (F.abs(F.col("_value") - F.col("_before")) > tolerance), F.col("from_no"), "changed", F.col("_before"), F.col("_value")),
            event(F.col("_next_no").isNull() | (F.col("_next_no") > F.col("to_no") + 1), F.col("to_no") + 1, "removed", F.col("_value"), null),
        )
    )
    out = seen.select("_key", F.explode(events).alias("_e")).select(F.col("_key").alias("key"), F.col("_e.no").alias("_no"), F.col("_e.change").alias("change"), F.col("_e.a").alias("value_before"), F.col("_e.b").alias("value_after"))
    # An end at the last snapshot has no later snapshot to join and is no event.
    return out.join(calendar, "_no").select(F.col("_no").alias("snapshot_no"), snapshot, "key", "change", "value_before", "value_after")
