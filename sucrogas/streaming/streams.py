"""Structured Streaming forms: weekly windows, event spacing, versions and snapshots as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sucrogas.operators.history import scd2_merge


def weekly_means(stream: DataFrame, key: str, time: str, value: str, late: str = "14 days") -> DataFrame:
    """Means per key and calendar week (from Monday) with a watermark: weeks are emitted once they can no longer change."""
    week = F.window(time, "7 days", "7 days", "4 days")  # the epoch was a Thursday
    return stream.withWatermark(time, late).groupBy(key, week.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.date_add(F.col("w.start").cast("date"), 6).alias("week_end"), "n", "mean")


def spaced_events(stream: DataFrame, key: str, time: str, min_days: int) -> DataFrame:
    """Events at least ``min_days`` whole days after the last accepted one of their key; state is one timestamp per key.

    Events of a key are expected in order between triggers; within a trigger they are sorted.
    """
    kinds = dict(stream.dtypes)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        rows = pd.concat(list(frames)).sort_values(time)
        kept = []
        for t in rows[time]:
            if last is None or (t - last).days >= min_days:
                kept.append(t)
                last = t
        if last is not None:
            state.update((int(last.value // 1000),))
        yield pd.DataFrame({key: [k[0]] * len(kept), time: kept})

    return stream.select(key, time).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} timestamp", "last long", "append", GroupStateTimeout.NoTimeout)


def merge_each(stream: DataFrame, path: str, key: str, attributes: list[str], date: str, checkpoint: str) -> Callable:
    """A started query that merges every micro-batch into a type-two dimension stored at ``path`` (two alternating folders).

    The dimension of batch n is written to ``path/n`` from ``path/n-1``, so a batch that is run again after a failure gives the same result.
    """
    spark = stream.sparkSession
    schema = ", ".join(f"{c} {t}" for c, t in stream.dtypes if c in (key, *attributes)) + ", valid_from date, valid_to date, attr_hash long"

    def batch(df: DataFrame, n: int) -> None:
        empty = spark.createDataFrame([], schema)
        current = spark.read.parquet(f"{path}/{n - 1}") if n else empty.select(key, *attributes, "valid_from", "valid_to", "attr_hash")
        scd2_merge(current, df, key, attributes, date).write.mode("overwrite").parquet(f"{path}/{n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
