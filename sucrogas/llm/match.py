"""Matching entities of two tables without a common key: sorted neighbourhood, weighted similarities, assignment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sucrogas.functions.names import assignment
from sucrogas.session import ensure_checkpoint_dir

#: Distinct neighbouring sort keys that are compared on either side.
WINDOW = 2


def slots(keys: DataFrame, key: str = "key") -> DataFrame:
    """The distinct sort keys numbered in global order.

    Keys are range partitioned and sorted within partitions; the number of a key is its place in its
    partition plus the sizes of the partitions before.  Only one count per partition reaches the
    driver.  The sorted keys are checkpointed first, so a lost executor cannot change the boundaries.
    """
    ensure_checkpoint_dir(keys.sparkSession)
    ordered = keys.where(F.col(key).isNotNull()).select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    placed = ordered.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offset, rows = 0, []
    for p, n in sizes:
        rows.append((p, offset))
        offset += n
    offsets = keys.sparkSession.createDataFrame(rows, "_p long, _offset long")
    return placed.select(key, part.alias("_p"), place.alias("_place")).join(offsets, "_p").select(key, (F.col("_offset") + F.col("_place")).alias("slot"))


def sorted_neighbourhood(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list[tuple[str, Column, Column]], window: int = WINDOW) -> DataFrame:
    """Candidate pairs that are neighbours in the order of at least one composite sort key.

    ``passes``: name, key expression over ``left``, key expression over ``right``.  The window slides over distinct
    keys, not rows, so records with equal keys are never separated by their number.  A record on
    the left meets the records on the right whose key lies at most ``window`` distinct keys away.
    Returns distinct (left_id, right_id).
    """
    found = None
    for _, lk, rk in passes:
        a = left.select(F.col(left_id).alias("_l"), lk.alias("key")).where(F.col("key").isNotNull()).distinct()
        b = right.select(F.col(right_id).alias("_r"), rk.alias("key")).where(F.col("key").isNotNull()).distinct()
        order = slots(a.select("key").unionByName(b.select("key")))
        reach = F.explode(F.sequence(F.col("slot") - window, F.col("slot") + window)).alias("slot")
        pairs = a.join(order, "key").select("_l", reach).join(b.join(order, "key").select("_r", "slot"), "slot").select("_l", "_r")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct().select(F.col("_l").alias(left_id), F.col("_r").alias(right_id))


#: Weights of the field similarities.
WEIGHTS = {"name": 0.45, "place": 0.33, "state": 0.08, "capacity": 0.14}


def confidence(similarities: dict[str, Column]) -> Column:
    """Weighted mean of the stated (not NULL) field similarities."""
    num = den = F.lit(0.0)
    for f, w in WEIGHTS.items():
        s = similarities[f]
        num = num + F.coalesce(s, F.lit(0.0)) * w
        den = den + F.when(s.isNotNull(), F.lit(w)).otherwise(0.0)
    return num / den


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Field similarities and confidence of candidate pairs.

    Needs ``company_a``/``company_b`` (classes of names), ``place_a``/``place_b``, ``uf_a``/``uf_b``,
    ``cap_a`` (double) and ``caps_b`` (array of capacities the plant has had).  A NULL field is left
    out of the mean.
    """
    closest = F.array_min(F.transform("caps_b", lambda c: F.abs(F.log(F.col("cap_a") / c))))
    both = lambda c: F.when(F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull(), (F.col(f"{c}_a") == F.col(f"{c}_b")).cast("double"))
    s = {
        "name": both("company"),
        "place": both("place"),
        "state": both("uf"),
        "capacity": F.when((F.col("cap_a") > 0) & (F.size("caps_b") > 0), F.exp(-closest)),
    }
    return pairs.select("*", *[v.alias(f"s_{k}") for k, v in s.items()]).withColumn("confidence", confidence({k: F.col(f"s_{k}") for k in s}))


def best_match(scored: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """For each left record the right record of highest confidence (ties: smaller right id): the
    assignment of highest total confidence where a right record may take several left ones."""
    best = scored.groupBy(left_id).agg(F.max_by(F.struct(right_id, "confidence"), F.struct("confidence", F.hash(right_id), right_id)).alias("_b"))
    return best.select(left_id, F.col(f"_b.{right_id}").alias(right_id), F.col("_b.confidence").alias("confidence"))


def one_to_one(scored: DataFrame, left_id: str, right_id: str, block: str) -> DataFrame:
    """One-to-one assignment of highest total confidence within blocks: left id, right id, ``confidence``.

    ``block`` names a column that no match crosses (e.g. company and place); a block is solved exactly by
    the Hungarian algorithm and is as large as one company's plants in one place, so its pairs are read as one array.
    Pairs that are no candidates cannot be assigned; of several rows of a pair the highest confidence counts; a NULL block is a block.
    """
    best = scored.groupBy(block, left_id, right_id).agg(F.max("confidence").alias("confidence"))
    blocks = best.groupBy(block).agg(F.collect_list(F.struct(F.col(left_id).alias("l"), F.col(right_id).alias("r"), F.col("confidence").alias("c"))).alias("_p")).select("_p")

    def solve(pairs: list) -> list[tuple]:
        if len(pairs) == 1:
            return [(pairs[0]["l"], pairs[0]["r"], pairs[0]["c"])]
        left, right = sorted({p["l"] for p in pairs}), sorted({p["r"] for p in pairs})
        flip = len(left) > len(right)
        rows, cols = (right, left) if flip else (left, right)
        at, to = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
        cost = [[2.0] * len(cols) for _ in rows]
        for p in pairs:
            r, k = (p["r"], p["l"]) if flip else (p["l"], p["r"])
            cost[at[r]][to[k]] = 1 - p["c"]
        got = [(rows[i], cols[j], 1 - cost[i][j]) for i, j in enumerate(assignment(cost)) if j >= 0 and cost[i][j] <= 1]
        return [(y, x, c) if flip else (x, y, c) for x, y, c in got]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([t for pairs in b["_p"] for t in solve(list(pairs))], columns=[left_id, right_id, "confidence"]).astype({"confidence": float})

    kinds = dict(scored.dtypes)
    return blocks.mapInPandas(run, f"{left_id} {kinds[left_id]}, {right_id} {kinds[right_id]}, confidence double")
