"""Ranks and running sums inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sucrogas.session import ensure_checkpoint_dir


#: Rows that one task ranks; the number of buckets follows from it.
ROWS_PER_BUCKET = 250_000


def buckets_for(rows: int) -> int:
    """Buckets for ``spread_rank`` so that even if all rows are in one group a bucket holds about ``ROWS_PER_BUCKET``."""
    return max(8, -(-rows // ROWS_PER_BUCKET))


def spread_rank(df: DataFrame, group: list[str], order: Column, buckets: int, rank: str = "rank", weight: str | None = None, before: str = "before") -> DataFrame:
    """A rank from 0 (and the running sum of ``weight`` before each row) inside every group.

    ``order`` must be a uniformly spread, unique long (a hash with a tie-break makes a shuffled order).
    Its value range is cut into ``buckets`` ranges; each (group, bucket) is ranked by itself and lifted
    by the totals of the buckets before it.  A group that holds a third of all rows is thus worked
    on by as many tasks as there are buckets; only one row per (group, bucket) is ordered as a whole.
    Equal ``order`` values are told apart arbitrarily, so make it unique.  Rows with a NULL group form a group.
    """
    width = F.lit(2.0**64 / buckets)
    placed = df.withColumn("_o", order).withColumn("_b", F.least(F.floor((F.col("_o").cast("double") + 2.0**63) / width), F.lit(buckets - 1)).cast("int"))
    w = F.col(weight).cast("long") if weight else F.lit(0).cast("long")
    sizes = placed.groupBy(*group, "_b").agg(F.count("*").alias("_n"), F.sum(w).alias("_w"))
    # At most groups x buckets rows.
    ordered = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    lifts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_lb"), F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_ln"), F.coalesce(F.sum("_w").over(ordered), F.lit(0)).alias("_lw"))
    match = F.col("_b") == F.col("_lb")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_b").orderBy("_o")
    local = placed.withColumn("_r", F.row_number().over(inside) - 1)
    if weight:
        local = local.withColumn("_s", F.coalesce(F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lifted = local.join(lifts, match).withColumn(rank, F.col("_ln") + F.col("_r"))
    if weight:
        lifted = lifted.withColumn(before, F.col("_lw") + F.col("_s"))
    return lifted.drop("_o", "_b", "_r", "_s", "_lb", "_ln", "_lw", *[f"_g{i}" for i in range(len(group))])


def running_before(df: DataFrame, group: list[str], order: list[Column], weights: list[str]) -> DataFrame:
    """Adds ``before_<w>``: the sum of each weight over the rows of the group that come earlier in the order.

    The rows are range partitioned by group and order and sorted within partitions; sums inside a partition are lifted by
    those of the partitions before, so no group is worked on by a single task.  The sorted rows are
    checkpointed, as range boundaries are sampled and must not change when a task runs again.  ``order``
    should be unique within a group; equal rows are put in an arbitrary order.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(g) for g in group]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    local = placed.withColumn("_p", F.shiftright("_id", 33))
    # One row per group and partition that holds some of it.
    sizes = local.groupBy(*group, "_p").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    earlier = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    lifts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_p").alias("_lp"), *[F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_l_{w}") for w in weights])
    match = F.col("_p") == F.col("_lp")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_p", *group).orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    sums = local.withColumns({f"_s_{w}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights})
    out = sums.join(lifts, match).withColumns({f"before_{w}": F.col(f"_l_{w}") + F.col(f"_s_{w}") for w in weights})
    return out.drop("_id", "_p", "_lp", *[f"_g{i}" for i in range(len(group))], *[f"_{x}_{w}" for w in weights for x in "ls"])


def value_ranks(df: DataFrame, group: list[str], value: str, descending: bool = True) -> DataFrame:
    """Per group and distinct value: ``n`` rows, ``rank`` (competition rank, 1 first) and ``upto`` (rows at or before it).

    Rows are counted per value before anything is ordered, so a value that a third of the rows share
    is one row.  NULL values are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    order = F.col(value).desc() if descending else F.col(value)
    ranked = running_before(counts, group, [order], ["n"])
    return ranked.select(*group, value, "n", (F.col("before_n") + 1).alias("rank"), (F.col("before_n") + F.col("n")).alias("upto"))


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of a group of any size: group, one column per name in ``shares``, and ``n``.

    The same as ``percentile``, but no task holds a group's values: they are counted, placed in order by ``value_ranks``, and the
    two that a quantile lies between are picked.  NULL values are left out; a group without values has no row.
    """
    ranked = value_ranks(df, group, value, descending=False)
    totals = ranked.groupBy(*group).agg(F.max("upto").alias("_all")) if group else ranked.agg(F.max("upto").alias("_all"))
    if group:
        match = None
        for g in group:
            one = F.col(g).eqNullSafe(F.col(f"_t_{g}"))
            match = one if match is None else match & one
        placed = ranked.join(totals.select(*[F.col(g).alias(f"_t_{g}") for g in group], "_all"), match).drop(*[f"_t_{g}" for g in group])
    else:
        every = totals.first()["_all"]
        placed = ranked.withColumn("_all", F.lit(every).cast("long"))
    picks, out = [F.max("_all").alias("n")], []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("_all") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("upto") > place) & (F.col("upto") - F.col("n") <= place)
            picks.append(F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}"))
        lo, hi, part = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
        out.append((lo + (hi - lo) * part).alias(name))
    picked = placed.groupBy(*group).agg(*picks) if group else placed.agg(*picks).where("n IS NOT NULL")
    return picked.select(*group, *out, "n")


def weighted_quantiles(df: DataFrame, group: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """``quantiles`` of rows that stand for ``weight`` equal ones each, without ordering the rows; for values as many as the rows.

    Values are counted by their nearest float, which keeps their order; the floats that hold a wanted place are then counted by exact
    value.  So ``df`` is read twice and must give the same values again.  One row per group and place sought is sent to the tasks.
    """
    known = df.withColumn("_f", F.col(value).cast("float"))
    # NULL values are dropped after they are counted: a filter on the value would compute it twice.
    counts = known.groupBy(*group, "_f").agg(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).alias("_n")).where("_n IS NOT NULL")
    coarse = running_before(counts, group, [F.col("_f")], ["_n"])
    totals = coarse.groupBy(*group).agg(F.max(F.col("before__n") + F.col("_n")).alias("n"))
    places = [(name, side, f(F.lit(q) * (F.col("n") - 1)).cast("long")) for name, q in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    wanted = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("n").alias("_all"), F.explode(F.array(*[F.struct(F.lit(f"_{name}_{side}").alias("pick"), at.alias("place")) for name, side, at in places])).alias("_w"))

    def same(prefix: str) -> Column:
        match = F.lit(True)
        for i, g in enumerate(group):
            match = match & F.col(g).eqNullSafe(F.col(f"{prefix}{i}"))
        return match

    sought = coarse.join(wanted, same("_g")).where((F.col("before__n") <= F.col("_w.place")) & (F.col("_w.place") < F.col("before__n") + F.col("_n")))
    sought = sought.select(*group, "_f", F.col("before__n").alias("_base"), "_all", "_w.pick", "_w.place").checkpoint()
    floats = sought.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)], F.col("_f").alias("_hf")).distinct()
    exact = known.join(F.broadcast(floats), (F.col("_f") == F.col("_hf")) & same("_h"), "left_semi").groupBy(*group, "_f", value).agg(F.sum(weight).alias("_m"))
    near = running_before(exact, [*group, "_f"], [F.col(value)], ["_m"])
    keys = sought.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_f").alias("_gf"), "_base", "_all", "pick", "place")
    first = F.col("_base") + F.col("before__m")
    hit = near.join(keys, (F.col("_f") == F.col("_gf")) & same("_g")).where((first <= F.col("place")) & (F.col("place") < first + F.col("_m")))
    picks = [F.max(F.when(F.col("pick") == f"_{name}_{side}", F.col(value))).alias(f"_{name}_{side}") for name, side, _ in places]
    picked = hit.groupBy(*group).agg(F.max("_all").alias("n"), *picks)
    between = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    out = [(F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * between(q)).alias(name) for name, q in shares.items()]
    return picked.select(*group, *out, "n") if group else picked.where("n IS NOT NULL").select(*out, "n")
