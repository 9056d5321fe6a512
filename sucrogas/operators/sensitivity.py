"""Parameter screening: factor space, overrides, elasticities, elementary effects, worklists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def factor_space(params: DataFrame) -> DataFrame:
    """Which parameters can be varied, and why the others cannot: needs ``id``, ``central``, ``low``, ``high`` (double)."""
    c, lo, hi = F.col("central"), F.col("low"), F.col("high")
    reason = (
        F.when(c.isNull(), "no central value").when(lo.isNull() | hi.isNull(), "no range").when(lo > hi, "range is inverted").when(lo == hi, "range is empty").when((c < lo) | (c > hi), "central value outside its range")
    )
    return params.select("id", "central", "low", "high", reason.alias("excluded_because"), reason.isNull().alias("is_factor"))


def override(params: DataFrame, overrides: DataFrame, scenarios: list[int]) -> DataFrame:
    """Parameters of each listed scenario: an overridden one takes its value as central, low and high.

    ``overrides``: ``scenario_id``, ``id``, ``value``; the scenario ids are a parameter of the run (hundreds), exploded as a literal.
    """
    grid = params.select("id", "central", "low", "high", F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario_id"))
    j = grid.join(overrides, ["scenario_id", "id"], "left")
    return j.select("scenario_id", "id", *[F.coalesce("value", x).alias(x) for x in ("central", "low", "high")])


def trajectories(k: int, n: int, levels: int, seed: int) -> list[tuple[int, int, list[float]]]:
    """Seeded elementary-effects trajectories on the unit cube: (trajectory, step, point); step 0 is the start, each step moves one factor by levels / (2 (levels - 1))."""
    if levels < 2 or levels % 2:
        raise ValueError("levels must be even and at least 2")
    rng = np.random.default_rng(seed)
    delta = levels / (2 * (levels - 1))
    grid = np.arange(levels) / (levels - 1)
    out = []
    for t in range(n):
        start = rng.choice(grid[grid <= 1 - delta + 1e-12], size=k)
        up = rng.integers(0, 2, size=k).astype(bool)
        x = np.where(up, start, start + delta)
        out.append((t, 0, [float(v) for v in x]))
        for s, f in enumerate(rng.permutation(k), 1):
            x[f] += delta if up[f] else -delta
            out.append((t, s, [float(v) for v in x]))
    return out


def elementary_effects(runs: DataFrame, factors: list[str], output: str) -> DataFrame:
    """Mean, mean absolute and standard deviation of the elementary effects of each factor, with ranks.

    ``runs``: ``trajectory``, ``step``, one column per factor (unit scale) and the output.  The factor of a step is the one that moved.
    """
    order = Window.partitionBy("trajectory").orderBy("step")
    moved = [F.struct(F.lit(f).alias("factor"), (F.col(f) - F.lag(f).over(order)).alias("d")) for f in factors]
    steps = runs.select("trajectory", "step", (F.col(output) - F.lag(output).over(order)).alias("dy"), F.array(*moved).alias("_m"))
    one = steps.select("dy", F.explode("_m").alias("_m")).where(F.abs(F.col("_m.d")) > 1e-9)
    g = one.select(F.col("_m.factor").alias("factor"), (F.col("dy") / F.col("_m.d")).alias("ee")).groupBy("factor").agg(F.avg("ee").alias("mu"), F.avg(F.abs("ee")).alias("mu_star"), F.stddev_samp("ee").alias("sigma"), F.count("*").alias("n"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.col("mu_star").desc())))


def elasticities(base: DataFrame, moved: DataFrame, key: str, rel_step: float) -> DataFrame:
    """One-sided elasticities: relative change of the output over the relative step; NULL at a zero or missing base.

    ``base``: key, ``y``; ``moved``: key, ``param``, ``sign``, ``y``.
    """
    j = moved.withColumnRenamed("y", "_y").join(base, key)
    return j.select(key, "param", "sign", F.try_divide(F.try_divide(F.col("_y") - F.col("y"), F.col("y")), F.col("sign") * rel_step).alias("elasticity"))


def next_step() -> Column:
    """What to do with a parameter: the first rule that holds."""
    return (
        F.when(F.col("confidence") == "V", "none: verified").when(F.col("page").isNotNull() & F.col("quote").isNotNull(), "check the quoted page").when(F.col("n_sources") == 0, "find a source")
        .when(F.col("n_sources") == 1, "find a second source").when(F.col("excluded_because").isNotNull(), F.concat(F.lit("give a range: "), F.col("excluded_because"))).otherwise("compare the sources")
    )


def worklist(params: DataFrame, priority: DataFrame, references: DataFrame) -> DataFrame:
    """Parameters with their priority, the references that name them and the next step.

    ``references``: ``ref_id``, ``used_for`` (";"-separated parameter ids).
    """
    used = references.select("ref_id", F.explode(F.split("used_for", r"\s*;\s*")).alias("id")).where(F.col("id") != "").distinct()
    per = used.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("ref_id")), ";").alias("refs"), F.count_distinct("ref_id").alias("n_sources"))
    j = params.join(factor_space(params).select("id", "excluded_because"), "id").join(priority, "id", "left").join(per, "id", "left")
    return j.withColumn("n_sources", F.coalesce("n_sources", F.lit(0))).withColumn("next_step", next_step())
