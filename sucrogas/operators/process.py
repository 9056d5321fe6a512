"""Plant operation: loads, digester size, monthly mass balance, feasibility flags.

All of it is one frame: the feed is reduced once per plant and month, and what needs all months of a plant (the digester
volume) is a window on the same partitioning, so nothing is joined back.  Amounts may be numbers or the names of columns
(one value per scenario).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative tolerance of the load and retention checks.
RTOL = 1e-9

Amount = float | str | None


def amount(x: Amount) -> Column:
    """A number, or the column of that name; NULL for None."""
    return F.col(x) if isinstance(x, str) else F.lit(x).cast("double")


def monthly_loads(feed: DataFrame, substrates: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Loads per key and month from the long feed, with the gas each substrate can give.

    ``substrates``: ``substrate``, ``basis``, ``density``, ``ts``, ``vs``, ``cod``, ``removal``, ``ch4_yield``, ``bmp``, ``rate_k``, ``so4``, ``k``, optionally
    ``ch4_frac`` and ``scenario_id`` (then a row counts for its scenario only).  Ratios that need a property are NULL unless every substrate fed in the month states
    it.  A feed row of an unknown substrate makes the month's sums NULL (nothing is filled in).  ``carry``: columns that are one value per
    key.  ``_gas`` holds per substrate fed the methane at full degradation, its rate and its share of the gas.
    """
    carry = carry or []
    if "ch4_frac" not in substrates.columns:
        substrates = substrates.withColumn("ch4_frac", F.lit(None).cast("double"))
    on = [c for c in ("scenario_id", "substrate") if c in substrates.columns and (c == "substrate" or c in keys)]
    j = feed.join(substrates, on, "left")
    m, v = F.col("fresh_t"), F.col("fresh_t") / F.col("density")
    fed = m > 0
    known = lambda c: F.bool_and(F.when(fed, F.col(c).isNotNull()).otherwise(F.lit(True)))
    total = lambda c: F.sum(v * F.coalesce(F.col(c), F.lit(0.0)))
    full = F.when(~fed, 0.0).when(F.col("basis") == "cod", v * F.col("cod") * F.col("removal") * F.col("ch4_yield")).otherwise(m * F.col("ts") * F.col("vs") * F.col("bmp"))
    # At most one entry per substrate.
    gas = F.collect_list(F.struct(full.alias("ch4"), (F.col("basis") == "vs").alias("vs_basis"), F.col("rate_k").alias("rate_k"), F.col("ch4_frac").alias("x")))
    g = j.groupBy(*keys, *carry, "month").agg(
        F.sum("fresh_t").alias("fresh_t"), F.sum(v).alias("_v"), F.sum(m * F.col("ts") * F.col("vs")).alias("_vs"), F.sum(m * F.col("ts")).alias("_ts"),
        known("cod").alias("_cod_known"), known("so4").alias("_so4_known"), known("k").alias("_k_known"), total("cod").alias("_cod"), total("so4").alias("_so4"), total("k").alias("_k"), gas.alias("_gas"),
    )
    days = F.dayofmonth(F.last_day("month"))
    return g.select(
        *keys, *carry, "month", days.alias("days"), "fresh_t", (F.col("_v") / days).alias("flow_m3_d"), (F.col("_vs") * 1000 / days).alias("vs_load_kg_d"),
        F.coalesce(F.try_divide(F.col("_ts"), F.col("fresh_t")), F.lit(0.0)).alias("feed_ts"),
        F.when(F.col("_cod_known") & F.col("_so4_known") & (F.col("_so4") > 0), F.try_divide(F.col("_cod"), F.col("_so4"))).alias("feed_cod_so4"),
        F.when(F.col("_k_known") & (F.col("_v") > 0), F.try_divide(F.col("_k"), F.col("_v"))).alias("feed_k"), "_gas",
    )


def with_digester(loads: DataFrame, keys: list[str], olr_max: Amount, hrt_min: Amount) -> DataFrame:
    """Adds ``digester_m3``, the smallest volume that keeps load and retention in every month of a key, ``olr`` and ``hrt_d``.

    At zero flow the retention is unbounded: NULL.
    """
    by_load, by_time = F.col("vs_load_kg_d") / amount(olr_max), F.col("flow_m3_d") * amount(hrt_min)
    need = F.when(by_load.isNotNull() & by_time.isNotNull(), F.greatest(by_load, by_time))
    # A month that is not known leaves the volume unknown.
    months = Window.partitionBy(*keys)
    sized = loads.withColumn("digester_m3", F.when(F.bool_and(need.isNotNull()).over(months), F.max(need).over(months)))
    return sized.withColumns({"olr": F.try_divide(F.col("vs_load_kg_d"), F.col("digester_m3")), "hrt_d": F.try_divide(F.col("digester_m3"), F.col("flow_m3_d"))})


def with_gas(sized: DataFrame, *, x_ch4: Amount, bmp_fullscale: Amount) -> DataFrame:
    """Adds ``ch4_nm3`` and ``biogas_nm3`` per month.

    Methane of a COD substrate is volume x COD x removal x yield, of a VS substrate mass x TS x VS x BMP x full-scale factor x
    (1 - exp(-k HRT)), full degradation where k or the retention is NULL; nothing for masses <= 0.  The gas is the methane over ``x_ch4``; with
    None each substrate's own share counts, and the month is NULL where one that gives methane has none.
    """
    hrt, scale = F.col("hrt_d"), amount(bmp_fullscale)
    eta = lambda g: F.when(g["rate_k"].isNull() | hrt.isNull(), F.lit(1.0)).otherwise(1 - F.exp(-g["rate_k"] * hrt))
    one = lambda g: g["ch4"] * F.when(g["vs_basis"], scale * eta(g)).otherwise(F.lit(1.0))
    over = lambda f: F.aggregate(F.transform("_gas", f), F.lit(0.0), lambda a, b: a + b)
    gas = over(one) / amount(x_ch4) if x_ch4 is not None else over(lambda g: F.when(g["ch4"] == 0, 0.0).otherwise(one(g) / g["x"]))
    return sized.select("*", over(one).alias("ch4_nm3"), gas.alias("biogas_nm3")).drop("_gas")


def mass_balance(months: DataFrame, *, nameplate: Amount, recovery: Amount) -> DataFrame:
    """Output of each month, capped by the nameplate (per day): potential, delivered and curtailed biomethane, per day, capacity factor.

    Without a nameplate (NULL) nothing is capped and there is no capacity factor; an unknown potential stays unknown.
    """
    potential = F.col("ch4_nm3") * amount(recovery)
    cap = amount(nameplate) * F.col("days")
    out = F.when(cap < potential, cap).otherwise(potential)
    return months.withColumns({"potential_nm3": potential, "biomethane_nm3": out, "curtailed_nm3": potential - out, "biomethane_nm3_d": out / F.col("days"), "capacity_factor": F.try_divide(out, cap)})


def feasibility(balance: DataFrame, *, olr_max: Amount, hrt_min: Amount, ts_max: Amount, cod_so4_min: Amount, k_max: Amount) -> DataFrame:
    """Three-valued checks (None or a NULL limit: no check); ``feasible`` holds when every check that can be evaluated passes.  Unbounded retention passes."""
    flags = {
        "olr_ok": F.col("olr") <= amount(olr_max) * (1 + RTOL),
        "hrt_ok": F.coalesce(F.col("hrt_d") >= amount(hrt_min) * (1 - RTOL), F.lit(True)),
        "ts_ok": F.col("feed_ts") <= amount(ts_max),
        "cod_so4_ok": F.col("feed_cod_so4") >= amount(cod_so4_min),
        "k_ok": F.col("feed_k") <= amount(k_max),
        "tan_ok": F.lit(None).cast("boolean"),
    }
    every = F.lit(True)
    for f in flags.values():
        every = every & F.coalesce(f, F.lit(True))
    return balance.select("*", *[v.alias(k) for k, v in flags.items()], every.alias("feasible"))
