"""Reported against modelled values, laboratory curves and reactor logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sucrogas.operators.ranks import quantiles

def thousand_scale(df: DataFrame, volume: str, capacity: str, max_share: float = 0.01) -> DataFrame:
    """Rows whose positive volume lies below a small share of the capacity: candidates for values in thousands."""
    return df.where((F.col(volume) > 0) & (F.col(volume) < max_share * F.col(capacity)))


def compare_with_observed(simulated: DataFrame, observed: DataFrame, keys: list[str], near_zero: float) -> DataFrame:
    """Simulated against observed months per key: months compared, mean absolute error, bias, volume ratio.

    ``simulated``: keys, ``month``, ``sim``; ``observed``: keys, ``month``, ``obs``, ``util``.  Months without an observation or with a use of at most
    ``near_zero`` are left out of the errors; a key with none left has NULL errors.
    """
    j = simulated.join(observed, [*keys, "month"], "left")
    use = F.col("obs").isNotNull() & (F.coalesce(F.col("util"), F.lit(0.0)) > near_zero)
    d = F.col("sim") - F.col("obs")
    return j.groupBy(*keys).agg(
        F.count("*").alias("months"), F.sum(use.cast("long")).alias("compared"), F.avg(F.when(use, F.abs(d))).alias("mae"), F.avg(F.when(use, d)).alias("bias"),
        F.try_divide(F.sum(F.when(use, F.col("sim"))), F.sum(F.when(use, F.col("obs")))).alias("volume_ratio"),
    )


def ratio_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, median, 10 % and 90 % quantile and mean absolute log of the positive ratios in each column."""
    long = df.select(*columns).unpivot([], columns, "ratio", "x").where((F.col("x") > 0) & ~F.isnan("x") & (F.col("x") < float("inf")))
    logs = long.groupBy("ratio").agg(F.avg(F.abs(F.log("x"))).alias("mean_abs_log"))
    return quantiles(long, ["ratio"], "x", {"median": 0.5, "p10": 0.1, "p90": 0.9}).join(logs, "ratio").select("ratio", "n", "median", "p10", "p90", "mean_abs_log")


def period_check(monthly: DataFrame, periods: DataFrame, key: str) -> DataFrame:
    """Monthly values summed over reported periods (both ends included) against the reported value.

    ``monthly``: key, ``month`` (date), ``value``; ``periods``: key, ``period``, ``start``, ``end``, ``reported``.  A plant has few
    periods, so the periods are exploded to their months and joined on equality.  Complete periods
    have every month present.
    """
    months = F.explode(F.sequence("start", "end", F.expr("interval 1 month"))).alias("month")
    need = (F.year("end") - F.year("start")) * 12 + F.month("end") - F.month("start") + 1
    spans = periods.select(key, "period", "reported", need.alias("n_need"), months)
    j = spans.join(monthly, [key, "month"], "left")
    return j.groupBy(key, "period", "reported", "n_need").agg(F.sum("value").alias("total"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("month"))).alias("n_months")).select(
        key, "period", "reported", "total", "n_months", (F.col("n_months") == F.col("n_need")).alias("complete"), F.try_divide(F.col("total"), F.col("reported")).alias("ratio")
    )


def single_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value per key; keys with different values give NULL and ``conflict`` instead of an average."""
    g = df.groupBy(*keys).agg(F.count_distinct(value).alias("_n"), F.max(value).alias("_v"))
    return g.select(*keys, F.when(F.col("_n") <= 1, F.col("_v")).alias(value), (F.col("_n") > 1).alias("conflict"))


def feed_to_gas(reported: DataFrame, keys: list[str], ch4_per_vinasse: float, ch4_per_cake: float, x_ch4: list[float]) -> DataFrame:
    """Biogas explained by reported feed for several methane shares.

    ``reported``: keys, ``quantity``, ``value`` in long form.  Periods without reported biogas are left out; without both feeds the gas columns are NULL.
    """
    v = lambda q: F.max(F.when(F.col("quantity") == q, F.col("value")))
    wide = reported.groupBy(*keys).agg(v("biogas").alias("biogas"), v("vinasse").alias("vinasse"), v("cake").alias("cake"), v("cofeed").alias("cofeed")).where(F.col("biogas").isNotNull())
    each = wide.withColumn("x_ch4", F.explode(F.array(*[F.lit(x) for x in x_ch4])))
    modelled = (F.col("vinasse") * ch4_per_vinasse + F.col("cake") * ch4_per_cake) / F.col("x_ch4")
    return each.select(*keys, "x_ch4", "biogas", "vinasse", "cake", modelled.alias("modelled"), F.try_divide(modelled, F.col("biogas")).alias("explained"), F.when(F.col("cofeed") > 0, F.try_divide(F.col("biogas") - modelled, F.col("cofeed"))).alias("gas_per_cofeed"))


def closure_values(table: DataFrame, keys: list[str], params: list[tuple[str, str, float, float, float]], ch4_per: dict[str, float]) -> DataFrame:
    """The value of each yield parameter that closes the gas balance, and whether it lies in the parameter's range.

    ``params``: (name, stream, central, low, high) with stream "vinasse" or "cake".
    """
    need = F.col("biogas") * F.col("x_ch4")
    own = {s: F.col(s) * ch4_per[s] for s in ("vinasse", "cake")}
    parts = []
    for name, stream, central, low, high in params:
        other = own["cake" if stream == "vinasse" else "vinasse"]
        star = F.when(own[stream] > 0, F.lit(central) * (need - other) / own[stream])
        parts.append(F.struct(F.lit(name).alias("param"), star.alias("closure"), star.between(low, high).alias("in_range")))
    return table.where(F.col("modelled").isNotNull()).select(*keys, "x_ch4", F.explode(F.array(*parts)).alias("_p")).select(*keys, "x_ch4", "_p.*")


def blank_corrected(samples: DataFrame, blanks: DataFrame, keys: list[str]) -> DataFrame:
    """Specific yield less the blank's gas per inoculum: needs ``day``, ``gas``, ``inoculum_g``, ``substrate_g``.  Days without a blank give NULL."""
    b = blanks.groupBy(*keys, "day").agg(F.avg(F.col("gas") / F.col("inoculum_g")).alias("_blank"))
    j = samples.join(b, [*keys, "day"], "left")
    return j.withColumn("specific_yield", F.try_divide(F.col("gas") - F.col("_blank") * F.col("inoculum_g"), F.col("substrate_g"))).drop("_blank")


def replicate_validity(curves: DataFrame, keys: list[str], rsd_max: float, rate_max: float) -> DataFrame:
    """Final mean and relative standard deviation of replicates, and the mean daily rise over the last interval, with flags (False where not evaluable)."""
    by_day = curves.groupBy(*keys, "day").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("sd"), F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("day")
    last = by_day.select(*keys, "day", "m", "sd", "n", F.lag("m").over(order).alias("m0"), F.lag("day").over(order).alias("d0"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("day").desc())).alias("_r")).where("_r = 1")
    rsd = F.when(F.col("n") > 1, F.try_divide(F.col("sd"), F.col("m")))
    rate = F.try_divide(F.try_divide(F.col("m") - F.col("m0"), F.col("day") - F.col("d0")), F.col("m"))
    return last.select(*keys, F.col("day").alias("final_day"), F.col("m").alias("final_mean"), rsd.alias("rsd"), rate.alias("end_rate"), F.coalesce(rsd <= rsd_max, F.lit(False)).alias("ok_rsd"), F.coalesce(rate <= rate_max, F.lit(False)).alias("ok_end"))


def weekly_reactor(log: DataFrame, limit: float | None) -> DataFrame:
    """Calendar weeks (labelled by their Sunday) of a reactor log: loads, retention, specific yield and stability.

    Needs ``reactor_id``, ``date``, ``feed_g``, ``volume_l``, ``effluent_l``, ``gas_nl``, ``ch4_pct``, ``fos``, ``tac``, ``notes``; rows noted as synthetic are skipped.
    """
    real = log.where(~F.coalesce(F.col("notes"), F.lit("")).contains("synthetic"))
    week = F.date_add(F.date_trunc("week", F.col("date")).cast("date"), 6)
    g = real.groupBy("reactor_id", week.alias("week_end")).agg(
        F.count("date").alias("days"), F.avg("feed_g").alias("feed"), F.avg("volume_l").alias("vol"), F.avg("effluent_l").alias("eff"), F.avg(F.col("gas_nl") * F.col("ch4_pct") / 100).alias("ch4"), F.avg("fos").alias("fos"), F.avg("tac").alias("tac")
    )
    ratio = F.try_divide(F.col("fos"), F.col("tac"))
    flag = (ratio <= limit) if limit is not None else F.lit(None).cast("boolean")
    return g.select("reactor_id", "week_end", "days", F.try_divide(F.col("feed"), F.col("vol")).alias("olr"), F.try_divide(F.col("vol"), F.col("eff")).alias("hrt_d"), F.try_divide(F.col("ch4") * 1000, F.col("feed")).alias("specific_yield"), ratio.alias("fos_tac"), flag.alias("ok_fos_tac"))


def fit_first_order(t: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """Least-squares fit of b0 (1 - exp(-k t)) by damped Gauss-Newton: b0, k, r2 (NaN if it cannot be fitted)."""
    return _fit_first_order(t, y, rounds)[:3]


def _fit_first_order(t: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, ...]:
    """The fit with the standard errors of both parameters."""
    ok = np.isfinite(t) & np.isfinite(y)
    t, y = t[ok], y[ok]
    if len(t) < 3 or y.max(initial=0) <= 0:
        return (float("nan"),) * 5
    return _gauss_newton(t, y, np.array([y.max(), 0.2]), lambda p, t: p[0] * (1 - np.exp(-p[1] * t)), rounds)


def _gauss_newton(t: np.ndarray, y: np.ndarray, p: np.ndarray, f, rounds: int) -> tuple:
    lam, err = 1e-3, float(((f(p, t) - y) ** 2).sum())
    for _ in range(rounds):
        jac = np.column_stack([(f(p + h, t) - f(p - h, t)) / (2 * h[i]) for i in range(len(p)) for h in [np.eye(len(p))[i] * max(1e-6, abs(p[i]) * 1e-6)]])
        a = jac.T @ jac
        try:
            step = np.linalg.solve(a + lam * np.diag(np.diag(a) + 1e-12), jac.T @ (y - f(p, t)))
        except np.linalg.LinAlgError:
            break
        new = np.maximum(p + step, 1e-9)
        e = float(((f(new, t) - y) ** 2).sum())
        if e < err:
            done = err - e < 1e-14 * (1 + err)
            p, err, lam = new, e, lam / 5
            if done:
                break
        else:
            lam *= 5
            if lam > 1e12:
                break
    spread = float(((y - y.mean()) ** 2).sum())
    jac = np.column_stack([(f(p + h, t) - f(p - h, t)) / (2 * h[i]) for i in range(len(p)) for h in [np.eye(len(p))[i] * max(1e-6, abs(p[i]) * 1e-6)]])
    errors = np.full(len(p), np.nan)
    if len(t) > len(p):
        try:
            errors = np.sqrt(np.maximum(np.diag(np.linalg.inv(jac.T @ jac)) * err / (len(t) - len(p)), 0))
        except np.linalg.LinAlgError:
            pass
    return (*map(float, p), 1 - err / spread if spread > 0 else float("nan"), *map(float, errors))


def fit_curves(curves: DataFrame, keys: list[str]) -> DataFrame:
    """First-order fit of every curve (a few readings each): keys, ``b0``, ``k``, ``r2``, and the modified Gompertz ``p``, ``rate``, ``lag``, ``r2_gompertz``.

    Behind each model stand the standard errors of its parameters (``se_...``), NULL with no more readings than parameters.
    """
    kinds = dict(curves.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "b0 double", "k double", "r2 double", "se_b0 double", "se_k double", "p double", "rate double", "lag double", "r2_gompertz double", "se_p double", "se_rate double", "se_lag double"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t, y = g["day"].to_numpy(float), g["y"].to_numpy(float)
        first = _fit_first_order(t, y)
        ok = np.isfinite(t) & np.isfinite(y)
        second = (float("nan"),) * 7
        if ok.sum() >= 4 and y[ok].max(initial=0) > 0:
            top = y[ok].max()
            gompertz = lambda p, t: p[0] * np.exp(-np.exp(np.clip(p[1] * np.e / p[0] * (p[2] - t) + 1, -50, 50)))
            second = _gauss_newton(t[ok], y[ok], np.array([top, top / max(1.0, t[ok].max() / 4), 0.5]), gompertz, 200)
        return pd.DataFrame([[*(g[k].iloc[0] for k in keys), *first, *second]], columns=[x.split()[0] for x in schema.split(", ")])

    return curves.select(*keys, "day", "y").groupBy(*keys).applyInPandas(run, schema)


def load_problems(curves: DataFrame, keys: list[str]) -> DataFrame:
    """All problems of a table of cumulative curves before it is used: keys, ``problem``, ``day``.

    A reading is missing a number or lies on a negative day, a day is repeated, the curve falls from one day to the next, or it has no day 0 (listed with a NULL day).
    Needs ``day`` and ``y``; readings with problems of their own take no part in the comparison with the day before.
    """
    key = Window.partitionBy(*keys)
    good = F.col("day").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & (F.col("day") >= 0)
    before = F.last(F.when(good, F.col("y")), ignorenulls=True).over(key.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    seen = curves.withColumns({"_n": F.count("*").over(Window.partitionBy(*keys, "day")), "_before": before})
    rules = {
        "no day": F.col("day").isNull(), "day below zero": F.col("day") < 0, "no value": F.col("y").isNull() | F.isnan("y"), "day repeated": F.col("day").isNotNull() & (F.col("_n") > 1),
        "falls from the day before": good & (F.col("y") < F.col("_before")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for text, bad in rules.items()]))
    own = seen.select(*keys, "day", F.explode(found).alias("problem")).select(*keys, "problem", "day")
    start = curves.groupBy(*keys).agg(F.min("day").alias("_first")).where(F.col("_first").isNull() | (F.col("_first") > 0)).select(*keys, F.lit("no day 0").alias("problem"), F.lit(None).cast(dict(curves.dtypes)["day"]).alias("day"))
    return own.unionByName(start).distinct()


def off_season_shares(simulated: DataFrame, observed: DataFrame, keys: list[str], months: list[int]) -> DataFrame:
    """Share of the volume that falls into the off-season months, simulated and observed, over the months that have both: keys, ``sim_share``, ``obs_share``; NULL without volume."""
    j = simulated.join(observed, [*keys, "month"]).where(F.col("sim").isNotNull() & F.col("obs").isNotNull())
    off = F.month("month").isin(*months)
    share = lambda c: F.try_divide(F.sum(F.when(off, F.col(c)).otherwise(0.0)), F.sum(c))
    return j.groupBy(*keys).agg(share("sim").alias("sim_share"), share("obs").alias("obs_share"))


def control_recovery(validity: DataFrame, control: Column, theoretical: float, low: float, high: float) -> DataFrame:
    """Adds ``recovery``, the final mean of a positive control over its theoretical yield, and ``ok_control``; both NULL for samples."""
    r = F.when(control, F.col("final_mean") / F.lit(theoretical))
    return validity.withColumns({"recovery": r, "ok_control": r.between(low, high)})
