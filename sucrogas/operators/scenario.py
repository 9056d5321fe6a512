"""The residue-to-cost chain driven by a table of parameters, for many scenarios at once.

Every scenario is a set of parameter rows (``id``, ``central``, ``low``, ``high``, ``central_text``).  The rows of a scenario are
turned into one wide row; residue coefficients, substrates, operating limits and costs are expressions over it; and the whole chain runs with
``scenario_id`` as one more key, so 440 screening runs are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sucrogas.operators import economics, process, sensitivity, supply
from sucrogas.session import ensure_checkpoint_dir

# Parameter ids with their unit, as they stand in the parameter table.
COEFFICIENTS = {"ethanol_l_per_t": "ethanol_yield", "vinasse_l_per_l": "vin_gen", "cake_kg_per_t": "fc_gen", "straw_kg_per_t": "straw_gen", "straw_recoverable": "straw_recov"}
PAIRS = ("vin_ts_vs", "fc_ts_vs")
VINASSE = ("vin_cod", "cod_removal", "vin_ch4_yield", "vin_so4", "vin_k2o")
#: Substrates with a TS, a VS share, a methane yield and a methane share: name to (prefix, id of the yield).
SOLIDS = {"straw": ("straw", "straw_bmp_untreated"), "cattle_slurry": ("cattle_slurry", "cattle_slurry_bmp"), "swine_slurry": ("swine_slurry", "swine_slurry_bmp"), "poultry_droppings": ("poultry_droppings", "poultry_droppings_bmp"), "poultry_litter": ("poultry_litter", "poultry_litter_bmp")}
LIMITS = {"olr_max": "olr_max_cstr", "bmp_fullscale": "bmp_fullscale", "cod_so4_min": "cod_so4_crit", "k_max": "k_inhib"}
COSTS = {"specific": "capex_epe", "variable": "opex_epe", "rate_pct": "wacc_real", "years": "plant_life"}
#: Mass of potassium in its oxide (2 x 39.0983 / (2 x 39.0983 + 15.999)); highest solids in a stirred tank where no row says otherwise.
K_PER_K2O = 0.830148
TS_MAX = 0.12
OUTPUTS = ("annual_biomethane_nm3", "capacity_factor_annual", "unit_cost", "months_infeasible")
#: Outputs that rank parameters; infeasible months are a count, often 0.
PRIORITY_OUTPUTS = OUTPUTS[:3]


def needed_ids(substrates: tuple[str, ...] = ("vinasse", "filter_cake", "straw")) -> list[str]:
    """Ids of the parameters that the chain reads for these substrates."""
    ids = [*COEFFICIENTS.values(), "straw_ts", *VINASSE, *PAIRS, "fc_bmp", *LIMITS.values(), "hrt_cstr", *COSTS.values()]
    for s in substrates:
        if s in SOLIDS:
            prefix, bmp = SOLIDS[s]
            ids += [f"{prefix}_ts", f"{prefix}_vs_ts", bmp, f"{prefix}_ch4_pct"]
    return list(dict.fromkeys(ids))


def wide(params: DataFrame, ids: list[str]) -> DataFrame:
    """One row per ``scenario_id`` with a struct (``central``, ``low``, ``high``, ``first``, ``second``) per id; NULL where a row is missing.

    ``first`` and ``second`` are the two numbers of a ``central_text`` such as "16 / 9".  Of repeated rows the largest counts.
    """
    number = r"\s*(-?\d+(?:\.\d+)?)\s*"
    part = lambda i: F.regexp_extract("central_text", f"^{number}/{number}$", i).try_cast("double")
    cell = F.struct("central", "low", "high", part(1).alias("first"), part(2).alias("second"))
    return params.where(F.col("id").isin(ids)).groupBy("scenario_id").agg(*[F.max(F.when(F.col("id") == i, cell)).alias(i) for i in ids])


def coefficients(w: DataFrame) -> DataFrame:
    """Residue coefficients per scenario; the solids of straw as a fraction."""
    return w.select("scenario_id", *[F.col(f"{i}.central").alias(n) for n, i in COEFFICIENTS.items()], (F.col("straw_ts.central") / 100).alias("straw_ts"))


def substrates(w: DataFrame, density: float = 1.0) -> DataFrame:
    """Substrates per scenario in the form ``process.monthly_loads`` takes.

    Vinasse on COD (its TS and VS in g/L), filter cake and the solids on VS (TS in % of fresh mass, VS in % of TS).  ``density`` of
    fresh matter is an assumption of the caller.  A substrate with a missing parameter has NULL there, and so have sums it enters.
    """
    c = lambda i: F.col(f"{i}.central")
    null = F.lit(None).cast("double")
    d = F.lit(density)
    rows = [
        F.struct(
            F.lit("vinasse").alias("substrate"), F.lit("cod").alias("basis"), d.alias("density"), (F.col("vin_ts_vs.first") / 1000 / d).alias("ts"), F.try_divide(F.col("vin_ts_vs.second"), F.col("vin_ts_vs.first")).alias("vs"), c("vin_cod").alias("cod"),
            (c("cod_removal") / 100).alias("removal"), c("vin_ch4_yield").alias("ch4_yield"), null.alias("bmp"), null.alias("rate_k"), c("vin_so4").alias("so4"), (c("vin_k2o") * K_PER_K2O).alias("k"), null.alias("ch4_frac"),
        ),
        F.struct(
            F.lit("filter_cake").alias("substrate"), F.lit("vs").alias("basis"), d.alias("density"), (F.col("fc_ts_vs.first") / 100).alias("ts"), (F.col("fc_ts_vs.second") / 100).alias("vs"), null.alias("cod"),
            null.alias("removal"), null.alias("ch4_yield"), c("fc_bmp").alias("bmp"), null.alias("rate_k"), null.alias("so4"), null.alias("k"), null.alias("ch4_frac"),
        ),
    ]
    for name, (prefix, bmp) in SOLIDS.items():
        if bmp in w.columns:
            rows.append(F.struct(
                F.lit(name).alias("substrate"), F.lit("vs").alias("basis"), d.alias("density"), (c(f"{prefix}_ts") / 100).alias("ts"), (c(f"{prefix}_vs_ts") / 100).alias("vs"), null.alias("cod"),
                null.alias("removal"), null.alias("ch4_yield"), c(bmp).alias("bmp"), null.alias("rate_k"), null.alias("so4"), null.alias("k"), (c(f"{prefix}_ch4_pct") / 100).alias("ch4_frac"),
            ))
    return w.select("scenario_id", F.explode(F.array(*rows)).alias("_s")).select("scenario_id", "_s.*")


def limits(w: DataFrame) -> DataFrame:
    """Operating limits per scenario; the least retention is the low end of its range where there is one."""
    return w.select("scenario_id", *[F.col(f"{i}.central").alias(n) for n, i in LIMITS.items()], F.coalesce("hrt_cstr.low", "hrt_cstr.central").alias("hrt_min"), F.lit(TS_MAX).alias("ts_max"))


def costs(w: DataFrame) -> DataFrame:
    """Cost inputs per scenario; a lifetime that is no whole number of years is NULL (no cost can be given then)."""
    years = F.col("plant_life.central")
    return w.select("scenario_id", F.col("capex_epe.central").alias("specific"), F.col("opex_epe.central").alias("variable"), (F.col("wacc_real.central") / 100).alias("rate"), F.when(years == F.floor(years), years).alias("years"))


def run_chain(cases: DataFrame, params: DataFrame, scenarios: list[int], keys: list[str], to_ad: dict[str, float], *, x_ch4: float | None = None, recovery: float = 1.0, density: float = 1.0) -> DataFrame:
    """Monthly balance of every case under every scenario, with limits, flags and cost inputs.

    ``cases``: ``keys`` (with ``crop_year``), ``cane_t``, optionally ``ethanol_l`` and ``nameplate`` (per day; NULL or missing: uncapped).  ``params``: the parameter rows with
    ``scenario_id``.  Each case is repeated for the listed ``scenarios`` (the length of the study) and joined with their settings; the feed is then reduced
    once per case, scenario and month.  A scenario without parameters gives no rows.
    """
    w = wide(params, needed_ids())
    settings = coefficients(w).join(limits(w), "scenario_id").join(costs(w), "scenario_id")
    names = [c for c in settings.columns if c != "scenario_id"]
    if "nameplate" not in cases.columns:
        cases = cases.withColumn("nameplate", F.lit(None).cast("double"))
    each = cases.select("*", F.explode(F.array(*[F.lit(n) for n in scenarios])).alias("scenario_id")).join(settings, "scenario_id")
    key = ["scenario_id", *keys]
    carry = ["nameplate", *[c for c in names if c not in (*COEFFICIENTS, "straw_ts")]]
    amounts = {**{n: n for n in COEFFICIENTS}, "straw_ts": "straw_ts"}
    residues = supply.monthly_residues(each, amounts, to_ad, carry=carry)
    feed = supply.to_feed(residues, key, density, carry)
    loads = process.monthly_loads(feed, substrates(w, density), key, carry)
    gas = process.with_gas(process.with_digester(loads, key, "olr_max", "hrt_min"), x_ch4=x_ch4, bmp_fullscale="bmp_fullscale")
    capped = process.mass_balance(gas, nameplate="nameplate", recovery=recovery)
    return process.feasibility(capped, olr_max="olr_max", hrt_min="hrt_min", ts_max="ts_max", cod_so4_min="cod_so4_min", k_max="k_max")


def outputs(months: DataFrame, keys: list[str]) -> DataFrame:
    """The four outputs of every case and scenario: annual biomethane, annual capacity factor, unit cost (NULL without output or nameplate), infeasible months; and the peak.

    A case with a month that is not known has no annual biomethane.
    """
    key = ["scenario_id", *keys]
    g = months.groupBy(*key).agg(
        F.when(F.bool_and(F.col("biomethane_nm3").isNotNull()), F.sum("biomethane_nm3")).alias("annual_biomethane_nm3"), F.sum(F.col("nameplate") * F.col("days")).alias("_cap"), F.max(F.col("potential_nm3") / F.col("days")).alias("peak_nm3_d"),
        F.sum((~F.col("feasible")).cast("int")).cast("double").alias("months_infeasible"), *[F.max(c).alias(c) for c in ("nameplate", "specific", "variable", "rate", "years")],
    )
    cost = economics.unit_cost(F.col("nameplate") * F.col("specific"), F.col("annual_biomethane_nm3"), F.col("rate"), F.col("years"), variable=F.col("variable"))
    return g.select(*key, "annual_biomethane_nm3", F.try_divide("annual_biomethane_nm3", "_cap").alias("capacity_factor_annual"), cost["total"].alias("unit_cost"), "months_infeasible", "peak_nm3_d")


def with_peak_nameplate(cases: DataFrame, params: DataFrame, keys: list[str], to_ad: dict[str, float], central: int = 0, **chain: float | None) -> DataFrame:
    """Cases whose nameplate is the peak month of their potential under the ``central`` scenario (a first pass of the chain)."""
    probe = run_chain(cases.drop("nameplate"), params.where(F.col("scenario_id") == central), [central], keys, to_ad, **chain)
    return cases.drop("nameplate").join(probe.groupBy(*keys).agg(F.max(F.col("potential_nm3") / F.col("days")).alias("nameplate")), keys)


def screening_overrides(factors: list[tuple[str, float, float]], runs: int, levels: int, seed: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, float]]]:
    """Runs of an elementary-effects screen: (scenario, trajectory, step) with scenario ids from 1, and (scenario, id, value).

    A factor takes ``low + q (high - low)`` at quantile q of the trajectory's point.
    """
    plan, values = [], []
    for n, (t, s, point) in enumerate(sensitivity.trajectories(len(factors), runs, levels, seed), 1):
        plan.append((n, t, s))
        values += [(n, i, low + q * (high - low)) for (i, low, high), q in zip(factors, point, strict=True)]
    return plan, values


def elementary_effects(results: DataFrame, plan: DataFrame, moves: DataFrame, central: DataFrame, resamples: DataFrame) -> DataFrame:
    """Elementary effects of every factor on every output: mean, mean absolute, deviation, bootstrap interval, relative to the central output, rank per output.

    ``results``: ``scenario_id``, outputs; ``plan``: ``scenario_id``, ``trajectory``, ``step``; ``moves``: ``trajectory``, ``step``, ``factor``, ``delta`` (of the quantile; the factor that moved);
    ``central``: one row of outputs; ``resamples``: ``resample``, ``trajectory`` (drawn with replacement).  ``mu_star_conf`` is 1.96 deviations of the
    means over resampled trajectories.
    """
    ensure_checkpoint_dir(plan.sparkSession)
    long = plan.join(results, "scenario_id").unpivot(["trajectory", "step"], list(OUTPUTS), "output", "y")
    order = Window.partitionBy("output", "trajectory").orderBy("step")
    steps = long.withColumn("dy", F.col("y") - F.lag("y").over(order))
    ee = steps.join(moves, ["trajectory", "step"]).select("output", "factor", "trajectory", (F.col("dy") / F.col("delta")).alias("ee")).checkpoint()
    stats = ee.groupBy("output", "factor").agg(F.avg("ee").alias("mu"), F.avg(F.abs("ee")).alias("mu_star"), F.stddev_samp("ee").alias("sigma"))
    means = ee.join(resamples, "trajectory").groupBy("output", "factor", "resample").agg(F.avg(F.abs("ee")).alias("m"))
    conf = means.groupBy("output", "factor").agg((1.96 * F.stddev_samp("m")).alias("mu_star_conf"))
    base = central.select(*OUTPUTS).unpivot([], list(OUTPUTS), "output", "base")
    j = stats.join(conf, ["output", "factor"]).join(base, "output")
    rank = F.rank().over(Window.partitionBy("output").orderBy(F.round("mu_star", 9).desc()))
    return j.select("output", "factor", "mu", "mu_star", "sigma", "mu_star_conf", F.try_divide(F.col("mu_star"), F.abs("base")).alias("mu_star_rel"), rank.alias("rank"))


def priority(effects: DataFrame) -> DataFrame:
    """Factors by their largest relative effect on an output that ranks: ``rank``, ``factor``, ``max_mu_star_rel``, ``output``."""
    use = effects.where(F.col("output").isin(*PRIORITY_OUTPUTS))
    best = use.groupBy("factor").agg(F.max(F.struct(F.round("mu_star_rel", 9).alias("r"), "output")).alias("_b"))
    return best.select(F.row_number().over(Window.orderBy(F.col("_b.r").desc_nulls_last(), "factor")).alias("rank"), "factor", F.col("_b.r").alias("max_mu_star_rel"), F.col("_b.output").alias("output"))
