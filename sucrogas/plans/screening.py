"""The chain driven by a parameter table: settings, outputs per scenario, elasticities and an elementary-effects screen, with SQL twins.

The parameters are those of a published set; generation of cake and straw and the removal of COD are the means of the table's own readings where it
has any in the plain unit.  The reference case is the mean cane of a mill and crop year, its nameplate the peak month of the central potential.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.operators import economics, scenario, sensitivity
from sucrogas.plans import chain
from sucrogas.session import ensure_checkpoint_dir, small_table, table

# Id, central, low, high, text of pairs.
PARAMS = [
    ("ethanol_yield", 81.0, 70.0, 90.0, None), ("vin_gen", 12.0, 10.0, 15.0, None), ("fc_gen", 37.0, 30.0, 40.0, None), ("straw_gen", 140.0, None, None, None), ("straw_recov", 0.5, None, None, None), ("straw_ts", 85.0, None, None, None),
    ("vin_ts_vs", None, None, None, "16 / 9"), ("fc_ts_vs", None, None, None, "28 / 74"), ("vin_cod", 30.0, 20.0, 45.0, None), ("cod_removal", 70.0, 60.0, 80.0, None), ("vin_ch4_yield", 0.3, 0.25, 0.33, None), ("vin_so4", 2.0, 1.0, 4.0, None),
    ("vin_k2o", 3.0, 2.0, 5.0, None), ("fc_bmp", 220.0, 180.0, 260.0, None), ("straw_vs_ts", 90.0, None, None, None), ("straw_bmp_untreated", 230.0, 200.0, 260.0, None), ("straw_ch4_pct", 52.0, None, None, None), ("olr_max_cstr", 3.0, 2.0, 4.0, None),
    ("hrt_cstr", 40.0, 30.0, 50.0, None), ("bmp_fullscale", 0.85, 0.7, 0.9, None), ("cod_so4_crit", 10.0, None, None, None), ("k_inhib", 3.0, None, None, None), ("capex_epe", 3735.0, 3000.0, 4500.0, None), ("opex_epe", 0.15, 0.1, 0.2, None),
    ("wacc_real", 10.0, 8.0, 12.0, None), ("plant_life", 20.0, None, None, None),
]
SCHEMA = "id string, central double, low double, high double, central_text string"
#: Parameters taken from the table: id, name of the reading, plain units.
MEASURED = [("fc_gen", "Press cake generation", "^kg (per|/|por) ?(t|tonelada|tonne)( cane| cana)?$|^kg/t( cane| cana)?$"), ("straw_gen", "Straw generation", "^kg/t( cane| cana)?$|^kg por tonelada$"), ("cod_removal", "COD removal", "^%$")]
KEYS = ["crop_year"]
TO_AD = chain.TO_AD
OUT = scenario.OUTPUTS
REL_STEP, RUNS, LEVELS, SEED, RESAMPLES = 0.1, 20, 4, 11, 100


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter rows of scenario 0."""
    base = small_table(spark, PARAMS, SCHEMA)
    t = table(spark, sf_dir, "parameters").select("id", "parameter", "unit", "central_value").distinct()
    which = F.coalesce(*[F.when(F.col("parameter").startswith(name) & F.col("unit").rlike(unit), F.lit(i)) for i, name, unit in MEASURED])
    mean = t.select(which.alias("id"), "central_value").where("id IS NOT NULL AND central_value IS NOT NULL").groupBy("id").agg(F.round(F.avg("central_value"), 6).alias("_mean"))
    return base.join(mean, "id", "left").select(F.lit(0).alias("scenario_id"), "id", F.coalesce("_mean", "central").alias("central"), "low", "high", "central_text")


def with_overrides(params: DataFrame, overrides: DataFrame, scenarios: list[int]) -> DataFrame:
    """The parameters of each scenario; the text of pairs is kept."""
    text = params.select("id", "central_text")
    return sensitivity.override(params, overrides, scenarios).join(text, "id")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per crop year the mean cane of a mill."""
    return chain.mill_years(spark, sf_dir).groupBy("crop_year").agg(F.round(F.avg("cane_t"), 6).alias("cane_t"))


def scenario_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients, limits and costs of the central scenario."""
    w = scenario.wide(parameters(spark, sf_dir), scenario.needed_ids())
    return scenario.coefficients(w).join(scenario.limits(w), "scenario_id").join(scenario.costs(w), "scenario_id")


def scenario_substrates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substrates of the central scenario."""
    s = scenario.substrates(scenario.wide(parameters(spark, sf_dir), scenario.needed_ids()))
    return s.select("substrate", "basis", *[F.round(c, 9).alias(c) for c in ("density", "ts", "vs", "cod", "removal", "ch4_yield", "bmp", "so4", "k", "ch4_frac")])


def evaluated(spark: SparkSession, sf_dir: str, overrides: list[tuple[int, str, float]], scenarios: list[int], one_case: bool = False) -> DataFrame:
    """Outputs of the reference cases under the scenarios (0 is the central one)."""
    ensure_checkpoint_dir(spark)
    p = parameters(spark, sf_dir).checkpoint()
    c = cases(spark, sf_dir)
    if one_case:
        c = c.groupBy(F.lit(2024).alias("crop_year")).agg(F.round(F.avg("cane_t"), 6).alias("cane_t"))
    sized = scenario.with_peak_nameplate(c, p, KEYS, TO_AD).checkpoint()
    moved = with_overrides(p, spark.createDataFrame(overrides, "scenario_id int, id string, value double"), scenarios)
    return scenario.outputs(scenario.run_chain(sized, moved, scenarios, KEYS, TO_AD), KEYS)


def chain_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four outputs per crop year: central, all ranges at their low end, all at their high end."""
    ends = [(n, i, v) for n, k in ((1, 2), (2, 3)) for i, *v_ in PARAMS for v in [v_[k - 1]] if v is not None]
    return _rounded(evaluated(spark, sf_dir, ends, [0, 1, 2]))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("scenario_id", *[k for k in KEYS], F.round("annual_biomethane_nm3", 3).alias("annual_biomethane_nm3"), F.round("capacity_factor_annual", 8).alias("capacity_factor_annual"), F.round("unit_cost", 8).alias("unit_cost"), "months_infeasible")


FACTORS = [(i, lo, hi) for i, c, lo, hi, _ in PARAMS if lo is not None and c is not None]
NUMERIC = [(i, c) for i, c, *_ in PARAMS if c is not None]
MEASURED_IDS = {i for i, *_ in MEASURED}
STEPS = [(n, i, sign) for n, (i, sign) in enumerate([(i, s) for i, _ in NUMERIC if i not in MEASURED_IDS for s in (-1, 1)], 1)]


def elasticities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-sided elasticities of the four outputs for every number of the chain; a lifetime of no whole number of years has no cost."""
    value = dict(NUMERIC)
    moved = [(n, i, value[i] * (1 + s * REL_STEP)) for n, i, s in STEPS]
    y = evaluated(spark, sf_dir, moved, [0, *[n for n, _, _ in STEPS]], one_case=True).checkpoint()
    long = y.unpivot(["scenario_id"], list(OUT), "output", "y")
    steps = small_table(spark, STEPS, "scenario_id int, param string, sign int")
    e = sensitivity.elasticities(long.where("scenario_id = 0").select("output", "y"), long.join(steps, "scenario_id").select("output", "param", "sign", "y"), "output", REL_STEP)
    return e.select("output", "param", "sign", F.round("elasticity", 6).alias("elasticity"))


PLAN, POINTS = scenario.screening_overrides(FACTORS, RUNS, LEVELS, SEED)


def _moves() -> list[tuple[int, int, str, float]]:
    """The factor that each step moves, and by how much of its quantile."""
    out, before = [], None
    for t, s, x in sensitivity.trajectories(len(FACTORS), RUNS, LEVELS, SEED):
        if s:
            j = max(range(len(x)), key=lambda i: abs(x[i] - before[i]))
            out.append((t, s, FACTORS[j][0], x[j] - before[j]))
        before = x
    return out


MOVES = _moves()
_RNG = random.Random(SEED)
DRAWS = [(r, _RNG.randrange(RUNS)) for r in range(RESAMPLES) for _ in range(RUNS)]


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    y = evaluated(spark, sf_dir, POINTS, [0, *[n for n, _, _ in PLAN]], one_case=True).checkpoint()
    frame = spark.createDataFrame
    return scenario.elementary_effects(
        y, frame(PLAN, "scenario_id int, trajectory int, step int"), frame(MOVES, "trajectory int, step int, factor string, delta double"), y.where("scenario_id = 0"), frame(DRAWS, "resample int, trajectory int")
    )


def morris_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementary effects of every ranged parameter on the four outputs of the chain, with bootstrap interval and rank per output."""
    return effects(spark, sf_dir).select("output", "factor", *[F.round(c, 5).alias(c) for c in ("mu", "mu_star", "sigma", "mu_star_conf", "mu_star_rel")], "rank")


def screening_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters by their largest relative effect."""
    p = scenario.priority(effects(spark, sf_dir))
    return p.select("rank", "factor", F.round("max_mu_star_rel", 6).alias("max_mu_star_rel"), "output")


ANCHORS = [("per_m3", 1.5, 3.0, "R$ per m3, plant gate"), ("per_mmbtu", 8.0, 14.0, "US$ per MMBtu"), ("open", None, 5.0, "R$ per m3"), ("mass", 1.0, 2.0, "R$ per kg")]


def anchor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit cost of every crop year beside published ranges."""
    y = evaluated(spark, sf_dir, [(0, "opex_epe", 0.15)], [0])
    a = economics.against_anchors(y, "crop_year", "unit_cost", ANCHORS, 39.8, 5.4)
    return a.select("crop_year", "anchor_id", "low", "high", "unit", F.round("engine_value", 7).alias("engine_value"), "within_range")


def cost_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five parts of the unit cost per order, its price being the investment and its lines the output."""
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("double").alias("q"), F.sum("l_extendedprice").cast("double").alias("p"), F.sum("l_tax").cast("double").alias("t"))
    c = economics.unit_cost(F.col("p"), F.col("q") - 60, F.lit(0.08), F.lit(15), fixed=F.col("p") * 0.0317, variable=F.lit(0.10000013), feedstock=F.col("q") * 2, transport=F.col("t") * 5, coproduct=F.col("q") * 0.5)
    return o.select("l_orderkey", *[F.round(c[k], 6).alias(k) for k in ("investment", "operation", "feedstock", "transport", "coproduct", "total")])


def _v(x: object) -> str:
    return "NULL::DOUBLE" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}" if isinstance(x, int) else f"{x!r}::DOUBLE"


_rows = lambda rows: ", ".join("(" + ", ".join(_v(v) for v in r) + ")" for r in rows)
_IDS = scenario.needed_ids()
_P0 = "p0(id, central, low, high, txt) AS (VALUES " + ", ".join("(" + ", ".join("NULL::VARCHAR" if (k == 4 and v is None) else _v(v) for k, v in enumerate(r)) + ")" for r in PARAMS) + ")"
_MEAN = "mean AS (SELECT CASE " + " ".join(f"WHEN starts_with(parameter, '{n}') AND regexp_matches(unit, '{u}') THEN '{i}'" for i, n, u in MEASURED) + " END AS id, round(avg(central_value), 6) AS m FROM (SELECT DISTINCT id, parameter, unit, central_value FROM parameters) WHERE central_value IS NOT NULL GROUP BY 1)"
_PAR = f"{_P0}, {_MEAN}, par AS (SELECT p0.id, coalesce(m, central) AS central, low, high, txt FROM p0 LEFT JOIN mean USING (id))"
_PIVOT = ", ".join(f"max(CASE WHEN id = '{i}' THEN central END) AS {i}" for i in _IDS if i not in scenario.PAIRS) + ", " + ", ".join(f"max(CASE WHEN id = '{i}' THEN split_part(txt, '/', {k})::DOUBLE END) AS {i}_{k}" for i in scenario.PAIRS for k in (1, 2)) + ", max(CASE WHEN id = 'hrt_cstr' THEN coalesce(low, central) END) AS hrt_min"


def _chain_sql(overrides: list[tuple[int, str, float]], scenarios: list[int], one_case: bool) -> str:
    """Common tables of the chain's outputs per scenario, written out month by month."""
    over = f"ov(scenario_id, id, value) AS (VALUES {_rows(overrides)})"
    sc = f"sc0 AS (SELECT unnest([{', '.join(map(str, scenarios))}]) AS scenario_id)"
    sp = "sp AS (SELECT scenario_id, par.id, coalesce(value, central) AS central, coalesce(value, low) AS low, coalesce(value, high) AS high, txt FROM par CROSS JOIN sc0 LEFT JOIN ov USING (scenario_id, id))"
    w = f"w AS (SELECT scenario_id, {_PIVOT} FROM sp GROUP BY 1), w0 AS (SELECT -1 AS scenario_id, {_PIVOT} FROM par), wa AS (SELECT * FROM w UNION ALL SELECT * FROM w0)"
    one = "cs AS (SELECT crop_year, round(avg(cane_t), 6) AS cane FROM cane GROUP BY 1)" if not one_case else "cs0 AS (SELECT crop_year, round(avg(cane_t), 6) AS cane_t FROM cane GROUP BY 1), cs AS (SELECT 2024 AS crop_year, round(avg(cane_t), 6) AS cane FROM cs0)"
    body = """mo AS (SELECT unnest(range(0, 12)) AS pos),
 r0 AS (SELECT wa.*, crop_year, make_date(crop_year + CASE WHEN pos >= 9 THEN 1 ELSE 0 END, (pos + 3) % 12 + 1, 1) AS month, CASE WHEN pos < 8 THEN 0.125e0 ELSE 0e0 END AS s, cane FROM cs, mo, wa),
 r1 AS (SELECT *, day(last_day(month)) AS days, cane * ethanol_yield * s / 1000 * vin_gen AS mv, cane * s * fc_gen / 1000 AS mc, cane * s * straw_gen * straw_recov / 1000 * 0.2e0 / (straw_ts / 100) AS ms FROM r0),
 r2 AS (SELECT *, mv + mc + ms AS m, mv * vin_ts_vs_1 / 1000 * (vin_ts_vs_2 / vin_ts_vs_1) + mc * fc_ts_vs_1 / 100 * fc_ts_vs_2 / 100 + ms * straw_ts / 100 * straw_vs_ts / 100 AS vs,
   mv * vin_ts_vs_1 / 1000 + mc * fc_ts_vs_1 / 100 + ms * straw_ts / 100 AS ts FROM r1),
 r3 AS (SELECT *, max(greatest(vs * 1000 / days / olr_max_cstr, m / days * hrt_min)) OVER (PARTITION BY scenario_id, crop_year) AS vol,
   CASE WHEN mv > 0 THEN mv * vin_cod * cod_removal / 100 * vin_ch4_yield ELSE 0 END + (mc * fc_ts_vs_1 / 100 * fc_ts_vs_2 / 100 * fc_bmp + ms * straw_ts / 100 * straw_vs_ts / 100 * straw_bmp_untreated) * bmp_fullscale AS ch4 FROM r2),
 np AS (SELECT crop_year, max(ch4 / days) AS np FROM r3 WHERE scenario_id = -1 GROUP BY 1),
 r4 AS (SELECT r3.*, np, least(ch4, np * days) AS out, coalesce(vs * 1000 / days / nullif(vol, 0) <= olr_max_cstr * (1 + 1e-9), true) AND coalesce(vol / nullif(m / days, 0) >= hrt_min * (1 - 1e-9), true) AND coalesce(ts / nullif(m, 0), 0) <= 0.12
   AS ok FROM r3 JOIN np USING (crop_year) WHERE scenario_id >= 0),
 a AS (SELECT scenario_id, crop_year, sum(out) AS annual, sum(np * days) AS cap, max(np) * max(capex_epe) AS inv, max(opex_epe) AS opex, max(wacc_real) / 100 AS rate, max(CASE WHEN plant_life = floor(plant_life) THEN plant_life END) AS years,
   sum(CASE WHEN ok THEN 0 ELSE 1 END)::DOUBLE AS bad FROM r4 GROUP BY 1, 2),
 y AS (SELECT scenario_id, crop_year, annual AS annual_biomethane_nm3, annual / nullif(cap, 0) AS capacity_factor_annual,
   CASE WHEN annual > 0 THEN inv * (rate * pow(1 + rate, years) / (pow(1 + rate, years) - 1)) / annual + opex END AS unit_cost, bad AS months_infeasible FROM a)"""
    return f"{chain._CANE}, {_PAR}, {over}, {sc}, {sp}, {w}, {one}, {body}"


_LONG = "yl AS (" + " UNION ALL ".join(f"SELECT scenario_id, '{o}' AS output, {o} AS y FROM y" for o in OUT) + ")"
_ENDS = [(n, i, v) for n, k in ((1, 2), (2, 3)) for i, *v_ in PARAMS for v in [v_[k - 1]] if v is not None]
_EFFECTS = f"""{_chain_sql(POINTS, [0, *[n for n, _, _ in PLAN]], True)}, {_LONG}, plan(scenario_id, trajectory, step) AS (VALUES {_rows(PLAN)}), mv(trajectory, step, factor, delta) AS (VALUES {_rows(MOVES)}), dr(resample, trajectory) AS (VALUES {_rows(DRAWS)}),
 st AS (SELECT output, trajectory, step, y - lag(y) OVER (PARTITION BY output, trajectory ORDER BY step) AS dy FROM plan JOIN yl USING (scenario_id)), ee AS (SELECT output, factor, trajectory, dy / delta AS ee FROM st JOIN mv USING (trajectory, step)),
 sx AS (SELECT output, factor, avg(ee) AS mu, avg(abs(ee)) AS mu_star, stddev_samp(ee) AS sigma FROM ee GROUP BY 1, 2), bm AS (SELECT output, factor, resample, avg(abs(ee)) AS m FROM ee JOIN dr USING (trajectory) GROUP BY 1, 2, 3),
 cf AS (SELECT output, factor, 1.96e0 * stddev_samp(m) AS mu_star_conf FROM bm GROUP BY 1, 2), ef AS (SELECT sx.*, mu_star_conf, mu_star / nullif(abs(yl.y), 0) AS mu_star_rel, rank() OVER (PARTITION BY sx.output ORDER BY round(mu_star, 9) DESC) AS rank
 FROM sx JOIN cf USING (output, factor) JOIN yl ON yl.output = sx.output AND yl.scenario_id = 0)"""
_VALUE = dict(NUMERIC)
_MOVED = [(n, i, _VALUE[i] * (1 + s * REL_STEP)) for n, i, s in STEPS]
QUERIES = {f.__name__: f for f in (scenario_settings, scenario_substrates, chain_outputs, elasticities, morris_indices, screening_priority, anchor_comparison, cost_parts)}
SQL = {
    "scenario_settings": f"""WITH {_PAR}, w AS (SELECT {_PIVOT} FROM par) SELECT 0 AS scenario_id, ethanol_yield AS ethanol_l_per_t, vin_gen AS vinasse_l_per_l, fc_gen AS cake_kg_per_t, straw_gen AS straw_kg_per_t, straw_recov AS straw_recoverable, straw_ts / 100 AS straw_ts,
        olr_max_cstr AS olr_max, bmp_fullscale, cod_so4_crit AS cod_so4_min, k_inhib AS k_max, hrt_min, 0.12e0 AS ts_max, capex_epe AS specific, opex_epe AS variable, wacc_real / 100 AS rate, plant_life AS years FROM w""",
    "scenario_substrates": f"""WITH {_PAR}, w AS (SELECT {_PIVOT} FROM par), s AS (
        SELECT 'vinasse' AS substrate, 'cod' AS basis, 1e0 AS density, vin_ts_vs_1 / 1000 AS ts, vin_ts_vs_2 / vin_ts_vs_1 AS vs, vin_cod AS cod, cod_removal / 100 AS removal, vin_ch4_yield AS ch4_yield, NULL::DOUBLE AS bmp, vin_so4 AS so4, vin_k2o * {scenario.K_PER_K2O} AS k, NULL::DOUBLE AS ch4_frac FROM w
        UNION ALL SELECT 'filter_cake', 'vs', 1, fc_ts_vs_1 / 100, fc_ts_vs_2 / 100, NULL, NULL, NULL, fc_bmp, NULL, NULL, NULL FROM w
        UNION ALL SELECT 'straw', 'vs', 1, straw_ts / 100, straw_vs_ts / 100, NULL, NULL, NULL, straw_bmp_untreated, NULL, NULL, straw_ch4_pct / 100 FROM w)
        SELECT substrate, basis, {', '.join(f'round({c}, 9) AS {c}' for c in ('density', 'ts', 'vs', 'cod', 'removal', 'ch4_yield', 'bmp', 'so4', 'k', 'ch4_frac'))} FROM s""",
    "chain_outputs": f"WITH {_chain_sql(_ENDS, [0, 1, 2], False)} SELECT scenario_id, crop_year, round(annual_biomethane_nm3, 3) AS annual_biomethane_nm3, round(capacity_factor_annual, 8) AS capacity_factor_annual, round(unit_cost, 8) AS unit_cost, months_infeasible FROM y",
    "elasticities": f"WITH {_chain_sql(_MOVED, [0, *[n for n, _, _ in STEPS]], True)}, {_LONG}, st(scenario_id, param, sign) AS (VALUES {_rows(STEPS)}) SELECT a.output, param, sign, round((a.y - b.y) / nullif(b.y, 0) / (sign * {REL_STEP}e0), 6) AS elasticity FROM yl a JOIN st USING (scenario_id) JOIN yl b ON b.output = a.output AND b.scenario_id = 0",
    "morris_indices": f"WITH {_EFFECTS} SELECT output, factor, {', '.join(f'round({c}, 5) AS {c}' for c in ('mu', 'mu_star', 'sigma', 'mu_star_conf', 'mu_star_rel'))}, rank FROM ef",
    "screening_priority": f"""WITH {_EFFECTS}, b AS (SELECT factor, max(round(mu_star_rel, 9)) AS r FROM ef WHERE output <> 'months_infeasible' GROUP BY 1)
        SELECT row_number() OVER (ORDER BY r DESC, factor) AS rank, factor, round(r, 6) AS max_mu_star_rel, (SELECT max(output) FROM ef WHERE ef.factor = b.factor AND output <> 'months_infeasible' AND round(mu_star_rel, 9) = r) AS output FROM b""",
    "anchor_comparison": f"""WITH {_chain_sql([(0, 'opex_epe', 0.15)], [0], False)}, an(anchor_id, low, high, unit) AS (VALUES {_rows(ANCHORS)}), v AS (SELECT crop_year, an.*, CASE WHEN starts_with(unit, 'US$ per MMBtu') THEN unit_cost / 5.4e0 / 39.8e0 * 1055.05585e0 WHEN starts_with(unit, 'R$ per m3') THEN unit_cost END AS v FROM y, an)
        SELECT crop_year, anchor_id, low, high, unit, round(v, 7) AS engine_value, v BETWEEN low AND high AS within_range FROM v""",
    "cost_parts": """WITH o AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS q, sum(l_extendedprice)::DOUBLE AS p, sum(l_tax)::DOUBLE AS t FROM lineitem GROUP BY 1), c AS (SELECT *, q - 60 AS e, 0.08e0 * pow(1.08e0, 15) / (pow(1.08e0, 15) - 1) AS f FROM o),
        d AS (SELECT l_orderkey, p * f / e AS investment, p * 0.0317e0 / e + 0.10000013e0 AS operation, q * 2 / e AS feedstock, t * 5 / e AS transport, q * 0.5e0 / e AS coproduct, e FROM c)
        SELECT l_orderkey, """ + ", ".join(f"CASE WHEN e > 0 THEN round({x}, 6) END AS {c}" for c, x in [*[(c, c) for c in ("investment", "operation", "feedstock", "transport", "coproduct")], ("total", "investment + operation + feedstock + transport - coproduct")]) + " FROM d",
}
