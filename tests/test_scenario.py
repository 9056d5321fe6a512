import numpy as np
import pytest
from pyspark.sql import functions as F

from sucrogas.operators import economics, scenario, siting, spatial
from sucrogas.operators.ranks import quantiles
from sucrogas.plans import screening


def params(spark, change=None, scenarios=(0,)):
    rows = [(s, i, (change or {}).get((s, i), c), lo, hi, t) for s in scenarios for i, c, lo, hi, t in screening.PARAMS]
    return spark.createDataFrame(rows, "scenario_id int, id string, central double, low double, high double, central_text string")


def test_chain_from_parameters_is_the_reference_case(spark):
    """A million tonnes of cane without straw: the published volume and capacity factor come out of the table's central values."""
    cases = spark.createDataFrame([("m", 2024, 1e6)], "mill string, crop_year int, cane_t double")
    p = params(spark)
    ad = {"vinasse": 1.0, "cake": 1.0, "straw": 0.0}
    sized = scenario.with_peak_nameplate(cases, p, ["mill", "crop_year"], ad, recovery=0.99)
    y = scenario.outputs(scenario.run_chain(sized, p, [0], ["mill", "crop_year"], ad, recovery=0.99), ["mill", "crop_year"]).first()
    assert y.annual_biomethane_nm3 == pytest.approx(7.48e6, rel=2e-2) and y.capacity_factor_annual == pytest.approx(0.658, abs=0.02)
    assert y.unit_cost == pytest.approx(1.98, abs=0.06)


def test_scenarios_do_not_mix(spark):
    cases = spark.createDataFrame([("m", 2024, 1e6, None), ("n", 2024, 2e6, 1000.0)], "mill string, crop_year int, cane_t double, nameplate double")
    p = params(spark, {(1, "vin_cod"): 60.0, (2, "plant_life"): 20.5}, (0, 1, 2))
    keys = ["mill", "crop_year"]
    y = {(r.scenario_id, r.mill): r for r in scenario.outputs(scenario.run_chain(cases, p, [0, 1, 2, 7], keys, screening.TO_AD), keys).collect()}
    assert len(y) == 6  # a scenario without parameters has no rows
    alone = {(r.scenario_id, r.mill): r for r in scenario.outputs(scenario.run_chain(cases, p.where("scenario_id = 1"), [1], keys, screening.TO_AD), keys).collect()}
    assert alone[1, "m"] == y[1, "m"] and y[1, "m"].annual_biomethane_nm3 > y[0, "m"].annual_biomethane_nm3 == y[2, "m"].annual_biomethane_nm3
    assert y[0, "n"].annual_biomethane_nm3 == pytest.approx(1000.0 * 244) and y[0, "n"].unit_cost is not None and y[2, "n"].unit_cost is None  # eight months at the nameplate; no whole lifetime, no cost
    missing = p.where("NOT (scenario_id = 0 AND id = 'vin_cod')")
    for r in scenario.outputs(scenario.run_chain(cases, missing, [0], keys, screening.TO_AD), keys).collect():
        assert r.annual_biomethane_nm3 is None and r.unit_cost is None and r.capacity_factor_annual is None
    assert y[0, "m"].capacity_factor_annual is None and y[0, "m"].unit_cost is None  # no nameplate


def test_effects_of_a_linear_function(spark):
    factors = [("a", 0.0, 2.0), ("b", 10.0, 20.0)]
    plan, values = scenario.screening_overrides(factors, 5, 4, 1)
    at = {}
    for n, i, v in values:
        at.setdefault(n, {})[i] = v
    ys = [(n, 3 * x["a"] - 0.5 * x["b"], 0.0, x["a"] ** 2, 0.0) for n, x in at.items()]
    results = spark.createDataFrame(ys, "scenario_id int, annual_biomethane_nm3 double, capacity_factor_annual double, unit_cost double, months_infeasible double")
    moves, before = [], None
    for n, t, s in plan:
        if s:
            d = {i: (at[n][i] - before[i]) / (hi - lo) for i, lo, hi in factors}
            f = max(d, key=lambda k: abs(d[k]))
            moves.append((t, s, f, d[f]))
        before = at[n]
    draws = [(r, t) for r in range(4) for t in range(5)]
    e = scenario.elementary_effects(
        results, spark.createDataFrame(plan, "scenario_id int, trajectory int, step int"), spark.createDataFrame(moves, "trajectory int, step int, factor string, delta double"),
        spark.createDataFrame([(1, 4.0, 0.0, 1.0, 0.0)], results.schema), spark.createDataFrame(draws, "resample int, trajectory int"),
    )
    got = {(r.output, r.factor): r for r in e.collect()}
    assert got["annual_biomethane_nm3", "a"].mu == pytest.approx(6.0) and got["annual_biomethane_nm3", "b"].mu == pytest.approx(-5.0) and got["annual_biomethane_nm3", "b"].mu_star_rel == pytest.approx(1.25)
    assert got["annual_biomethane_nm3", "a"].sigma == pytest.approx(0.0, abs=1e-9) and got["annual_biomethane_nm3", "a"].rank == 1 and got["unit_cost", "b"].mu_star == 0 and got["capacity_factor_annual", "a"].mu_star_rel is None
    assert [r.factor for r in scenario.priority(e).orderBy("rank").collect()] == ["a", "b"]


def test_costs(spark):
    df = spark.createDataFrame([(100.0, 10.0), (100.0, 0.0), (-1.0, 5.0), (None, 5.0)], "i double, e double")
    c = economics.unit_cost(F.col("i"), F.col("e"), F.lit(0.0), F.lit(10), fixed=F.lit(5.0), variable=F.lit(0.25), feedstock=F.lit(-2.0), transport=F.lit(1.0), coproduct=F.lit(4.0))
    got = [r[0] for r in df.select(c["total"]).collect()]
    assert got[0] == pytest.approx(1.0 + 0.5 + 0.25 - 0.2 + 0.1 - 0.4) and got[1] is None and got[2] is None and got[3] is None
    one = spark.createDataFrame([(1, 2.0)], "k int, cost double")
    a = {r.anchor_id: (r.engine_value, r.within_range) for r in economics.against_anchors(one, "k", "cost", [("m", 1.0, 3.0, "R$ per m3"), ("u", 8.0, 9.0, "US$ per MMBtu"), ("x", 1.0, 3.0, "R$ per kg")], 39.8, None).collect()}
    assert a == {"m": (2.0, True), "u": (None, None), "x": (None, None)}


def test_quantiles_are_those_of_percentile(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 500)] + [("b", 1.5), (None, 2.0), (None, 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: (r.p[0], r.p[1], r.p[2]) for r in df.where("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.93))).alias("p")).collect()}
    got = {r.g: (r.x, r.y, r.z) for r in quantiles(df, ["g"], "v", {"x": 0.1, "y": 0.5, "z": 0.93}).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert quantiles(df.limit(0), [], "v", {"x": 0.5}).collect() == []


def test_ranks_of_draws_do_not_depend_on_the_way(spark, monkeypatch):
    df = spark.createDataFrame([(i, (i * 7 % 11) / 11, (i * 5 % 13) / 13) for i in range(40)] + [(99, None, 0.1)], "k int, n_a double, n_b double")
    draws = siting.weight_draws(["a", "b"], 30, 3.0, 1)
    one = sorted(map(tuple, siting.weight_sensitivity(df, "k", ["a", "b"], draws, 5).collect()))
    monkeypatch.setattr(siting, "ROWS_PER_WINDOW", 0)
    assert one == sorted(map(tuple, siting.weight_sensitivity(df, "k", ["a", "b"], draws, 5).collect())) and len(one) == 40


def test_small_siting_operators(spark):
    m = spark.createDataFrame([("o", 1.0, float("nan"), 9.0), ("p", None, 2.0, 3.0)], "o string, x double, y double, z double")
    assert sorted(map(tuple, siting.pairs_from_matrix(m, "o", ["x", "y", "z"], 3.0).collect())) == [("o", "x", 1.0), ("p", "y", 2.0), ("p", "z", 3.0)]
    c = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    assert sorted((r.v or "", r.code) for r in siting.factor_codes(c, "v").collect()) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]
    e = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "i int, j int, w double")
    r, k = spark.createDataFrame([(1, "straw"), (2, " ")], "i int, route string"), spark.createDataFrame([(1, "x"), (2, "y")], "j int, kind string")
    assert sorted((x.i, x.j) for x in siting.allowed_pairs(e, r, k, [("straw", "y")]).collect()) == [(1, 2), (2, 1)]
    assert sorted((x.i, x.j) for x in siting.allowed_pairs(e, r, k, []).collect()) == [(2, 1)]
    with pytest.raises(ValueError):
        spatial.fallback_road_km(F.lit(1.0), 0.9)
