from datetime import date

from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.operators import calibrate, quality, siting


def test_pruned_hubs_hand_their_sources_on(spark):
    e = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (2, 1, 1.0), (3, 2, 1.0), (3, 3, 0.9), (4, 3, 1.0), (5, 9, 1.0), (6, None, None)], "i int, j int, w double")
    s = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 4.0), (4, 5.0), (5, 1.0)], "i int, s double")
    hubs = spark.createDataFrame([(1, 1, False), (2, 2, False), (3, 3, False), (4, 9, True)], "step int, hub int, fixed boolean")
    got = {r.hub: (r.closed, round(r.supply, 3), r.sources) for r in siting.prune_hubs(e, s, hubs, 5.5).collect()}
    assert got == {1: (False, 20.0, 2), 2: (True, 0.0, 0), 3: (False, 8.6, 2), 9: (False, 1.0, 1)}  # hub 2 goes first and lifts hub 3 over the bound; the fixed one stays
    assert all(r.closed for r in siting.prune_hubs(e, s, hubs.where("NOT fixed"), 99.0).collect()) and siting.prune_hubs(e, s, hubs.limit(0), 1.0).collect() == []
    a = siting.allocate(e, hubs)
    assert tuple(siting.cells_behind(a, s, hubs.where("hub IN (1, 9)")).first()) == (3, 21.0) and tuple(siting.cells_behind(a, s, hubs.limit(0)).first()) == (0, 0.0)
    bad = spark.createDataFrame([(1, 1, 1.0), (1, 1, 0.2), (2, 1, 1.2), (2, 2, None), (3, 3, 0.0)], "i int, j int, w double")
    assert sorted((r.i, r.j, r.issue) for r in siting.edge_issues(bad).collect()) == [(1, 1, "repeated"), (2, 1, "no weight in [0, 1]"), (2, 2, "no weight in [0, 1]")]
    trace = spark.createDataFrame([(1, 9, True, 5.0, 5.0), (2, 1, False, 3.0, 8.0), (3, 2, False, 2.0, 10.0)], "step int, hub int, fixed boolean, gain double, covered double")
    assert tuple(siting.hubs_for_share(trace, 10.0, [0.5, 0.8, 1.0, 2.0]).first()) == (0, 1, 2, None)


def test_totals_on_both_sides(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    totals = spark.createDataFrame([("a", 3.0), ("c", 1.0)], "k string, t double")
    assert {(r.k, r.n, r.ok) for r in quality.against_totals(rows, ["k"], "v", totals, "t", 0.01).collect()} == {("a", 2, True), ("b", 1, False), ("c", 0, False)}


def test_key_values(spark):
    df = spark.createDataFrame([("a=1; b = x=y ;a=3",), ("none",), ("",), (None,), ("=1",)], "t string")
    assert [r[0] for r in df.select(text.key_values(F.col("t"))).collect()] == [{"a": "3", "b": "x=y"}, {}, {}, None, {}]


def test_shares_and_controls(spark):
    sim = spark.createDataFrame([("p", date(2024, m, 1), 1.0) for m in range(1, 13)] + [("q", date(2024, 1, 1), None)], "k string, month date, sim double")
    obs = spark.createDataFrame([("p", date(2024, m, 1), 0.0 if m < 4 else 2.0) for m in range(1, 13)] + [("q", date(2024, 1, 1), 1.0)], "k string, month date, obs double")
    r = calibrate.off_season_shares(sim, obs, ["k"], [1, 2, 3, 12]).collect()
    assert [(x.k, round(x.sim_share, 6), round(x.obs_share, 6)) for x in r] == [("p", round(4 / 12, 6), round(2 / 18, 6))]
    v = spark.createDataFrame([("c", 380.0), ("s", 200.0), ("c", None)], "role string, final_mean double")
    assert [(x.recovery, x.ok_control) for x in calibrate.control_recovery(v, F.col("role") == "c", 400.0, 0.85, 1.0).collect()] == [(0.95, True), (None, None), (None, None)]
