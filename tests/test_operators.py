import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from sucrogas.operators import calibrate, economics, process, quality, sensitivity, siting, spatial, supply
from sucrogas.operators.ranks import spread_rank, value_ranks, weighted_quantiles
from sucrogas.plans import chain, extras, jobs, loading, places


def test_reference_case(spark):
    """1e6 t of cane: 7.48e6 Nm3 of biomethane, capacity factor 0.658, unit cost 1.98."""
    seasons = spark.createDataFrame([("m", 2024, 1e6)], "mill_id string, crop_year int, cane_t double")
    res = supply.monthly_residues(seasons, chain.COEFFICIENTS, {"vinasse": 1.0, "cake": 1.0, "straw": 0.0})
    feed = supply.to_feed(res, chain.KEYS, 1.0)
    sub = chain.substrates(spark)
    loads = process.monthly_loads(feed, sub, chain.KEYS)
    peak = 7.48e6 * 1.0 / 8 / 30
    months = process.with_gas(process.with_digester(loads, chain.KEYS, 3.0, 30.0), x_ch4=0.6, bmp_fullscale=0.85)
    b = process.mass_balance(months, nameplate=1e9, recovery=0.99)
    r = b.agg(F.sum("biomethane_nm3").alias("a"), F.max("biomethane_nm3_d").alias("d")).first()
    assert r.a == pytest.approx(7.48e6, rel=2e-3) and r.d == pytest.approx(peak, rel=2e-3)
    assert r.a / (r.d * 365) == pytest.approx(0.658, abs=1e-3)
    cost = spark.range(1).select(economics.annuity_cost(F.lit(3735.0 * r.d), F.lit(r.a), F.lit(0.1), F.lit(20), F.lit(0.0), F.lit(0.15)).alias("c"), economics.crf(F.lit(0.1), F.lit(20)).alias("f")).first()
    assert cost.c == pytest.approx(1.98, abs=0.01) and cost.f == pytest.approx(0.117460, abs=1e-6)


def test_refusals(spark):
    for bad in ({13: 1.0}, {1: -0.5, 2: 1.5}, {1: 0.5}):
        with pytest.raises(ValueError):
            supply.season_months(F.lit(2024), bad)


def test_storage_conserves_mass(spark):
    seasons = spark.createDataFrame([(i, 2024, 1000.0 * i) for i in range(1, 4)], "mill_id int, crop_year int, cane_t double")
    res = supply.monthly_residues(seasons, chain.COEFFICIENTS, chain.TO_AD)
    s = supply.storage(res, chain.KEYS, 0.4, [8, 9, 10, 11], {12: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}, 0.03)
    g = s.groupBy("mill_id").agg(*[F.sum(c).alias(c) for c in ("stored_t", "released_t", "lost_t")], F.max_by("stock_t", "month").alias("end")).collect()
    assert all(abs(r.stored_t - r.released_t - r.lost_t - r.end) < 1e-9 and abs(r.end) < 1e-9 for r in g)


def test_pairs_within_brute(spark):
    rng = np.random.default_rng(0)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-25, -20, 60), rng.uniform(-53, -45, 60), strict=True))]
    df = spark.createDataFrame([*a, (99, None, 1.0)], "i int, lat double, lon double")
    got = {(r.i, r.j) for r in spatial.pairs_within(df, df.withColumnRenamed("i", "j"), "i", "j", 80.0).collect()}

    def km(p, q):
        la, lb = math.radians(p[1]), math.radians(q[1])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * spatial.EARTH_KM * math.asin(math.sqrt(h))

    assert got == {(p[0], q[0]) for p in a for q in a if km(p, q) <= 80}


def naive_greedy(w, s, q_min, most):
    best, steps, left = np.zeros(w.shape[0]), [], set(range(w.shape[1]))
    while len(steps) < most and left:
        g = {j: round(float((np.maximum(w[:, j] - best, 0) * s).sum()), 9) for j in left}
        j = min(g, key=lambda x: (-g[x], x))
        if g[j] <= 0 or g[j] < q_min:
            break
        best = np.maximum(best, w[:, j])
        steps.append(j)
        left.discard(j)
    return steps


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_equals_naive(spark, seed):
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((25, 10)) < 0.4, rng.random((25, 10)), 0.0)
    s = rng.lognormal(size=25)
    e = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(25) for j in range(10) if w[i, j] > 0], "i int, j int, w double")
    sup = spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "i int, s double")
    got = [r.hub for r in siting.greedy_coverage(e, sup, 0.5, 6).orderBy("step").collect()]
    assert got == naive_greedy(w, s, 0.5, 6)


def test_greedy_fixed_and_target(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)], "i int, j int, w double")
    sup = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i int, s double")
    t = siting.greedy_coverage(e, sup, 0.0, 9, target_share=0.6, fixed=[0]).orderBy("step").collect()
    assert [(r.hub, r.fixed) for r in t] == [(0, True), (2, False)]


def test_coverage_curve_reaches_every_share(spark, tmp_path):
    """More than six hubs are needed for 20 and 30 %; the steps are those of a naive greedy over all suppliers."""
    d = str(tmp_path)
    spark.createDataFrame([(i, i % 25, "BUILDING", 1000.0 + i * 37 % 500) for i in range(1, 401)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(j, j % 25, 1.0) for j in range(1, 81)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    s = np.array([1000.0 + i * 37 % 500 for i in range(1, 401)])
    w = np.zeros((400, 80))
    for r in places.edges(spark, d).collect():
        w[r.i - 1, r.j - 1] = r.w
    hubs = naive_greedy(w, s, 1000.0, 80)
    share = [w[:, hubs[:k]].max(axis=1) @ s / s.sum() for k in range(1, len(hubs) + 1)]
    want = [next(k for k, x in enumerate(share, 1) if x >= t) for t in (0.1, 0.2, 0.3)]
    assert want[2] > 6 and list(loading.coverage_curve(spark, d).first()) == want


def test_spaced_selection_naive(spark):
    pts = [(i, float(i % 7) * 0.3 - 22, float(i // 7) * 0.3 - 47, (i * 5) % 23) for i in range(40)]
    df = spark.createDataFrame(pts, "k int, lat double, lon double, r int")
    got = [r.k for r in siting.spaced_selection(df, "k", "r", 50.0, 5).orderBy("pick").collect()]
    picked = []
    for p in sorted(pts, key=lambda x: (x[3], x[0])):
        far = all(math.hypot((p[1] - q[1]) * 111.2, (p[2] - q[2]) * 111.2 * math.cos(math.radians(p[1]))) >= 50 for q in picked)
        if far and len(picked) < 5:
            picked.append(p)
    assert got == [p[0] for p in picked]


def test_fits_recover_parameters():
    t = np.array([0, 1, 2, 4, 7, 10, 14, 21, 28, 35.0])
    b0, k, r2 = calibrate.fit_first_order(t, 230 * (1 - np.exp(-0.15 * t)))
    assert b0 == pytest.approx(230, rel=1e-6) and k == pytest.approx(0.15, rel=1e-6) and r2 == pytest.approx(1)
    assert all(math.isnan(x) for x in calibrate.fit_first_order(t[:2], t[:2]))


def test_period_check_is_a_range_join(spark):
    m = spark.createDataFrame([("p", date(2024, i, 1), float(i)) for i in range(1, 7)], "k string, month date, value double")
    p = spark.createDataFrame([("p", "a", date(2024, 2, 1), date(2024, 4, 1), 18.0), ("p", "b", date(2024, 5, 1), date(2024, 8, 1), None)], "k string, period string, start date, end date, reported double")
    got = {r.period: (r.total, r.n_months, r.complete, r.ratio) for r in calibrate.period_check(m, p, "k").collect()}
    assert got == {"a": (9.0, 3, True, 0.5), "b": (11.0, 2, False, None)}


def test_trajectories_move_one_factor():
    t = sensitivity.trajectories(4, 6, 4, 3)
    assert len(t) == 30 and t == sensitivity.trajectories(4, 6, 4, 3)
    for (a, s, x), (b, r, y) in zip(t, t[1:], strict=False):
        if a == b:
            d = np.abs(np.array(x) - np.array(y))
            assert r == s + 1 and (d > 1e-9).sum() == 1 and abs(d.max() - 2 / 3) < 1e-9
        assert min(x) >= -1e-9 and max(x) <= 1 + 1e-9


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "node string, depends_on string")
    got = {(r.node, r.steps) for r in quality.closure(e, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_spread_rank_is_a_rank(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").alias("g"), (F.col("id") % 7).alias("w"))
    out = spread_rank(df, ["g"], F.xxhash64("id"), 5, weight="w").toPandas()
    for _, part in out.groupby("g", dropna=False):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(len(part))) and list(part["before"]) == [0, *part["w"].cumsum()[:-1]]


def test_value_ranks_brute(spark):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(rng.integers(0, 40, 300))] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for r in value_ranks(df, ["g"], "v").collect():
        same = [v for g, v in rows if g == r.g and v is not None]
        assert r.rank == 1 + sum(v > r.v for v in same) and r.upto == sum(v >= r.v for v in same) and r.n == same.count(r.v)
    assert value_ranks(df.limit(0), ["g"], "v").collect() == []


def repeated_places(spark, d):
    """240 customers and 30 suppliers at 60 and 15 places: keys 40,000 apart have the same coordinates."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    spark.createDataFrame([(k % 60 + 40000 * (k // 60), k % 25, segments[k * 7 % 5], 500.0 + k * 37 % 900) for k in range(240)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k % 15 + 40000 * (k // 15), k % 25, 1.0) for k in range(30)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    customers = [(r["c_custkey"], r["s"], r["c_mktsegment"]) for r in places.customers(spark, d).collect()]
    suppliers = [r["s_suppkey"] for r in places.suppliers(spark, d).collect()]

    def km(i, j):
        (la, lo), (lb, lp) = (((-25 + k * 7919 % 5000 / 1000), (-53 + k * 104729 % 8000 / 1000)) for k in (i, j))
        la, lb = math.radians(la), math.radians(lb)
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(lp - lo) / 2) ** 2
        return 2 * spatial.EARTH_KM * math.asin(math.sqrt(h))

    return customers, suppliers, {(i, j): km(i, j) for i, _, _ in customers for j in suppliers}


def weight(km):
    return 1.0 if km <= 30 else max(0.0, (90 - km) / 60)


def test_decay_weights_measure_a_place_once(spark, tmp_path, monkeypatch):
    """Four customers and two suppliers at every place: one distance for eight pairs, and lists of keys that stay short."""
    customers, suppliers, km = repeated_places(spark, str(tmp_path))
    want = sorted((i, j, round(weight(x), 8)) for (i, j), x in km.items() if weight(x) > 0)
    assert len(want) % 8 == 0 and places.place_edges(spark, str(tmp_path)).count() == len(want) // 8
    for most in (10_000, 3):
        monkeypatch.setattr(spatial, "KEYS_PER_LIST", most)
        got = sorted((r.i, r.j, r.w) for r in places.decay_weights(spark, str(tmp_path)).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(g[2] == pytest.approx(w[2], abs=1e-8) for g, w in zip(got, want, strict=True))


def test_polyconic_quantiles_count_places(spark, tmp_path):
    """The quantiles of all pairs, though each pair of places is measured once; the weighted ones equal those of the repeated rows."""
    _, _, km = repeated_places(spark, str(tmp_path))

    def xy(k):
        p, dl = math.radians(-25 + k * 7919 % 5000 / 1000), math.radians(-53 + k * 104729 % 8000 / 1000 + 49)
        return math.sin(dl * math.sin(p)) / math.tan(p), p + (1 - math.cos(dl * math.sin(p))) / math.tan(p)

    ratios = {}
    for (i, j), x in km.items():
        if 0.001 < x <= 300:
            ratios.setdefault(int(x // 100), []).append(math.dist(xy(i), xy(j)) * spatial.EARTH_KM / x)
    got = {r["class"]: r for r in extras.polyconic_distortion(spark, str(tmp_path)).collect()}
    assert set(got) == set(ratios)
    for c, r in got.items():
        assert r.n == len(ratios[c]) and [r.p05, r.p50, r.p95] == pytest.approx(list(np.quantile(ratios[c], [0.05, 0.5, 0.95])), abs=2e-8)
    rows = [("a" if i % 3 else None, 1.0 + (i * 37 % 101) * 1e-9, i % 4 + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    for r in weighted_quantiles(df, ["g"], "v", "w", {"p10": 0.1, "p50": 0.5}).collect():
        every = [v for g, v, w in rows if g == r.g for _ in range(w)]
        assert r.n == len(every) and [r.p10, r.p50] == pytest.approx(list(np.quantile(every, [0.1, 0.5])), abs=1e-15)


def test_bound_and_breakdown_by_places(spark, tmp_path, monkeypatch):
    """Hubs and sources at one place are paired once, yet all are counted; ties of weight and step go to the lowest hub."""
    d = str(tmp_path)
    customers, suppliers, km = repeated_places(spark, d)
    paired = []
    plain = places.between_places
    monkeypatch.setattr(places, "between_places", lambda c, hubs, *cols: paired.append((c.count(), hubs.count())) or plain(c, hubs, *cols))
    q = {j: sum(weight(km[i, j]) * s for i, s, _ in customers) for j in suppliers}
    viable = [j for j in suppliers if q[j] >= 5000]
    covered = sum(s * max([weight(km[i, j]) for j in viable], default=0.0) for i, s, _ in customers)
    r = places.coverage_upper_bound(spark, d).first()
    assert 0 < len(viable) < 30 and r.hubs == len(viable) and r.covered == pytest.approx(covered, abs=2e-3)
    want = {j: {} for j in suppliers}
    for i, s, segment in customers:
        w, _, j = min((-weight(km[i, j]), j * 31 % 997, j) for j in suppliers)
        if w:
            want[j][segment] = want[j].get(segment, 0.0) - w * s
    for r in loading.hub_breakdown(spark, d).collect():
        if not r.withheld:
            assert all(r[f"v_{x.lower()}"] == pytest.approx(want[r.hub].get(x, 0.0), abs=1e-3) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    assert len(paired) >= 4 and all(c <= 60 and hubs <= 15 for c, hubs in paired)


def test_huff_posterior_by_places(spark, tmp_path, monkeypatch):
    """Mills of one place share its amount: the posterior is that of all customers and suppliers, though edges join places only."""
    customers, suppliers, km = repeated_places(spark, str(tmp_path))
    paired = []
    plain = spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda a, b, *rest: paired.append((a.count(), b.count())) or plain(a, b, *rest))

    def amounts(beta):
        out = dict.fromkeys(suppliers, 0.0)
        for i, s, _ in customers:
            e = {j: math.exp(-beta * km[i, j]) for j in suppliers if km[i, j] <= 100}
            for j, x in e.items():
                out[j] += s * x / sum(e.values())
        return out

    true = amounts(0.05)
    got = {r.beta: r for r in extras.huff_posterior(spark, str(tmp_path)).collect()}
    for beta in extras.BETAS:
        now = amounts(beta)
        want = -0.5 * sum((math.log(now[j] / true[j]) / 0.2) ** 2 for j in suppliers if true[j] > 0)
        assert got[beta].log_posterior == pytest.approx(want, abs=1e-5) and got[beta].best == (beta == 0.05)
    assert paired and all(c <= 60 and m <= 15 for c, m in paired)


def test_allowed_pairs_by_places(spark, tmp_path, monkeypatch):
    """The rule is asked for lists of one place and route or kind, before any pair is written out: no join on a customer or supplier is left."""
    customers, suppliers, km = repeated_places(spark, str(tmp_path))
    allowed = set(jobs._ALLOWED)
    free = {"AUTOMOBILE", "HOUSEHOLD"}
    want = sorted((i, j) for i, _, x in customers for j in suppliers if weight(km[i, j]) > 0 and (x in free or (x, f"k{j % 3}") in allowed))
    out = jobs.allowed_pairs(spark, str(tmp_path))
    assert sorted((r.i, r.j) for r in out.collect()) == want
    assert all(r.w == pytest.approx(weight(km[r.i, r.j]), abs=1e-8) for r in out.collect())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_hub_coverage_by_places(spark, tmp_path, monkeypatch):
    """Steps, gains and shares are those of all allowed pairs, though every step pairs places only."""
    customers, suppliers, km = repeated_places(spark, str(tmp_path))
    paired = []
    plain = places.between_places
    monkeypatch.setattr(places, "between_places", lambda c, hubs, *cols: paired.append(c.count()) or plain(c, hubs, *cols))
    go = lambda x, j: x in ("AUTOMOBILE", "HOUSEHOLD") or (x, f"k{j % 3}") in jobs._ALLOWED
    w = np.array([[weight(km[i, j]) if go(x, j) else 0.0 for j in suppliers] for i, _, x in customers])
    s = np.array([x for _, x, _ in customers])
    order = np.argsort(suppliers)
    hubs = [suppliers[order[k]] for k in naive_greedy(w[:, order], s, 3000.0, 8)]
    rows = jobs.hub_coverage(spark, str(tmp_path)).orderBy("step").collect()
    assert hubs and [r.hub for r in rows] == hubs
    at = w[:, [suppliers.index(j) for j in hubs]]
    won = np.where(at.max(axis=1) > 0, at.argmax(axis=1), -1)
    for k, r in enumerate(rows):
        assert r.sources == (won == k).sum() and (r.withheld or r.supply == pytest.approx((at[:, k] * s)[won == k].sum(), abs=2e-3))
    assert paired and max(paired) <= 60
