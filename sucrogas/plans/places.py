"""Spatial and siting queries.  Binding: customers and suppliers get coordinates from their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.operators import siting, spatial
from sucrogas.session import table


def _lat(k: str) -> Column:
    return -25 + (F.col(k) * 7919 % 5000) / 1000


def _lon(k: str) -> Column:
    return -53 + (F.col(k) * 104729 % 8000) / 1000


_P = lambda k: f"-25 + ({k} * 7919 % 5000) / 1000e0 AS lat, -53 + ({k} * 104729 % 8000) / 1000e0 AS lon"
_HAV = "2 * 6371.0088e0 * asin(sqrt(least(pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2), 1e0)))"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", "c_nationkey", "c_mktsegment", F.greatest("c_acctbal", F.lit(0.0)).alias("s"), _lat("c_custkey").alias("lat"), _lon("c_custkey").alias("lon"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", _lat("s_suppkey").alias("lat"), _lon("s_suppkey").alias("lon"))


_C = f"c AS (SELECT c_custkey, c_nationkey, c_mktsegment, greatest(c_acctbal, 0e0) AS s, {_P('c_custkey')} FROM customer)"
_S = f"su AS (SELECT s_suppkey, s_nationkey, s_acctbal, {_P('s_suppkey')} FROM supplier)"
_D = _HAV.format(a="c.", b="su.")


def pairs_within_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spatial.pairs_within(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 60.0)
    return p.select("c_custkey", "s_suppkey", F.round("km", 6).alias("km"))


def detour_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spatial.pairs_within(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 25.0)
    road = F.col("km") * (1.2 + (F.col("c_custkey") % 7) / 20)
    return p.select("c_custkey", "s_suppkey", F.round(road, 6).alias("road_km"), F.round(F.try_divide(road, F.col("km")), 9).alias("detour"))


def sphere_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = spatial.sphere_xyz_m(F.col("lat"), F.col("lon"))
    return suppliers(spark, sf_dir).select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


def _metric(df: DataFrame, key: str, value: str | None) -> DataFrame:
    cols = [F.col(value).alias("v")] if value else []
    return df.select(key, *cols, ((F.col(key) * 104729) % 300000).cast("double").alias("x"), ((F.col(key) * 7919) % 300000).cast("double").alias("y"))


def disc_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = _metric(customers(spark, sf_dir), "c_custkey", "s")
    q = _metric(suppliers(spark, sf_dir), "s_suppkey", None)
    return spatial.disc_sums(src, q, "s_suppkey", "v", 30000.0, 1000.0).select("s_suppkey", F.round("disc_sum", 4).alias("disc_sum"))


def catchment_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catchment sums per state group with the small-count rule."""
    src = _metric(customers(spark, sf_dir), "c_custkey", "s").withColumn("one", F.lit(1.0))
    q = _metric(suppliers(spark, sf_dir), "s_suppkey", None)
    v = spatial.disc_sums(src, q, "s_suppkey", "v", 8000.0, 1000.0)
    n = spatial.disc_sums(src, q, "s_suppkey", "one", 8000.0, 1000.0).withColumnRenamed("disc_sum", "n")
    j = v.join(n, "s_suppkey").select("s_suppkey", F.round("disc_sum", 4).alias("disc_sum"), F.col("n").cast("long").alias("n"))
    return siting.withhold_small(j, "n", ["disc_sum"], 3)


def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers inside the (rotated square) areas around nations."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("polygon_id"), (F.col("n_nationkey") * 37 % 80 / 10 - 53).alias("cx"), (F.col("n_nationkey") * 53 % 50 / 10 - 25).alias("cy"))
    corner = [(0.0, 0.75), (0.75, 0.0), (0.0, -0.75), (-0.75, 0.0)]
    sides = F.array(*[F.struct(F.lit(a[0]).alias("ax"), F.lit(a[1]).alias("ay"), F.lit(b[0]).alias("bx"), F.lit(b[1]).alias("by")) for a, b in zip(corner, corner[1:] + corner[:1], strict=True)])
    e = n.select("polygon_id", "cx", "cy", F.explode(sides).alias("e")).select(
        "polygon_id", (F.col("cx") + F.col("e.ax")).alias("x1"), (F.col("cy") + F.col("e.ay")).alias("y1"), (F.col("cx") + F.col("e.bx")).alias("x2"), (F.col("cy") + F.col("e.by")).alias("y2")
    )
    pts = customers(spark, sf_dir).select("c_custkey", (F.col("lon") + 0.0003).alias("x"), (F.col("lat") + 0.0007).alias("y"))
    return spatial.points_in_polygons(pts, e, "c_custkey")


def class_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = customers(spark, sf_dir).select("lat", "lon", F.lit(0.001).alias("size_deg"), F.col("c_nationkey").alias("code"))
    return spatial.class_area(px, [1, 2, 3, 5, 8], 0.5).select("cell", "code", F.round("area_ha", 6).alias("area_ha"), "pixels")


_CRIT = {"p_retailprice": "lower", "p_size": "higher"}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_retailprice").alias("p_retailprice"), F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") % 11 == 0).alias("excluded"))


_PA = "pa AS (SELECT p_partkey, p_retailprice, p_size::DOUBLE AS p_size, p_partkey % 11 = 0 AS excluded FROM part)"
_LIN = f"""{_PA}, b AS (SELECT min(p_retailprice) AS l1, max(p_retailprice) AS h1, min(p_size) AS l2, max(p_size) AS h2 FROM pa WHERE NOT excluded),
 nn AS (SELECT p_partkey, excluded, 1 - greatest(0, least(1, (p_retailprice - l1) / (h1 - l1))) AS a, greatest(0, least(1, (p_size - l2) / (h2 - l2))) AS z FROM pa, b)"""


def suitability_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = siting.score(siting.normalize(_parts(spark, sf_dir), _CRIT, "linear", "excluded"), {"p_retailprice": 2.0, "p_size": 1.0}, "excluded")
    n = n.withColumn("score", F.round("score", 10))
    return siting.rank_scores(n, "score").select("p_partkey", F.round("n_p_retailprice", 9).alias("n_price"), F.round("n_p_size", 9).alias("n_size"), "score", "rank")


def suitability_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = siting.normalize(_parts(spark, sf_dir), _CRIT, "percentile", "excluded")
    return n.select("p_partkey", F.round("n_p_retailprice", 9).alias("n_price"), F.round("n_p_size", 9).alias("n_size"))


_DRAWS = siting.weight_draws(["p_retailprice", "p_size"], 1000, 3.0, 11)


def weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = siting.normalize(_parts(spark, sf_dir), _CRIT, "linear", "excluded").where("NOT excluded")
    w = siting.weight_sensitivity(n, "p_partkey", list(_CRIT), _DRAWS, 100)
    return w.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("rank_median", "rank_p05", "rank_p95", "p_top_k")])


def one_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = siting.normalize(_parts(spark, sf_dir), _CRIT, "linear", "excluded").where("NOT excluded")
    return siting.one_at_a_time(n, "p_partkey", {"p_retailprice": 0.6, "p_size": 0.4}, 0.25, 50).select("criterion", "sign", F.round("top_k_kept", 6).alias("top_k_kept"))


_OAT = [("base", 0, 0.6, 0.4)] + [(c, s, 0.6 * (1 + s * 0.25) if c == "p_retailprice" else 0.6, 0.4 * (1 + s * 0.25) if c == "p_size" else 0.4) for c in ("p_retailprice", "p_size") for s in (-1, 1)]


def quantile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return siting.quantile_gate(_parts(spark, sf_dir), "p_retailprice", 0.5, "excluded").select("p_partkey", "excluded")


def spaced_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = siting.rank_scores(suppliers(spark, sf_dir), "s_acctbal")
    return siting.spaced_selection(s, "s_suppkey", "rank", 120.0, 8)


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights between places instead of customers and suppliers; ``is`` and ``js`` list who is there."""
    c = spatial.listed_at_places(customers(spark, sf_dir), "c_custkey", "is")
    s = spatial.listed_at_places(suppliers(spark, sf_dir), "s_suppkey", "js")
    p = spatial.pairs_within(c, s, "c_custkey", "s_suppkey", 90.0, ["is"], ["js"])
    return p.select("is", "js", siting.decay_weight(F.col("km"), 30.0, 90.0).alias("w")).where("w > 0")


def between_places(c: DataFrame, hubs: DataFrame, c_with: list[str], hubs_with: list[str] | None = None) -> DataFrame:
    """Edges of the places of customers (``c_custkey``) and hubs (``j``): ``i``, ``j``, ``w`` > 0 and the columns that come along."""
    p = spatial.pairs_within(c, hubs, "c_custkey", "j", 90.0, c_with, hubs_with or [])
    # Beyond 90 km there is no pair, and at 90 km no weight.
    return p.withColumn("w", siting.decay_weight(F.col("km"), 30.0, 90.0)).where("w > 0").select(F.col("c_custkey").alias("i"), "j", "w", *c_with, *(hubs_with or []))


def each_pair(e: DataFrame) -> DataFrame:
    """``i``, ``j``, ``w`` of all pairs that the lists ``is`` and ``js`` stand for; whatever is computed before is computed once a place."""
    return e.select("is", F.explode("js").alias("j"), "w").select(F.explode("is").alias("i"), "j", "w")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_pair(place_edges(spark, sf_dir))


_E = f"{_C}, {_S}, d AS (SELECT c_custkey AS i, s_suppkey AS j, s, {_D} AS km FROM c, su), e AS (SELECT i, j, s, km, CASE WHEN km <= 30 THEN 1e0 ELSE (90e0 - km) / 60e0 END AS w FROM d WHERE km < 90)"


def decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each_pair(place_edges(spark, sf_dir).withColumn("w", F.round("w", 8)))


def _supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select(F.col("c_custkey").alias("i"), "s")


def coverage_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spatial.at_places(customers(spark, sf_dir), "c_custkey", F.sum("s").alias("s"))
    hubs = spatial.at_places(suppliers(spark, sf_dir), "s_suppkey").withColumnRenamed("s_suppkey", "j")
    covered, viable = siting.upper_bound_of(lambda some: between_places(c, some, ["s"]), hubs, 5000.0)
    number = viable.join(hubs, "j").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hubs"))
    return number.select(F.lit(1).alias("k"), "hubs").join(covered.select(F.lit(1).alias("k"), F.round("covered", 3).alias("covered")), "k").select("hubs", "covered")


def greedy_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = siting.greedy_coverage(edges(spark, sf_dir), _supply(spark, sf_dir), 5000.0, 6)
    return g.select("step", "hub", "fixed", F.round("gain", 4).alias("gain"), F.round("covered", 4).alias("covered"))


def hub_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources allocated to the hubs, with supply and distinct sources per hub."""
    hubs = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("hub"), (F.col("s_suppkey") * 31 % 997).alias("step"))
    a = siting.allocate(edges(spark, sf_dir), hubs).join(_supply(spark, sf_dir), "i")
    return a.groupBy("hub").agg(F.round(F.sum(F.col("w") * F.col("s")), 4).alias("supply"), F.count_distinct(F.when(F.col("w") * F.col("s") > 0, F.col("i"))).alias("n_sources"))


def huff_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spatial.pairs_within(customers(spark, sf_dir), suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 100.0)
    e = e.select(F.col("c_custkey").alias("cell"), F.col("s_suppkey").alias("mill"), "km")
    years = F.explode(F.array(F.lit(2020), F.lit(2021))).alias("year")
    mills = suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("mill"), (1000 + F.col("s_suppkey") * 17 % 500).cast("double").alias("capacity"), years)
    mills = mills.withColumn("active", ~((F.col("mill") % 5 == 0) & (F.col("year") == 2021)))
    cells = customers(spark, sf_dir).select(F.col("c_custkey").alias("cell"), F.col("s").alias("amount"), years)
    return siting.huff_allocation(e, mills, cells, 1.0, 0.05, 100.0).select("year", "mill", F.round("amount", 4).alias("amount"))


def greedy_sql(q_min: float, steps: int, share: float | None) -> str:
    """The greedy steps written out one by one."""
    stop = f"AND t{{k}}.covered < {share}e0 * (SELECT sum(s) FROM c)" if share else ""
    sql = f"WITH {_E}, ee AS MATERIALIZED (SELECT i, j, s, w FROM e WHERE w > 0), b0 AS (SELECT DISTINCT i, 0e0 AS b FROM ee), t0 AS (SELECT 0 AS step, -1::BIGINT AS hub, 0e0 AS gain, 0e0 AS covered)"
    for k in range(steps):
        sql += f""", g{k} AS MATERIALIZED (SELECT j, round(sum(greatest(w - b, 0) * s), 9) AS g FROM ee JOIN b{k} USING (i) WHERE j NOT IN ({' UNION ALL '.join(f'SELECT hub FROM t{x}' for x in range(k + 1))}) GROUP BY 1),
 t{k + 1} AS MATERIALIZED (SELECT {k + 1} AS step, j AS hub, g AS gain, t{k}.covered + g AS covered FROM g{k}, t{k} WHERE g > 0 AND g >= {q_min}e0 {stop.format(k=k)} ORDER BY g DESC, j LIMIT 1),
 b{k + 1} AS MATERIALIZED (SELECT b{k}.i, greatest(b, coalesce(w, 0)) AS b FROM b{k} LEFT JOIN (SELECT i, w FROM ee WHERE j = (SELECT hub FROM t{k + 1})) m USING (i))"""
    union = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(1, steps + 1))
    return sql + f", tr AS ({union}) SELECT step, hub, false AS fixed, round(gain, 4) AS gain, round(covered, 4) AS covered FROM tr"


QUERIES = {f.__name__: f for f in (
    pairs_within_km, detour_ratio, sphere_points, disc_sums, catchment_withheld, points_in_boxes, class_area, suitability_linear, suitability_percentile, weight_sensitivity,
    one_at_a_time, quantile_gate, spaced_sites, decay_weights, coverage_upper_bound, greedy_hubs, hub_allocation, huff_allocation,
)}
_DISC = lambda r, v: f"""sum(CASE WHEN pow(floor(c.x / 1000) - floor(q.x / 1000), 2) + pow(floor(c.y / 1000) - floor(q.y / 1000), 2) <= {r * r} THEN {v} ELSE 0 END)"""
_XY = "cc AS (SELECT greatest(c_acctbal, 0e0) AS v, c_custkey * 104729 % 300000 AS x, c_custkey * 7919 % 300000 AS y FROM customer), q AS (SELECT s_suppkey, s_suppkey * 104729 % 300000 AS x, s_suppkey * 7919 % 300000 AS y FROM supplier)"
SQL = {
    "pairs_within_km": f"WITH {_C}, {_S}, d AS (SELECT c_custkey, s_suppkey, {_D} AS km FROM c, su) SELECT c_custkey, s_suppkey, round(km, 6) AS km FROM d WHERE km <= 60",
    "detour_ratio": f"""WITH {_C}, {_S}, d AS (SELECT c_custkey, s_suppkey, {_D} AS km FROM c, su)
        SELECT c_custkey, s_suppkey, round(km * (1.2e0 + (c_custkey % 7) / 20e0), 6) AS road_km, CASE WHEN km > 0 THEN round(1.2e0 + (c_custkey % 7) / 20e0, 9) END AS detour FROM d WHERE km <= 25""",
    "sphere_points": f"""WITH {_S} SELECT s_suppkey, round(6371008.8e0 * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round(6371008.8e0 * cos(radians(lat)) * sin(radians(lon)), 3) AS y,
        round(6371008.8e0 * sin(radians(lat)), 3) AS z FROM su""",
    "disc_sums": f"WITH {_XY} SELECT s_suppkey, round({_DISC(30, 'v')}, 4) AS disc_sum FROM q, cc c GROUP BY 1",
    "catchment_withheld": f"""WITH {_XY}, t AS (SELECT s_suppkey, round({_DISC(8, 'v')}, 4) AS v, {_DISC(8, '1')}::BIGINT AS n FROM q, cc c GROUP BY 1)
        SELECT s_suppkey, CASE WHEN n > 0 AND n < 3 THEN NULL ELSE v END AS disc_sum, n, n > 0 AND n < 3 AS withheld FROM t""",
    "points_in_boxes": f"""WITH {_C}, n AS (SELECT n_nationkey AS polygon_id, n_nationkey * 37 % 80 / 10e0 - 53 AS cx, n_nationkey * 53 % 50 / 10e0 - 25 AS cy FROM nation)
        SELECT c_custkey, polygon_id FROM c, n WHERE abs(lon + 0.0003e0 - cx) + abs(lat + 0.0007e0 - cy) < 0.75e0""",
    "class_area": f"""WITH {_C} SELECT floor(lat / 0.5e0)::BIGINT::VARCHAR || '_' || floor(lon / 0.5e0)::BIGINT::VARCHAR AS cell, c_nationkey AS code,
        round(sum(pow(6371007.181e0, 2) * radians(0.001e0) * abs(sin(radians(lat)) - sin(radians(lat - 0.001e0))) / 10000), 6) AS area_ha, count(*) AS pixels
        FROM c WHERE c_nationkey IN (1, 2, 3, 5, 8) GROUP BY 1, 2""",
    "suitability_linear": f"""WITH {_LIN}, s AS (SELECT *, CASE WHEN NOT excluded THEN round(a * (2 / 3e0) + z * (1 / 3e0), 10) END AS sc FROM nn)
        SELECT p_partkey, round(a, 9) AS n_price, round(z, 9) AS n_size, sc AS score, CASE WHEN sc IS NOT NULL THEN rank() OVER (ORDER BY sc DESC NULLS LAST) END AS rank FROM s""",
    "suitability_percentile": f"""WITH {_PA} SELECT p_partkey,
        round(1 - ((SELECT count(*) FROM pa k WHERE NOT excluded AND k.p_retailprice < p.p_retailprice) + (SELECT count(*) FROM pa k WHERE NOT excluded AND k.p_retailprice <= p.p_retailprice)) / (2e0 * (SELECT count(*) FROM pa WHERE NOT excluded)), 9) AS n_price,
        round(((SELECT count(*) FROM pa k WHERE NOT excluded AND k.p_size < p.p_size) + (SELECT count(*) FROM pa k WHERE NOT excluded AND k.p_size <= p.p_size)) / (2e0 * (SELECT count(*) FROM pa WHERE NOT excluded)), 9) AS n_size
        FROM pa p""",
    "weight_sensitivity": f"""WITH {_LIN}, dr(draw, w0, w1) AS (VALUES {', '.join(f'({d}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for d, a, b in _DRAWS)}),
        r AS (SELECT p_partkey, rank() OVER (PARTITION BY draw ORDER BY round(a * w0 + z * w1, 12) DESC) AS r FROM nn, dr WHERE NOT excluded)
        SELECT p_partkey, round(quantile_cont(r, 0.5), 6) AS rank_median, round(quantile_cont(r, 0.05), 6) AS rank_p05, round(quantile_cont(r, 0.95), 6) AS rank_p95,
        round(avg(CASE WHEN r <= 100 THEN 1e0 ELSE 0 END), 6) AS p_top_k FROM r GROUP BY 1""",
    "one_at_a_time": f"""WITH {_LIN}, v(criterion, sign, w0, w1) AS (VALUES {', '.join(f"('{c}', {s}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for c, s, a, b in _OAT)}),
        r AS (SELECT criterion, sign, p_partkey, row_number() OVER (PARTITION BY criterion, sign ORDER BY round(a * (w0 / (w0 + w1)) + z * (w1 / (w0 + w1)), 12) DESC, p_partkey) AS r FROM nn, v WHERE NOT excluded)
        SELECT criterion, sign, round(sum(CASE WHEN p_partkey IN (SELECT p_partkey FROM r WHERE sign = 0 AND r <= 50) THEN 1 ELSE 0 END) / 50e0, 6) AS top_k_kept
        FROM r WHERE sign <> 0 AND r <= 50 GROUP BY 1, 2""",
    "quantile_gate": f"WITH {_PA} SELECT p_partkey, excluded OR p_retailprice < (SELECT quantile_cont(p_retailprice, 0.5) FROM pa WHERE NOT excluded) AS excluded FROM pa",
    "spaced_sites": f"""WITH RECURSIVE {_S}, km AS (SELECT su.s_suppkey AS a, c.s_suppkey AS b FROM su, su c WHERE {_D} < 120), r AS (SELECT 0 AS pick, []::BIGINT[] AS keys UNION ALL
        SELECT pick + 1, list_append(keys, x.k) FROM r, LATERAL (SELECT arg_max(s_suppkey, s_acctbal * 1e6 - s_suppkey / 1e6) AS k FROM su WHERE NOT EXISTS (SELECT 1 FROM km WHERE km.a = su.s_suppkey AND list_contains(r.keys, km.b)) AND NOT list_contains(r.keys, su.s_suppkey)) x
        WHERE pick < 8 AND x.k IS NOT NULL) SELECT pick, keys[pick]::BIGINT AS s_suppkey FROM (SELECT unnest(range(1, len(keys) + 1)) AS pick, keys FROM r WHERE pick = (SELECT max(pick) FROM r))""",
    "greedy_hubs": greedy_sql(5000.0, 6, None),
    "decay_weights": f"WITH {_E} SELECT i, j, round(w, 8) AS w FROM e WHERE w > 0",
    "coverage_upper_bound": f"""WITH {_E}, v AS (SELECT j, sum(w * s) AS q FROM e GROUP BY 1 HAVING sum(w * s) >= 5000), b AS (SELECT i, s, max(w) AS w FROM e WHERE j IN (SELECT j FROM v) GROUP BY 1, 2)
        SELECT (SELECT count(*) FROM v) AS hubs, round((SELECT sum(w * s) FROM b), 3) AS covered""",
    "hub_allocation": f"""WITH {_E}, o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j * 31 % 997) AS r FROM e )
        SELECT j AS hub, round(sum(w * s), 4) AS supply, count(DISTINCT CASE WHEN w * s > 0 THEN i END) AS n_sources FROM o WHERE r = 1 GROUP BY 1""",
    "huff_allocation": f"""WITH {_C}, {_S}, y(year) AS (VALUES (2020), (2021)), d AS (SELECT c_custkey AS cell, s_suppkey AS mill, s AS amount, {_D} AS km FROM c, su),
        t AS (SELECT year, cell, mill, amount, ln((1000 + mill * 17 % 500)::DOUBLE) - 0.05e0 * km AS sc FROM d, y WHERE km <= 100 AND NOT (mill % 5 = 0 AND year = 2021)),
        p AS (SELECT year, mill, amount * exp(sc - max(sc) OVER w) / sum(exp(sc)) OVER w * exp(max(sc) OVER w) AS a FROM t WINDOW w AS (PARTITION BY year, cell))
        SELECT year, mill, round(sum(a), 4) AS amount FROM p GROUP BY 1, 2""",
}
