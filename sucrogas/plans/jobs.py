"""The scoring and the hub coverage job end to end, and the small operators around them, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.operators import calibrate, siting, spatial
from sucrogas.plans import places
from sucrogas.session import table

_DRAWS = siting.weight_draws(["gas", "supply"], 40, 4.0, 3)
_CRIT = {"gas": "lower", "supply": "higher"}
_WEIGHTS = {"gas": 3.0, "supply": 1.0}


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cells: the least of three distances, supply, exclusions."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    d = p.select("p_partkey", F.when(k % 5 != 0, k * 31 % 997).cast("double").alias("d1"), (k * 17 % 1009).cast("double").alias("d2"), F.when(k % 3 == 0, k * 7 % 501).cast("double").alias("d3"), F.col("p_retailprice").cast("double").alias("supply"), (k % 23 == 0).alias("excluded"), "p_size", "p_brand")
    return d.select("p_partkey", siting.nearest_of(["d1", "d2", "d3"]).alias("gas"), "supply", "excluded", "p_size", "p_brand")


def grid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scoring job: half of the cells pass the supply gate, distances are cut at their 99 % quantile."""
    g = siting.grid_scores(_cells(spark, sf_dir), _CRIT, _WEIGHTS, gate=("supply", 0.5), extra_exclusions=F.col("p_size") > 45, clip=0.99, draws=_DRAWS, top_k=100, key="p_partkey")
    return g.select("p_partkey", "excluded", "score", "rank", *[F.round(c, 9).alias(c) for c in ("part_gas", "part_supply")], *[F.round(c, 6).alias(c) for c in ("rank_median", "rank_p05", "rank_p95", "p_top_k")])


def top_cells_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells among the best 1000 of all per brand."""
    s = siting.rank_scores(_cells(spark, sf_dir).where("NOT excluded"), "supply")
    return siting.top_per_place(s, "rank", _cells(spark, sf_dir), "p_brand", 1000)


_ALLOWED = [("BUILDING", "k0"), ("BUILDING", "k1"), ("MACHINERY", "k2"), ("FURNITURE", "k0")]


def _route() -> Column:
    return F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"), F.col("c_mktsegment")).otherwise("")


def _kind() -> Column:
    return F.concat(F.lit("k"), F.col("s_suppkey") % 3)


def allowed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of residues that may go to that kind of hub."""
    # Lists by place and route, and by place and kind: the rule is asked once for all pairs of two lists.
    c = places.customers(spark, sf_dir).withColumn("route", _route())
    s = places.suppliers(spark, sf_dir).withColumn("kind", _kind())
    a, b = spatial.listed_at_places(c, "c_custkey", "is", ["route"]), spatial.listed_at_places(s, "s_suppkey", "js", ["kind"])
    p = spatial.pairs_within(a, b, "c_custkey", "s_suppkey", 90.0, ["is", "route"], ["js", "kind"], siting.may_go(F.col("route"), F.col("kind"), _ALLOWED))
    e = p.select("is", "js", siting.decay_weight(F.col("km"), 30.0, 90.0).alias("w")).where("w > 0")
    return places.each_pair(e.withColumn("w", F.round("w", 8)))


def hub_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage job: hubs opened on the allowed pairs, every source allocated, supply per hub with the small-count rule, share of all supply and of the upper bound."""
    c = places.customers(spark, sf_dir).withColumn("route", _route())
    routes = ["", *sorted({r for r, _ in _ALLOWED})]
    mine = [F.when(F.col("route") == r, F.col("s")) for r in routes]
    parts = [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{k}") for k, x in enumerate(mine)] + [F.count(F.when(x > 0, 1)).alias(f"n{k}") for k, x in enumerate(mine)]
    sources = spatial.at_places(c, "c_custkey", *parts).withColumn("i", F.col("c_custkey"))
    hubs = spatial.at_places(places.suppliers(spark, sf_dir).withColumn("kind", _kind()), "s_suppkey", by=["kind"]).select("lat", "lon", "kind", F.col("s_suppkey").alias("j"))
    j, bound = siting.coverage_by_route(places.between_places, sources, hubs, routes, _ALLOWED, 3000.0, 8)
    total = places._supply(spark, sf_dir).agg(F.sum("s").alias("total"))
    t, b = total.first()["total"] or 0.0, bound.first()["covered"] or 0.0
    out = j.select("step", "hub", F.round("supply", 3).alias("supply"), "sources", F.round(F.try_divide(F.col("supply"), F.lit(t)), 8).alias("share"), F.round(F.try_divide(F.col("supply"), F.lit(b)), 8).alias("share_of_bound"))
    return siting.withhold_small(out, "sources", ["supply", "share", "share_of_bound"], 3)


def pairs_from_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense matrix of five destinations."""
    k = F.col("s_suppkey")
    m = table(spark, sf_dir, "supplier").select("s_suppkey", *[F.when(k % (i + 3) != 0, (k * (17 + i) % 400).cast("double")).alias(f"d{i}") for i in range(5)])
    return siting.pairs_from_matrix(m, "s_suppkey", [f"d{i}" for i in range(5)], 150.0)


def factor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("level"))
    return siting.factor_codes(o, "level").select("o_orderkey", "level", "code")


def fallback_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spatial.pairs_within(places.customers(spark, sf_dir), places.suppliers(spark, sf_dir), "c_custkey", "s_suppkey", 20.0)
    return p.select("c_custkey", "s_suppkey", F.round(spatial.fallback_road_km(F.col("km"), 1.3), 6).alias("road_km"))


def cell_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of cells by their own field, else by the list of cells."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 97).alias("cell"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("own"))
    via = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 97).alias("cell"), F.col("s_name").alias("place"))
    return spatial.with_place(c, "cell", via, "own", "place").select("c_custkey", "place")


def curve_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of curves: values by day of month per event type and user group."""
    e = table(spark, sf_dir, "events")
    c = e.select("event_type", (F.col("user_id") % 200).alias("u"), (F.day("ts") - F.when(F.col("event_id") % 11 == 0, 40).otherwise(F.when(F.col("user_id") % 2 == 0, F.lit(1)).otherwise(F.lit(0)))).alias("day"), F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("y"), "event_id")
    first = c.groupBy("event_type", "u", "day").agg(F.max("y").alias("y"))
    return calibrate.load_problems(first, ["event_type", "u"])


def unit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the plant tables whose name states no unit."""
    units = {"m3d": "m3/d", "pct": "%", "brl_m": "R$ million"}
    rows = []
    for name in ("anp_monthly_sp_plants_from_pilar2b", "anp_biomethane_plants_latest_from_pilar2b", "projects_capex_proposed_r07"):
        df = table(spark, sf_dir, name)
        numbers = [c for c, t in df.dtypes if t in ("double", "int", "bigint")]
        rows += [(name, c) for c in text.columns_without_unit(numbers, units, ("id", "year"), "capacity_unit" in df.columns)]
        rows += [(name, f"{c}: {text.column_unit(c, units)}") for c in numbers if text.column_unit(c, units)]
    return spark.createDataFrame(rows, "table_name string, finding string")


QUERIES = {f.__name__: f for f in (grid_scores, top_cells_per_place, allowed_pairs, hub_coverage, pairs_from_matrix, factor_codes, fallback_distances, cell_places, curve_problems, unit_columns)}
_CE = "ce AS (SELECT p_partkey, least(CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey * 31 % 997)::DOUBLE END, (p_partkey * 17 % 1009)::DOUBLE, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey * 7 % 501)::DOUBLE END) AS gas, p_retailprice::DOUBLE AS supply, p_partkey % 23 = 0 AS excluded, p_size, p_brand FROM part)"
_AE = places._E + ", ae AS (SELECT e.i, e.j, e.s, e.w FROM e JOIN c ON c_custkey = i WHERE w > 0 AND (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') OR (" + " OR ".join(f"(c_mktsegment = '{r}' AND j % 3 = {k[1]})" for r, k in _ALLOWED) + ")))"
_GREEDY = places.greedy_sql(3000.0, 8, None).replace("ee AS MATERIALIZED (SELECT i, j, s, w FROM e WHERE w > 0)", _AE[len(places._E) + 2 :] + ", ee AS MATERIALIZED (SELECT i, j, s, w FROM ae)")
SQL = {
    "grid_scores": f"""WITH {_CE}, a AS (SELECT *, excluded OR p_size > 45 AS x FROM ce), b AS (SELECT *, x OR supply < (SELECT quantile_cont(supply, 0.5) FROM a WHERE NOT x) AS ex FROM a),
        c0 AS (SELECT *, least(gas, (SELECT quantile_cont(gas, 0.99) FROM b WHERE NOT ex)) AS g, least(supply, (SELECT quantile_cont(supply, 0.99) FROM b WHERE NOT ex)) AS s FROM b),
        m AS (SELECT min(g) AS gl, max(g) AS gh, min(s) AS sl, max(s) AS sh FROM c0 WHERE NOT ex), n AS (SELECT p_partkey, ex, 1 - greatest(0, least(1, (g - gl) / (gh - gl))) AS ng, greatest(0, least(1, (s - sl) / (sh - sl))) AS ns FROM c0, m),
        sc AS (SELECT *, CASE WHEN NOT ex THEN round(ng * 0.75e0 + ns * 0.25e0, 10) END AS score FROM n), dr(draw, w0, w1) AS (VALUES {', '.join(f'({d}, {a!r}::DOUBLE, {b!r}::DOUBLE)' for d, a, b in _DRAWS)}),
        r AS (SELECT p_partkey, rank() OVER (PARTITION BY draw ORDER BY round(ng * w0 + ns * w1, 12) DESC) AS r FROM n, dr WHERE NOT ex), q AS (SELECT p_partkey, round(quantile_cont(r, 0.5), 6) AS rank_median, round(quantile_cont(r, 0.05), 6) AS rank_p05, round(quantile_cont(r, 0.95), 6) AS rank_p95, round(avg(CASE WHEN r <= 100 THEN 1e0 ELSE 0 END), 6) AS p_top_k FROM r GROUP BY 1)
        SELECT p_partkey, ex AS excluded, score, CASE WHEN score IS NOT NULL THEN rank() OVER (ORDER BY score DESC NULLS LAST) END AS rank, CASE WHEN NOT ex THEN round(ng * 0.75e0, 9) END AS part_gas, CASE WHEN NOT ex THEN round(ns * 0.25e0, 9) END AS part_supply,
        rank_median, rank_p05, rank_p95, p_top_k FROM sc LEFT JOIN q USING (p_partkey)""",
    "top_cells_per_place": f"WITH {_CE}, r AS (SELECT p_brand, rank() OVER (ORDER BY supply DESC) AS r FROM ce WHERE NOT excluded) SELECT p_brand, sum((r <= 1000)::INT)::BIGINT AS n_top FROM (SELECT p_brand, r FROM r UNION ALL SELECT DISTINCT p_brand, 1000000000 FROM ce) GROUP BY 1",
    "allowed_pairs": f"WITH {_AE} SELECT i, j, round(w, 8) AS w FROM ae",
    "hub_coverage": _GREEDY.rsplit(" SELECT step", 1)[0] + """, al AS (SELECT i, j, s, w, row_number() OVER (PARTITION BY i ORDER BY w DESC, step) AS r FROM ae JOIN tr ON tr.hub = ae.j), pe AS (SELECT j AS hub, sum(w * s) AS supply, count(DISTINCT CASE WHEN w * s > 0 THEN i END) AS sources FROM al WHERE r = 1 GROUP BY 1),
        vi AS (SELECT j FROM ae GROUP BY 1 HAVING sum(w * s) >= 3000), bo AS (SELECT sum(w * s) AS b FROM (SELECT i, s, max(w) AS w FROM ae WHERE j IN (SELECT j FROM vi) GROUP BY 1, 2)), z AS (SELECT step, hub, coalesce(supply, 0) AS supply, coalesce(sources, 0) AS sources FROM tr LEFT JOIN pe USING (hub)),
        h AS (SELECT *, sources > 0 AND sources < 3 AS withheld FROM z) SELECT step, hub, CASE WHEN NOT withheld THEN round(supply, 3) END AS supply, sources, CASE WHEN NOT withheld THEN round(supply / (SELECT sum(s) FROM c), 8) END AS share, CASE WHEN NOT withheld THEN round(supply / (SELECT b FROM bo), 8) END AS share_of_bound, withheld FROM h""",
    "pairs_from_matrix": " UNION ALL ".join(f"SELECT s_suppkey, 'd{i}' AS destination, (s_suppkey * {17 + i} % 400)::DOUBLE AS km FROM supplier WHERE s_suppkey % {i + 3} <> 0 AND s_suppkey * {17 + i} % 400 <= 150" for i in range(5)),
    "factor_codes": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS level FROM orders) SELECT o_orderkey, level, CASE WHEN level IS NULL THEN -1 ELSE (SELECT count(DISTINCT level) FROM o b WHERE b.level < o.level) END AS code FROM o",
    "fallback_distances": f"WITH {places._C}, {places._S}, d AS (SELECT c_custkey, s_suppkey, {places._D} AS km FROM c, su) SELECT c_custkey, s_suppkey, round(km * 1.3e0, 6) AS road_km FROM d WHERE km <= 20",
    "cell_places": "WITH v AS (SELECT s_suppkey % 97 AS cell, min(s_name) AS place FROM supplier GROUP BY 1) SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, place) AS place FROM customer LEFT JOIN v ON c_custkey % 97 = cell",
    "curve_problems": """WITH c AS (SELECT event_type, user_id % 200 AS u, day(ts) - CASE WHEN event_id % 11 = 0 THEN 40 WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS day, CASE WHEN event_id % 13 <> 0 THEN value END AS y FROM events), f AS (SELECT event_type, u, day, max(y) AS y FROM c GROUP BY 1, 2, 3),
        g AS (SELECT *, y IS NOT NULL AND day >= 0 AS good, last_value(CASE WHEN y IS NOT NULL AND day >= 0 THEN y END IGNORE NULLS) OVER (PARTITION BY event_type, u ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f)
        SELECT event_type, u, 'day below zero' AS problem, day FROM g WHERE day < 0 UNION ALL SELECT event_type, u, 'no value', day FROM g WHERE y IS NULL UNION ALL SELECT event_type, u, 'falls from the day before', day FROM g WHERE good AND y < b
        UNION ALL SELECT event_type, u, 'no day 0', NULL FROM f GROUP BY 1, 2 HAVING min(day) > 0""",
    "unit_columns": """SELECT * FROM (VALUES ('anp_monthly_sp_plants_from_pilar2b', 'cap_biometano_m3d: m3/d'), ('anp_monthly_sp_plants_from_pilar2b', 'cap_biogas_m3d: m3/d'), ('anp_monthly_sp_plants_from_pilar2b', 'vol_biogas_m3d: m3/d'), ('anp_monthly_sp_plants_from_pilar2b', 'util_pct: %'),
        ('anp_biomethane_plants_latest_from_pilar2b', 'cap_biometano_m3d: m3/d'), ('anp_biomethane_plants_latest_from_pilar2b', 'cap_biogas_m3d: m3/d'), ('anp_biomethane_plants_latest_from_pilar2b', 'vol_biogas_m3d: m3/d'), ('anp_biomethane_plants_latest_from_pilar2b', 'util_pct: %'),
        ('projects_capex_proposed_r07', 'investment_total_brl_m: R$ million'), ('projects_capex_proposed_r07', 'bndes_brl_m: R$ million')) v(table_name, finding)""",
}
