"""Further checks and reports on the driver's tables, with SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.operators import calibrate, quality, siting, spatial, supply
from sucrogas.plans import calibration, places
from sucrogas.session import table


def pruned_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy hubs, those below 120,000 after allocation closed."""
    e, s = places.edges(spark, sf_dir), places._supply(spark, sf_dir)
    p = siting.prune_hubs(e, s, siting.greedy_coverage(e, s, 5000.0, 6), 120000.0)
    return p.select("step", "hub", "closed", F.round("supply", 3).alias("supply"), "sources")


def cells_behind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources behind the suppliers of each region's nations, as one set per region."""
    e, s = places.edges(spark, sf_dir), places._supply(spark, sf_dir)
    hubs = places.suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("hub"), F.col("s_suppkey").alias("step"), (F.col("s_nationkey") % 5).alias("set"))
    a = siting.allocate(e, hubs)
    return reduce(DataFrame.unionByName, [siting.cells_behind(a, s, hubs.where(F.col("set") == k)).select(F.lit(k).alias("hub_set"), "sources", F.round("supply", 3).alias("supply")) for k in range(5)])


def edge_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as edges of orders and parts: repeated pairs, and quantities that are no weights."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), (F.col("l_quantity") / 45).alias("w"))
    return siting.edge_issues(e)


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the lines against the printed total of each order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("v"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("t"))
    q = quality.against_totals(li, ["order_key"], "v", o, "t", 1000.0)
    return q.select("order_key", "n", F.round("sum", 3).alias("sum"), F.round("printed", 3).alias("printed"), "ok")


def off_season_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = calibration.plant_months(spark, sf_dir)
    sim = p.select("plant_id", F.col("date").alias("month"), (F.col("capg") * 0.5).alias("sim"))
    obs = p.where("vol >= 0").select("plant_id", F.col("date").alias("month"), F.col("vol").alias("obs"))
    s = calibrate.off_season_shares(sim, obs, ["plant_id"], [12, 1, 2, 3])
    return s.select("plant_id", F.round("sim_share", 8).alias("sim_share"), F.round("obs_share", 8).alias("obs_share"))


def control_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = calibrate.replicate_validity(calibration._curves(spark, sf_dir).select("event_type", "u", "day", F.col("gas").alias("y")), ["event_type", "u"], 0.3, 0.05)
    c = calibrate.control_recovery(v, F.col("u") % 5 == 0, 250.0, 0.5, 1.1)
    return c.select("event_type", "u", F.round("recovery", 7).alias("recovery"), "ok_control")


def key_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as text, some without a sign or a key."""
    p = table(spark, sf_dir, "part")
    written = F.concat(F.lit("size = "), F.col("p_size"), F.lit("; ;brand="), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, ";loose;=7;size=0").otherwise(""))
    m = text.key_values(written)
    return p.select("p_partkey", m["size"].alias("size"), m["brand"].alias("brand"), F.size(m).alias("n"))


def catchments_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply within 8 km by market segment, with the small-count rule for each."""
    out = []
    for g in ("BUILDING", "MACHINERY"):
        src = places._metric(places.customers(spark, sf_dir).where(F.col("c_mktsegment") == g), "c_custkey", "s").withColumn("one", F.lit(1.0))
        q = places._metric(places.suppliers(spark, sf_dir), "s_suppkey", None)
        v, n = (spatial.disc_sums(src, q, "s_suppkey", c, 8000.0, 1000.0) for c in ("v", "one"))
        j = v.join(n.withColumnRenamed("disc_sum", "n"), "s_suppkey").select("s_suppkey", F.lit(g).alias("residue_group"), F.round("disc_sum", 4).alias("disc_sum"), F.col("n").cast("long").alias("n"))
        out.append(siting.withhold_small(j, "n", ["disc_sum"], 3))
    return reduce(DataFrame.unionByName, out)


def checked_harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Harvest events that a second index confirms, per unit."""
    e = calibration._events(spark, sf_dir)
    h = supply.harvest_events(e, "user_id", "ts", "ndvi", 0.6, 0.3, 6, 3, check=F.col("event_type").isin("click", "view", "purchase"))
    return h.groupBy("user_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (pruned_hubs, cells_behind, edge_issues, order_totals, off_season_shares, control_recovery, key_value_pairs, catchments_by_group, checked_harvests)}


def _prune_sql() -> str:
    sql = places.greedy_sql(5000.0, 6, None).rsplit(" SELECT step", 1)[0]
    sql += ", o0 AS (SELECT step, hub FROM tr)"
    for k in range(6):
        sql += f""", q{k} AS MATERIALIZED (SELECT o{k}.hub, o{k}.step, coalesce(sum(CASE WHEN r = 1 THEN w * s END), 0) AS q FROM o{k} LEFT JOIN (SELECT ee.*, row_number() OVER (PARTITION BY i ORDER BY w DESC, step) AS r FROM ee JOIN o{k} ON hub = j) a ON a.j = o{k}.hub GROUP BY 1, 2),
 o{k + 1} AS MATERIALIZED (SELECT step, hub FROM o{k} WHERE hub NOT IN (SELECT hub FROM (SELECT hub FROM q{k} WHERE q < 120000 ORDER BY q, step DESC LIMIT 1)))"""
    return sql + """, fin AS (SELECT j AS hub, sum(w * s) AS q, count(DISTINCT CASE WHEN w * s > 0 THEN i END) AS n FROM (SELECT ee.*, row_number() OVER (PARTITION BY i ORDER BY w DESC, step) AS r FROM ee JOIN o6 ON hub = j) WHERE r = 1 GROUP BY 1)
 SELECT tr.step, tr.hub, tr.hub NOT IN (SELECT hub FROM o6) AS closed, round(coalesce(q, 0), 3) AS supply, coalesce(n, 0) AS sources FROM tr LEFT JOIN fin USING (hub)"""


_DISC = places._DISC(8, "v")
SQL = {
    "pruned_hubs": _prune_sql(),
    "cells_behind": f"""WITH {places._E}, o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS r FROM e WHERE w > 0), k AS (SELECT unnest([0, 1, 2, 3, 4]) AS hub_set), a AS (SELECT s_nationkey % 5 AS hub_set, i, w * s AS v FROM o JOIN supplier ON s_suppkey = j WHERE r = 1 AND w * s > 0)
        SELECT hub_set, count(DISTINCT i) AS sources, round(coalesce(sum(v), 0), 3) AS supply FROM k LEFT JOIN a USING (hub_set) GROUP BY 1""",
    "edge_issues": "WITH g AS (SELECT l_suppkey AS i, l_partkey AS j, count(*) AS n, max(l_quantity / 45) AS w FROM lineitem GROUP BY 1, 2) SELECT i, j, 'repeated' AS issue FROM g WHERE n > 1 UNION ALL SELECT i, j, 'no weight in [0, 1]' FROM g WHERE w > 1",
    "order_totals": """WITH g AS (SELECT l_orderkey AS order_key, count(*) AS n, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1)
        SELECT coalesce(order_key, o_orderkey) AS order_key, coalesce(n, 0) AS n, round(s, 3) AS sum, round(o_totalprice, 3) AS printed, coalesce(abs(s - o_totalprice) <= 1000, false) AS ok FROM g FULL JOIN orders ON order_key = o_orderkey""",
    "off_season_shares": f"""WITH {calibration._LATEST}, j AS (SELECT plant_id, month(date) IN (12, 1, 2, 3) AS off, capg * 0.5e0 AS sim, vol AS obs FROM l WHERE vol >= 0 AND capg IS NOT NULL)
        SELECT plant_id, round(sum(CASE WHEN off THEN sim ELSE 0 END) / nullif(sum(sim), 0), 8) AS sim_share, round(sum(CASE WHEN off THEN obs ELSE 0 END) / nullif(sum(obs), 0), 8) AS obs_share FROM j GROUP BY 1""",
    "control_recovery": """WITH d AS (SELECT event_type, user_id % 50 AS u, day(ts) AS day, avg(value) AS m FROM events GROUP BY 1, 2, 3), l AS (SELECT event_type, u, arg_max(m, day) AS m FROM d GROUP BY 1, 2)
        SELECT event_type, u, CASE WHEN u % 5 = 0 THEN round(m / 250e0, 7) END AS recovery, CASE WHEN u % 5 = 0 THEN m / 250e0 BETWEEN 0.5 AND 1.1 END AS ok_control FROM l""",
    "key_value_pairs": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE p_size::VARCHAR END AS size, p_brand AS brand, 2 AS n FROM part",
    "catchments_by_group": " UNION ALL ".join(
        f"SELECT s_suppkey, '{g}' AS residue_group, CASE WHEN n > 0 AND n < 3 THEN NULL ELSE v END AS disc_sum, n, n > 0 AND n < 3 AS withheld FROM (SELECT s_suppkey, round({_DISC}, 4) AS v, {places._DISC(8, '1')}::BIGINT AS n FROM (SELECT s_suppkey, s_suppkey * 104729 % 300000 AS x, s_suppkey * 7919 % 300000 AS y FROM supplier) q, (SELECT greatest(c_acctbal, 0e0) AS v, c_custkey * 104729 % 300000 AS x, c_custkey * 7919 % 300000 AS y FROM customer WHERE c_mktsegment = '{g}') c GROUP BY 1)"
        for g in ("BUILDING", "MACHINERY")
    ),
    "checked_harvests": "WITH " + calibration._HARV.replace("FROM pr WHERE v0 >= 0.6 AND ndvi <= 0.3)", "FROM pr WHERE v0 >= 0.6 AND ndvi <= 0.3 AND event_type IN ('click', 'view', 'purchase'))").replace("SELECT user_id, ts, ndvi, lag(ts)", "SELECT user_id, event_type, ts, ndvi, lag(ts)") + " SELECT user_id, count(*) AS n FROM acc GROUP BY 1",
}
