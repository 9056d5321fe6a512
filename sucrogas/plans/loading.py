"""Loading, merging and reporting queries: incremental plans, decimal commas, aligned unions, totals, breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.operators import extract, quality, siting, spatial
from sucrogas.plans import places, registry
from sucrogas.session import table
from sucrogas.sources import files


def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tables, their order count as the hash of the inputs."""
    o = table(spark, sf_dir, "orders")
    cur = o.groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.sha2(F.count("*").cast("string"), 256).alias("input_hash"))
    old = o.where("o_orderkey % 50 <> 0").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.sha2(F.count("*").cast("string"), 256).alias("input_hash"))
    have = table(spark, sf_dir, "customer").where("c_custkey % 40 <> 0").select(F.col("c_custkey").cast("string").alias("name"))
    return files.needs_load(old, cur, have)


def decimal_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with a decimal comma come back as numbers; the key stays text."""
    p = table(spark, sf_dir, "part").select(F.format_string("%06d", "p_partkey").alias("part_code"), F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")).alias("price"), F.col("p_name").alias("label"))
    return files.decimal_comma_columns(p)


def aligned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as one layer; amounts that one side lacks are 0."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("place"), F.greatest("c_acctbal", F.lit(0.0)).alias("demand"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("place"), F.greatest("s_acctbal", F.lit(0.0)).alias("offer"))
    u = quality.union_all([c, s]).na.fill(0.0, ["demand", "offer"])
    return u.groupBy("place").agg(F.round(F.sum("demand"), 2).alias("demand"), F.round(F.sum("offer"), 2).alias("offer"))


SECTIONS = (("power", "BUILDING"), ("oil", "MACHINERY"), ("gas", "FURNITURE"), ("coal", "AUTOMOBILE"), ("wood", "HOUSEHOLD"))


def section_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections joined onto the places: a place not listed in a section gets 0, and for one section a flag."""
    j = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    for name, seg in SECTIONS:
        j = j.join(c.where(F.col("c_mktsegment") == seg).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias(name)), "n_nationkey", "left")
    return j.select("n_nationkey", "n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c, _ in SECTIONS], F.col("gas").isNotNull().alias("gas_listed"))


def residue_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by residue (return flag) and scenario (ship year), one column per year that occurs, with the residue's share of the first."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("residue"), F.year("l_shipdate").alias("y"), "l_quantity")
    years = sorted(r["y"] for r in li.select("y").where("y IS NOT NULL").distinct().collect())  # a calendar
    p = li.groupBy("residue").pivot("y", years).agg(F.sum("l_quantity"))
    p = p.select("residue", *[F.coalesce(F.col(str(y)), F.lit(0.0)).alias(f"y{y}") for y in years])
    return p.withColumn("share_first", F.round(F.try_divide(F.col(f"y{years[0]}"), F.sum(f"y{years[0]}").over(Window.partitionBy())), 9))


def hub_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocated supply of every open hub by market segment, and distinct sources behind it; hubs without sources appear with 0."""
    hubs = places.suppliers(spark, sf_dir).select(F.col("s_suppkey").alias("hub"), (F.col("s_suppkey") * 31 % 997).alias("step"))
    # Customers of a place go to the same hub, and of the hubs of a place only the first can win.
    first = spatial.at_places(places.suppliers(spark, sf_dir).withColumn("step", F.col("s_suppkey") * 31 % 997), "s_suppkey", F.min(F.struct("step", "s_suppkey")).alias("_f"))
    open_ = first.select("lat", "lon", F.col("_f.s_suppkey").alias("j"), F.col("_f.step").alias("step"))
    c = places.customers(spark, sf_dir)
    at = spatial.at_places(c, "c_custkey").withColumn("i", F.col("c_custkey"))
    a = siting.allocate_to(lambda some, *cols: places.between_places(some, open_, list(cols), ["step"]), at)
    j = c.join(at.join(a, "i").select("lat", "lon", "hub", "w"), ["lat", "lon"]).withColumn("v", F.col("w") * F.col("s")).withColumnRenamed("c_custkey", "i")
    segs = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    g = j.groupBy("hub").agg(*[F.sum(F.when(F.col("c_mktsegment") == x, F.col("v"))).alias(f"v_{x.lower()}") for x in segs], F.count_distinct(F.when(F.col("v") > 0, F.col("i"))).alias("cells"))
    full = hubs.select("hub").join(g, "hub", "left")
    out = full.select("hub", F.coalesce("cells", F.lit(0)).alias("cells"), *[F.round(F.coalesce(f"v_{x.lower()}", F.lit(0.0)), 4).alias(f"v_{x.lower()}") for x in segs])
    return siting.withhold_small(out, "cells", [f"v_{x.lower()}" for x in segs], 3)


def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First greedy step that reaches 10, 20 and 30 % of the supply; the steps end with the last share."""
    t = siting.greedy_coverage(places.edges(spark, sf_dir), places.customers(spark, sf_dir).select(F.col("c_custkey").alias("i"), "s"), 1000.0, target_share=0.3)
    total = places.customers(spark, sf_dir).agg(F.sum("s")).first()[0]
    return siting.hubs_for_share(t, total or 0.0, [0.1, 0.2, 0.3])


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supply per grid square and class; squares of 50 km, zero rows dropped."""
    c = places.customers(spark, sf_dir).select(F.floor((F.col("c_custkey") * 104729 % 300000) / 50000).alias("cx"), F.floor((F.col("c_custkey") * 7919 % 300000) / 50000).alias("cy"), "c_mktsegment", "s")
    g = c.groupBy("cx", "cy", F.col("c_mktsegment").alias("class")).agg(F.round(F.sum("s"), 2).alias("supply"))
    return g.where("supply > 0")


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number tokens of the documents with their number, how many are percentages, and whether the text holds each where it was found."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = text.number_tokens(d, "doc_id", "text")
    at = F.substring(F.col("text"), F.col("start_at") + 1, F.col("end_at") - F.col("start_at")) == F.col("token")
    return t.groupBy("doc_id", "token").agg(F.count("*").alias("n"), F.sum(F.col("percent").cast("long")).alias("percentages"), F.bool_and(at).alias("found_there"))


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents that stand in most documents (a top-20 report)."""
    lines = extract.lines(extract.pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")
    g = lines.where(F.length("line_text") > 0).groupBy("line_text").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_lines"))
    return g.orderBy(F.col("n_docs").desc(), F.col("n_lines").desc(), "line_text").limit(20)


QUERIES = {f.__name__: f for f in (
    incremental_plan, decimal_commas, aligned_union, section_merge, residue_totals, hub_breakdown, coverage_curve, source_rows, number_tokens, document_frequencies,
)}
_NUM = r"(^|[^\p{L}\p{N}_.,])([-+]?\d{1,3}(?:\.\d{3})+(?:,\d+)?|[-+]?\d+(?:,\d+)?(?:\.\d+)?)"
_SEGS = ("automobile", "building", "furniture", "household", "machinery")
SQL = {
    "incremental_plan": """WITH c AS (SELECT o_custkey::VARCHAR AS name, sha256(count(*)::VARCHAR) AS h FROM orders GROUP BY 1), o AS (SELECT o_custkey::VARCHAR AS name, sha256(count(*)::VARCHAR) AS h FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1),
        t AS (SELECT c_custkey::VARCHAR AS name FROM customer WHERE c_custkey % 40 <> 0) SELECT c.name, c.h AS input_hash FROM c LEFT JOIN o USING (name) WHERE c.h IS DISTINCT FROM o.h OR c.name NOT IN (SELECT name FROM t)""",
    "decimal_commas": "SELECT lpad(p_partkey::VARCHAR, 6, '0') AS part_code, round(p_retailprice, 2) AS price, p_name AS label FROM part",
    "aligned_union": """WITH u AS (SELECT c_nationkey AS place, greatest(c_acctbal, 0e0) AS demand, 0e0 AS offer FROM customer UNION ALL SELECT s_nationkey, 0e0, greatest(s_acctbal, 0e0) FROM supplier)
        SELECT place, round(sum(demand), 2) AS demand, round(sum(offer), 2) AS offer FROM u GROUP BY 1""",
    "section_merge": f"""WITH s AS (SELECT c_nationkey AS n_nationkey, {', '.join(f"sum((c_mktsegment = '{g}')::INT)::BIGINT AS {n}" for n, g in SECTIONS)} FROM customer WHERE c_acctbal > 0 GROUP BY 1)
        SELECT n_nationkey, n_name, {', '.join(f'coalesce({n}, 0) AS {n}' for n, _ in SECTIONS)}, coalesce(gas, 0) > 0 AS gas_listed FROM nation LEFT JOIN s USING (n_nationkey)""",
    "residue_totals": f"""WITH g AS (SELECT l_returnflag AS residue, {', '.join(f'sum(CASE WHEN year(l_shipdate) = {y} THEN l_quantity ELSE 0 END) AS y{y}' for y in range(1995, 2002))} FROM lineitem GROUP BY 1) SELECT *, round(y1995 / sum(y1995) OVER (), 9) AS share_first FROM g""",
    "hub_breakdown": f"""WITH {places._E}, h AS (SELECT s_suppkey AS hub FROM supplier), o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j * 31 % 997) AS r FROM e),
        g AS (SELECT j AS hub, count(DISTINCT CASE WHEN w * s > 0 THEN i END) AS cells, {', '.join(f"sum(CASE WHEN c_mktsegment = '{x.upper()}' THEN w * s END) AS v_{x}" for x in _SEGS)} FROM o JOIN customer ON c_custkey = i WHERE r = 1 GROUP BY 1),
        f AS (SELECT hub, coalesce(cells, 0) AS cells, {', '.join(f'round(coalesce(v_{x}, 0), 4) AS v_{x}' for x in _SEGS)} FROM h LEFT JOIN g USING (hub))
        SELECT hub, cells, {', '.join(f'CASE WHEN cells > 0 AND cells < 3 THEN NULL ELSE v_{x} END AS v_{x}' for x in _SEGS)}, cells > 0 AND cells < 3 AS withheld FROM f""",
    "source_rows": """SELECT (c_custkey * 104729 % 300000) // 50000 AS cx, (c_custkey * 7919 % 300000) // 50000 AS cy, c_mktsegment AS class, round(sum(greatest(c_acctbal, 0e0)), 2) AS supply FROM customer GROUP BY 1, 2, 3
        HAVING round(sum(greatest(c_acctbal, 0e0)), 2) > 0""",
    "number_tokens": rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUM}', 2)) AS token FROM documents), p AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_NUM}[\s\x{{a0}}]*%', 2)) AS token FROM documents), q AS (SELECT doc_id, token, count(*) AS c FROM p GROUP BY 1, 2)
        SELECT doc_id, token, count(*) AS n, max(coalesce(c, 0))::BIGINT AS percentages, true AS found_there FROM t LEFT JOIN q USING (doc_id, token) GROUP BY 1, 2""",
    "coverage_curve": f"WITH z AS ({places.greedy_sql(1000.0, 60, 0.3)}) SELECT " + ", ".join(f"(SELECT min(step) FROM z WHERE covered >= {s} * (SELECT sum(greatest(c_acctbal, 0e0)) FROM customer)) AS step_{round(s * 100)}" for s in (0.1, 0.2, 0.3)),
    "document_frequencies": f"""WITH {registry._LINES} SELECT line_text, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM ln WHERE length(line_text) > 0 GROUP BY 1
        ORDER BY 2 DESC, 3 DESC, line_text LIMIT 20""",
}
