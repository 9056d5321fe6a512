"""Further reference operators: distance matrices by service, projections, scaling fits, grid posteriors, drafts, searches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.operators import economics, siting, spatial
from sucrogas.operators.ranks import weighted_quantiles
from sucrogas.plans import places
from sucrogas.session import ensure_checkpoint_dir, table


def _great_circle(a: list[tuple], b: list[tuple]) -> list[list[float | None]]:
    """Stands in for a routing service."""

    def km(p: tuple, q: tuple) -> float:
        la, lb = math.radians(p[0]), math.radians(q[0])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * spatial.EARTH_KM * math.asin(min(1.0, math.sqrt(h)))

    return [[km(p, q) for q in b] for p in a]


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", places._lat("n_nationkey").alias("lat"), places._lon("n_nationkey").alias("lon"))


def od_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spatial.od_matrix(places.suppliers(spark, sf_dir), _nations(spark, sf_dir), "s_suppkey", "n_nationkey", _great_circle, 40)
    return m.select("s_suppkey", "n_nationkey", F.round("km", 6).alias("km"))


def polyconic_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of plane over great-circle distance by distance class."""
    def projected(df: DataFrame, key: str, tag: str) -> DataFrame:
        x, y = spatial.polyconic_xy(F.col("lat"), F.col("lon"), -49.0)
        return spatial.at_places(df, key).withColumns({f"x{tag}": x, f"y{tag}": y}).withColumnRenamed("n", f"n{tag}")

    c, s = projected(places.customers(spark, sf_dir), "c_custkey", "a"), projected(places.suppliers(spark, sf_dir), "s_suppkey", "b")
    p = spatial.pairs_within(c, s, "c_custkey", "s_suppkey", 300.0, ["xa", "ya", "na"], ["xb", "yb", "nb"])
    ratio = F.when(F.col("km") > 0.001, F.try_divide(spatial.plane_km((F.col("xa"), F.col("ya")), (F.col("xb"), F.col("yb"))), F.col("km")))
    r = p.select(F.floor(F.col("km") / 100).cast("int").alias("class"), ratio.alias("ratio"), (F.col("na") * F.col("nb")).alias("pairs"))
    q = weighted_quantiles(r, ["class"], "ratio", "pairs", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return q.select("class", "n", *[F.round(x, 8).alias(x) for x in ("p05", "p50", "p95")])


def scaling_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    f = economics.power_fit(li, ["l_suppkey"], "q", "p")
    return f.select("l_suppkey", "n", *[F.round(c, 6).alias(c) for c in ("exponent", "intercept", "r2")])


def huff_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log posterior of the distance parameter on a grid: squared log errors of the allocation against one with the true value 0.05.

    All grid values are allocated in one job: the value takes the place of the year.
    """
    # The mills of a place count as one of that capacity; each has its share of the amount.
    ensure_checkpoint_dir(spark)
    mills = spatial.at_places(places.suppliers(spark, sf_dir), "s_suppkey").select("lat", "lon", F.col("s_suppkey").alias("mill"), "n", F.log("n").alias("pull"))
    cells = spatial.at_places(places.customers(spark, sf_dir), "c_custkey", F.sum("s").alias("amount")).select("lat", "lon", F.col("c_custkey").alias("cell"), "amount")
    every = siting.huff_grid(lambda some, *cols: spatial.pairs_within(some, mills, "cell", "mill", 100.0, cols, ["pull"]), cells, BETAS)
    every = every.join(mills.select("mill", "n"), "mill").withColumn("amount", F.col("amount") / F.col("n")).checkpoint()
    true = every.where(F.col("beta") == 0.05).select("mill", F.col("amount").alias("obs")).where("obs > 0")
    m = every.join(true, "mill").where("amount > 0")
    out = m.groupBy("beta").agg(F.round(-0.5 * F.sum(F.col("n") * F.pow(F.log(F.col("amount") / F.col("obs")) / 0.2, 2)), 6).alias("log_posterior"))
    return out.withColumn("best", F.rank().over(Window.orderBy(F.col("log_posterior").desc())) == 1)


BETAS = (0.02, 0.03, 0.04, 0.045, 0.05, 0.055, 0.06, 0.07, 0.08)


def draft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft registry text from replicates: mean, range, deviation and number."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    return e.select("event_type", F.format_string("%.3f (%.2f to %.2f), sd %.3f, n = %d", F.round("m", 3), F.round("lo", 2), F.round("hi", 2), F.round("sd", 3), "n").alias("draft"))


def source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "parameters")
    q = F.lower(F.concat_ws(" ", "parameter", "source", "notes"))
    return p.where(q.contains("stillage") & q.contains("study")).groupBy("parameter", "confidence").agg(F.count("*").alias("n"))


def municipality_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-digit codes of one state as integers, one row per code."""
    m = table(spark, sf_dir, "municipalities").where("uf = 'SP'")
    return m.select(F.substring("ibge_code", 1, 7).cast("int").alias("code"), text.name_key(F.col("municipio")).alias("name_key")).groupBy("code").agg(F.min("name_key").alias("name_key"))


def verified_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of flags among the 50 parameter rows of highest priority (a top-k report)."""
    p = table(spark, sf_dir, "parameters").select("id", "confidence", (F.length("parameter") % 7).alias("priority")).distinct()
    top = p.orderBy(F.col("priority").desc(), "id").limit(50)
    return top.agg(F.round(F.avg((F.col("confidence") == "S").cast("double")), 6).alias("share"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (od_matrix, polyconic_distortion, scaling_exponents, huff_posterior, draft_rows, source_search, municipality_codes, verified_share)}
_N = f"n AS (SELECT n_nationkey, {places._P('n_nationkey')} FROM nation)"
_XY = lambda a, lon0: (
    f"coalesce(cos(radians({a}lat)) / nullif(sin(radians({a}lat)), 0) * sin(radians({a}lon - {lon0}) * sin(radians({a}lat))), radians({a}lon - {lon0}))",
    f"coalesce(radians({a}lat) + cos(radians({a}lat)) / nullif(sin(radians({a}lat)), 0) * (1 - cos(radians({a}lon - {lon0}) * sin(radians({a}lat)))), radians({a}lat))",
)
_A, _B = _XY("c.", "(-49e0)"), _XY("su.", "(-49e0)")
SQL = {
    "od_matrix": f"WITH {places._S}, {_N} SELECT s_suppkey, n_nationkey, round({places._HAV.format(a='su.', b='n.')}, 6) AS km FROM su, n",
    "polyconic_distortion": f"""WITH {places._C}, {places._S}, d AS (SELECT {places._D} AS km, 6371.0088e0 * sqrt(pow({_B[0]} - ({_A[0]}), 2) + pow({_B[1]} - ({_A[1]}), 2)) AS pk FROM c, su)
        SELECT floor(km / 100)::INT AS class, count(*) AS n, round(quantile_cont(pk / km, 0.05), 8) AS p05, round(quantile_cont(pk / km, 0.5), 8) AS p50, round(quantile_cont(pk / km, 0.95), 8) AS p95 FROM d WHERE km <= 300 AND km > 0.001 GROUP BY 1""",
    "scaling_exponents": """WITH g AS (SELECT l_suppkey, l_orderkey, ln(sum(l_quantity)) AS x, ln(sum(l_extendedprice)) AS y FROM lineitem GROUP BY 1, 2)
        SELECT l_suppkey, count(*) AS n, round(regr_slope(y, x), 6) AS exponent, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM g GROUP BY 1""",
    "huff_posterior": f"""WITH {places._C}, {places._S}, b AS (SELECT unnest([{', '.join(f'{b}e0' for b in BETAS)}]) AS beta), d AS (SELECT c_custkey AS cell, s_suppkey AS mill, s AS amount, {places._D} AS km FROM c, su), t AS (SELECT beta, cell, mill, amount, -beta * km AS sc FROM d, b WHERE km <= 100),
        p AS (SELECT beta, mill, amount * exp(sc - max(sc) OVER w) / sum(exp(sc)) OVER w * exp(max(sc) OVER w) AS a FROM t WINDOW w AS (PARTITION BY beta, cell)), g AS (SELECT beta, mill, sum(a) AS a FROM p GROUP BY 1, 2),
        o AS (SELECT g.beta, round(-0.5e0 * sum(pow(ln(g.a / t.a) / 0.2e0, 2)), 6) AS log_posterior FROM g JOIN g t ON t.mill = g.mill AND t.beta = 0.05e0 WHERE g.a > 0 AND t.a > 0 GROUP BY 1) SELECT beta, log_posterior, rank() OVER (ORDER BY log_posterior DESC) = 1 AS best FROM o""",
    "draft_rows": "SELECT event_type, printf('%.3f (%.2f to %.2f), sd %.3f, n = %d', round(avg(value), 3), round(min(value), 2), round(max(value), 2), round(stddev_samp(value), 3), count(*)) AS draft FROM events GROUP BY 1",
    "source_search": "SELECT parameter, confidence, count(*) AS n FROM parameters WHERE contains(lower(concat_ws(' ', parameter, source, notes)), 'stillage') AND contains(lower(concat_ws(' ', parameter, source, notes)), 'study') GROUP BY 1, 2",
    "municipality_codes": f"""SELECT substr(ibge_code, 1, 7)::INT AS code, min(trim(regexp_replace(translate(lower(municipio), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn'), '[^a-z0-9]+', ' ', 'g'))) AS name_key FROM municipalities WHERE uf = 'SP' GROUP BY 1""",
    "verified_share": "SELECT round(avg(CASE WHEN confidence = 'S' THEN 1e0 ELSE 0 END), 6) AS share, count(*) AS n FROM (SELECT DISTINCT id, confidence, length(parameter) % 7 AS p FROM parameters ORDER BY p DESC, id LIMIT 50)",
}
