"""Validation queries: issues per file of a registry, with SQL twins.

The project and parameter tables are the registry's own; sources and references are those the parameters name; reported values are the orders of a
customer and year; mills are the suppliers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.operators import scenario, validation
from sucrogas.plans import chain, registry
from sucrogas.session import table

PROJECTS = "projects_capex_proposed_r07"


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, PROJECTS).distinct()


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parameters").distinct()


def project_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(projects(spark, sf_dir), "projects", "id", validation.project_rules())


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per supplier: every seventh address is a placeholder, every eleventh none."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    url = F.when(k % 7 == 0, "<to be found>").when(k % 11 == 0, "ftp:/x").otherwise(F.concat(F.lit("https://s"), k, F.lit(".org/data")))
    return s.select(
        F.when(k % 13 == 0, F.concat(F.lit("Source "), k)).otherwise(F.concat(F.lit("source_"), (k / 2).cast("int"))).alias("id"), F.when(k % 17 != 0, "supply").alias("module"), F.col("s_name").alias("publisher"), url.alias("url"),
        F.when(k % 3 == 0, "have").otherwise("wanted").alias("status"), F.when(k % 2 == 0, "ab12").alias("sha256"), F.lit("2024-01-01").alias("retrieved_on"), F.element_at(F.array(*[F.lit(x) for x in "VSKDX"]), (k % 5 + 1).cast("int")).alias("confidence"),
    )


def source_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(sources(spark, sf_dir), "sources", "id", validation.source_rules())


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The studies that parameters name: used for those parameters, and for one that does not exist where their number is odd."""
    p = parameters(spark, sf_dir).where("source IS NOT NULL")
    g = p.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("id")), ";").alias("ids"), F.count_distinct("id").alias("n"))
    return g.select(
        F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "_").alias("ref_id"), F.concat("ids", F.when(F.col("n") % 2 == 1, ";unknown_id").otherwise("")).alias("used_for"), F.when(F.col("n") % 3 == 0, "20x4").otherwise("2024").alias("year"),
        F.when(F.col("n") % 5 == 0, "doi:1").otherwise("10.1000/x").alias("doi"), F.lit("https://a.org/x").alias("url"), F.when(F.col("n") % 4 == 0, "https://a.org/1;https://www.a.org/2").otherwise("https://a.org/1;https://b.org/2").alias("evidence"),
    )


def reference_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = references(spark, sf_dir)
    own = validation.validate(r, "references", "ref_id", validation.reference_rules())
    return own.unionByName(validation.reference_links(r, parameters(spark, sf_dir).select("id", "source").distinct(), F.lit(True)))


def evidence_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quoted readings among the parameters as evidence of the parts of their number."""
    p = parameters(spark, sf_dir).where("page IS NOT NULL OR quote IS NOT NULL")
    e = p.select(F.col("id").alias("evidence_id"), "page", "quote", (F.length("id") * F.length("parameter")).alias("part"), "confidence")
    parts = table(spark, sf_dir, "part").where("p_size > 5")
    return validation.validate(e, "evidence", "evidence_id", [*validation.required("evidence_id"), *validation.page_rules(), validation.one_of("confidence", validation.FLAGS)], links=[("part", parts, "p_partkey")])


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    season = k % 2 == 0
    label = F.when(season, F.format_string("%04d/%02d", y, (y + F.when(k % 19 == 0, 2).otherwise(1)) % 100)).otherwise(y.cast("string"))
    q = F.element_at(F.array(*[F.lit(x) for x in ("biogas", "vinasse", "cake", "cofeed", "steam")]), (k % 5 + 1).cast("int"))
    return o.select(
        k.cast("string").alias("row_id"), F.col("o_custkey").cast("string").alias("plant_id"), F.when(season, "safra").otherwise("calendar").alias("period_kind"), label.alias("period"),
        F.when(season, F.format_string("%04d-04", y)).otherwise(F.format_string("%04d-01", y)).alias("start_month"), F.when(season, F.format_string("%04d-03", y + 1)).otherwise(F.format_string("%04d-12", y)).alias("end_month"),
        q.alias("quantity"), F.when(k % 5 == 1, "m3").when(k % 5 == 0, "Nm3").otherwise("t").alias("unit"), F.when(k % 23 == 0, "about 5").otherwise(F.round(F.col("o_totalprice") - 20000, 2).cast("string")).alias("value"),
        F.when(k % 29 != 0, (k % 90).cast("string")).alias("page"), F.when(k % 31 != 0, F.col("o_clerk") if "o_clerk" in o.columns else F.col("o_orderpriority")).alias("quote"), F.lit("S").alias("confidence"),
    )


def reported_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reported(spark, sf_dir)
    return validation.validate(r, "reported", "row_id", validation.reported_rules()).unionByName(validation.reported_conflicts(r))


def mill_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    mills = table(spark, sf_dir, "supplier").select(
        k.alias("mill_id"), F.when(k % 9 != 0, F.col("s_name")).alias("name"), F.when(k % 4 == 0, "S1").when(k % 21 == 0, "S9").otherwise("S0").alias("strategy"), F.lit(1.0).alias("share_vinasse"), (k % 10 / 8).alias("share_cake"), F.lit(0.2).alias("share_straw"),
        F.when(k % 8 == 0, 0.4).alias("store_share"), F.lit(0.03).alias("loss"),
    )
    years = chain.mill_years(spark, sf_dir).where("cane_t < 3000").withColumn("source", F.when(F.col("mill_id") % 6 != 0, "report"))
    return validation.mill_issues(mills, years, [1996, 1997])


ALL = (registry.param_issues, project_issues, source_issues, reference_issues, evidence_issues, reported_issues, mill_issues)


def registry_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files in strict mode."""
    return validation.verdict(reduce(DataFrame.unionByName, [f(spark, sf_dir) for f in ALL]), strict=True)


def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six sections of counts."""
    p, r, s = parameters(spark, sf_dir), reported(spark, sf_dir), sources(spark, sf_dir)
    return validation.registry_summary({
        "parameters": (p, "module", "confidence"), "sources": (s, "module", "status"), "projects": (projects(spark, sf_dir), "feedstock", "confidence"),
        "references": (references(spark, sf_dir), "year", "doi"), "evidence": (p.where("page IS NOT NULL OR quote IS NOT NULL"), "module", "confidence"), "reported": (r, "quantity", "period_kind"),
    })


def used_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the readings whose number is among the chain's factors; ids of the chain itself are no readings here."""
    p = parameters(spark, sf_dir).select("id", "confidence")
    return validation.used_flags(p, [*scenario.needed_ids()[:3], "lhv_000001", "lhv_000002", "rem_cod_000004", "hrt_000005"])


QUERIES = {f.__name__: f for f in (*ALL[1:], registry_verdict, registry_summary, used_flags)}
_I = lambda file, row, rules, src: " UNION ALL ".join(f"SELECT '{file}' AS file, {row}::VARCHAR AS row, '{lv}' AS level, {msg} AS message FROM {src} WHERE {cond}" for lv, cond, msg in rules)
_B = lambda c: f"coalesce(trim({c}::VARCHAR), '') = ''"
_REQ = lambda *cs: [("error", _B(c), f"'{c} is missing'") for c in cs]
_FLAG = ("error", "NOT coalesce(confidence IN ('V', 'S', 'K', 'D'), false)", "'confidence is none of V, S, K, D: ' || coalesce(confidence, '')")
_PAGE = [("error", "NOT coalesce(regexp_matches(trim(page), '^[1-9]\\d*$'), false)", "'page is no positive whole number'"), ("error", _B("quote"), "'quote is missing'")]
_UNIQ = lambda file, key, src: f"SELECT '{file}', {key}::VARCHAR, 'error', '{key} is used by ' || count(*) || ' rows' FROM {src} WHERE NOT ({_B(key)}) GROUP BY {key} HAVING count(*) > 1"
_PR = f"pr AS (SELECT DISTINCT * FROM {PROJECTS}), pu AS (SELECT *, replace(replace(lower(trim(capacity_unit)), ' ', ''), '³', '3') AS u FROM pr)"
_GF = "regexp_matches(u, '" + validation.GAS_FLOW + "')"
_PROJECT = _I("projects", "id", [*_REQ("id", "source"), _FLAG, ("error", "capacity_value <= 0", "'capacity_value is not above 0'"), ("error", f"capacity_value IS NOT NULL AND {_B('capacity_unit')}", "'capacity without unit'"),
    ("warning", f"capacity_value IS NULL AND NOT ({_B('capacity_unit')})", "'unit without capacity'"), ("warning", f"NOT ({_B('capacity_unit')}) AND NOT {_GF}", "'capacity is no gas flow'"), ("warning", f"{_GF} AND starts_with(u, 'm3')", "'gas flow without reference conditions'"),
    ("error", "investment_total_brl_m < 0", "'investment_total_brl_m is below 0'"), ("error", "bndes_brl_m < 0", "'bndes_brl_m is below 0'"), ("warning", "bndes_brl_m > investment_total_brl_m", "'loan above the investment'")], "pu") + " UNION ALL " + _UNIQ("projects", "id", "pr")
_SO = """so AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN 'Source ' || s_suppkey ELSE 'source_' || (s_suppkey // 2) END AS id, CASE WHEN s_suppkey % 17 <> 0 THEN 'supply' END AS module, s_name AS publisher,
 CASE WHEN s_suppkey % 7 = 0 THEN '<to be found>' WHEN s_suppkey % 11 = 0 THEN 'ftp:/x' ELSE 'https://s' || s_suppkey || '.org/data' END AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'have' ELSE 'wanted' END AS status,
 CASE WHEN s_suppkey % 2 = 0 THEN 'ab12' END AS sha256, '2024-01-01' AS retrieved_on, substr('VSKDX', (s_suppkey % 5 + 1)::INT, 1) AS confidence FROM supplier)"""
_SOURCE = _I("sources", "id", [*_REQ("id", "module", "publisher"), ("warning", "NOT regexp_matches(id, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$')", "'id is no snake_case: ' || id"), _FLAG, ("warning", "starts_with(url, '<')", "'url is a placeholder'"),
    ("error", "NOT starts_with(url, '<') AND NOT regexp_matches(url, '^https?://[^\\s/]+\\.[^\\s]+$')", "'url is no web address'"), ("warning", f"status = 'have' AND {_B('sha256')}", "'download is not recorded'")], "so") + " UNION ALL " + _UNIQ("sources", "id", "so")
_PA = "pa AS (SELECT DISTINCT * FROM parameters)"
_RF = """rf0 AS (SELECT source, string_agg(DISTINCT id, ';' ORDER BY id) AS ids, count(DISTINCT id) AS n FROM pa WHERE source IS NOT NULL GROUP BY 1),
 rf AS (SELECT regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g') AS ref_id, ids || CASE WHEN n % 2 = 1 THEN ';unknown_id' ELSE '' END AS used_for, CASE WHEN n % 3 = 0 THEN '20x4' ELSE '2024' END AS year, CASE WHEN n % 5 = 0 THEN 'doi:1' ELSE '10.1000/x' END AS doi, n FROM rf0),
 us AS (SELECT DISTINCT ref_id, unnest(string_split(used_for, ';')) AS id FROM rf)"""
_REFERENCE = _I("references", "ref_id", [*_REQ("ref_id", "used_for"), ("error", "NOT regexp_matches(ref_id, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$')", "'ref_id is no snake_case: ' || ref_id"), ("error", "year = '20x4'", "'year is not four digits'"), ("error", "doi = 'doi:1'", "'doi is no doi: doi:1'"),
    ("error", "n % 4 = 0", "'two sources need two domains, found 1'")], "rf") + " UNION ALL " + _UNIQ("references", "ref_id", "rf") + """ UNION ALL SELECT 'references', ref_id, 'error', 'used for an unknown parameter: ' || id FROM us WHERE id NOT IN (SELECT id FROM pa)
    UNION ALL SELECT DISTINCT 'references', id, 'warning', 'cites a paper that no reference names' FROM pa WHERE (contains(source, 'et al') OR regexp_matches(source, '\\b10\\.\\d{4,9}/\\S')) AND id NOT IN (SELECT id FROM us)"""  # fmt: skip
_EV = "ev AS (SELECT id AS evidence_id, page, quote, length(id) * length(parameter) AS part, confidence FROM pa WHERE page IS NOT NULL OR quote IS NOT NULL)"
_EVIDENCE = _I("evidence", "evidence_id", [*_REQ("evidence_id"), *_PAGE, _FLAG], "ev") + " UNION ALL " + _UNIQ("evidence", "evidence_id", "ev") + " UNION ALL SELECT 'evidence', evidence_id, 'error', 'part is unknown: ' || part FROM ev WHERE part IS NOT NULL AND part NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)"
_RP = """rp AS (SELECT o_orderkey::VARCHAR AS row_id, o_custkey::VARCHAR AS plant_id, CASE WHEN o_orderkey % 2 = 0 THEN 'safra' ELSE 'calendar' END AS period_kind, year(o_orderdate) AS y,
 CASE WHEN o_orderkey % 2 = 0 THEN printf('%04d/%02d', year(o_orderdate), (year(o_orderdate) + CASE WHEN o_orderkey % 19 = 0 THEN 2 ELSE 1 END) % 100) ELSE year(o_orderdate)::VARCHAR END AS period,
 CASE o_orderkey % 5 WHEN 0 THEN 'biogas' WHEN 1 THEN 'vinasse' WHEN 2 THEN 'cake' WHEN 3 THEN 'cofeed' ELSE 'steam' END AS quantity, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE round(o_totalprice - 20000, 2) END AS v,
 CASE WHEN o_orderkey % 29 <> 0 THEN (o_orderkey % 90)::VARCHAR END AS page, CASE WHEN o_orderkey % 31 <> 0 THEN o_orderpriority END AS quote, o_orderkey % 19 = 0 AND o_orderkey % 2 = 0 AS odd FROM orders)"""
_REPORTED = _I("reported", "row_id", [("error", "odd", "'period label does not fit its kind'"), ("error", "quantity = 'steam'", "'unknown quantity'"), ("error", "v IS NULL", "'value is no number'"), ("error", "v < 0", "'value is below 0'"), *_PAGE], "rp") + """ UNION ALL
    SELECT 'reported', min(row_id), 'warning', 'values differ: ' || count(v) || ' of ' || quantity FROM rp GROUP BY plant_id, period_kind, period, quantity HAVING count(v) > 1 AND (max(v) - min(v)) / nullif(greatest(abs(max(v)), abs(min(v))), 0) > 0.01"""
_MI = f"""{chain._CANE}, mi AS (SELECT s_suppkey AS mill_id, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'S1' WHEN s_suppkey % 21 = 0 THEN 'S9' ELSE 'S0' END AS strategy, s_suppkey % 10 / 8e0 AS share_cake FROM supplier), yr AS (SELECT * FROM cane WHERE cane_t < 3000)"""
_MILL = _I("mills", "mill_id", [*_REQ("mill_id", "name"), ("error", "strategy = 'S9'", "'strategy is none of S0, S1: S9'"), ("error", "share_cake > 1", "'share_cake is no share'"), ("missing", "strategy = 'S1' AND mill_id % 8 <> 0", "'storage settings'")], "mi") + """ UNION ALL
    SELECT 'mills', mill_id::VARCHAR, 'missing', 'cane of ' || y FROM mi, (SELECT unnest([1996, 1997]) AS y) q WHERE NOT EXISTS (SELECT 1 FROM yr WHERE yr.mill_id = mi.mill_id AND crop_year = y)
    UNION ALL SELECT 'mills', mill_id::VARCHAR, 'error', 'cane of ' || crop_year || ' needs a source and must not be negative' FROM yr WHERE mill_id % 6 = 0"""
_PARAM = registry.SQL["param_issues"]
_CT = lambda name, src, a, b: f"SELECT '{name}' AS section, coalesce(r, 'total') AS row_label, coalesce(c, 'total') AS column_label, count(*) AS n FROM (SELECT coalesce({a}, 'missing') AS r, coalesce({b}, 'missing') AS c FROM {src}) GROUP BY CUBE (r, c)"
_TABLES = f"{_PR}, {_SO}, {_PA}, {_RF}, {_EV}, {_RP}, {_MI}"
SQL = {
    "project_issues": f"WITH {_PR} {_PROJECT}",
    "source_issues": f"WITH {_SO} {_SOURCE}",
    "reference_issues": f"WITH {_PA}, {_RF} {_REFERENCE}",
    "evidence_issues": f"WITH {_PA}, {_EV} {_EVIDENCE}",
    "reported_issues": f"WITH {_RP} {_REPORTED}",
    "mill_issues": f"WITH {_MI} {_MILL}",
    "registry_verdict": f"WITH {_TABLES}, a AS (SELECT * FROM ({_PARAM}) UNION ALL {_PROJECT} UNION ALL {_SOURCE} UNION ALL {_REFERENCE} UNION ALL {_EVIDENCE} UNION ALL {_REPORTED} UNION ALL {_MILL}) SELECT file, sum((level = 'error')::INT)::BIGINT AS errors, sum((level = 'warning')::INT)::BIGINT AS warnings, sum((level IN ('error', 'warning'))::INT) = 0 AS passes FROM a GROUP BY 1",
    "registry_summary": f"WITH {_TABLES} " + " UNION ALL ".join([_CT("parameters", "pa", "module", "confidence"), _CT("sources", "so", "module", "status"), _CT("projects", "pr", "feedstock", "confidence"), _CT("references", "rf", "year", "doi"), _CT("evidence", "(SELECT * FROM pa WHERE page IS NOT NULL OR quote IS NOT NULL)", "module", "confidence"), _CT("reported", "rp", "quantity", "period_kind")]),
    "used_flags": "WITH u(id) AS (VALUES ('ethanol_yield'), ('vin_gen'), ('fc_gen'), ('lhv_000001'), ('lhv_000002'), ('rem_cod_000004'), ('hrt_000005')), p AS (SELECT DISTINCT id, confidence FROM parameters) SELECT coalesce(confidence, 'unknown') AS confidence, count(*) AS n FROM u LEFT JOIN p USING (id) GROUP BY 1",
}
