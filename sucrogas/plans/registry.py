"""Registry, screening, quality and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sucrogas.functions import cnpj, text
from sucrogas.operators import extract, quality, sensitivity
from sucrogas.operators.ranks import quantiles as quantiles_of
from sucrogas.session import table

SNAPSHOTS = "anp_biomethane_plants_latest_from_pilar2b"


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parameters")


def param_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir).distinct()
    return quality.issues(p, "parameters", "id", quality.parameter_rules())


def factor_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir).select("id", F.col("central_value").alias("central"), F.col("low_value").alias("low"), F.col("high_value").alias("high")).distinct()
    return sensitivity.factor_space(p)


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return quality.duplicates(o, "o_custkey", "o_orderkey")


def dangling_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    big = table(spark, sf_dir, "part").where("p_size > 10")
    return quality.dangling(li, "l_partkey", big, "p_partkey")


def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    return quality.conflicts(o, ["o_custkey", "y"], "o_totalprice", 0.01)


def crosstab_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.crosstab(table(spark, sf_dir, "parameters").select("confidence", "module"), "confidence", "module")


def document_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.crosstab(table(spark, sf_dir, "documents").select("source", "lang"), "source", "lang")


def exclusion_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that depend on excluded ones; part n depends on part n // 3."""
    p = table(spark, sf_dir, "part")
    edges = p.where("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).cast("long").alias("depends_on"))
    return quality.closure(edges, p.where("p_size = 7").select(F.col("p_partkey").alias("node")))


def worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir).select("id", F.col("central_value").alias("central"), F.col("low_value").alias("low"), F.col("high_value").alias("high"), "confidence", "page", "quote", "parameter").distinct()
    pr = p.select("id", (F.length("parameter") % 7).alias("priority"))
    refs = _params(spark, sf_dir).select(F.col("source").alias("ref_id"), F.concat_ws("; ", "id", F.lit("")).alias("used_for")).where("ref_id IS NOT NULL").distinct()
    return sensitivity.worklist(p, pr, refs).select("id", "priority", "refs", "n_sources", "next_step")


def cnpj_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, SNAPSHOTS).select("cnpj").where("cnpj IS NOT NULL").distinct()
    k = cnpj.normalize(F.col("cnpj"))
    return s.select("cnpj", k.alias("normalized"), cnpj.is_valid(k).alias("valid"), cnpj.pretty(k).alias("formatted"))


def br_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir).select("id", "central").where("central IS NOT NULL").distinct()
    n = text.br_number(F.col("central"))
    return p.select("id", "central", text.br_decimal(F.col("central")).alias("decimal"), n["value"].alias("value"), n["ambiguous"].alias("ambiguous"), n["percent"].alias("percent"), text.br_integer(F.col("central")).alias("whole"))


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "municipalities")
    return m.select("ibge_code", text.name_key(F.col("municipio")).alias("name_key"), text.slug(F.col("municipio"), 20).alias("slug"), text.collapse_ws(F.col("municipio")).alias("clean"))


def value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir).select("id", "central").where("central IS NOT NULL").distinct()
    return p.select("id", text.pair(F.col("central")).alias("_p")).select("id", "_p.*")


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _params(spark, sf_dir).select("id", "source", "conditions").distinct()
    url = F.concat(F.lit("https://www."), F.replace(F.lower("source"), F.lit(" "), F.lit("-")), F.lit(".org/x?y=1"))
    return p.select("id", text.conforms(F.col("id"), "snake_case").alias("is_snake"), text.conforms(url, "http_url").alias("is_url"), text.url_domain(url).alias("domain"), text.sum_list(F.regexp_replace("conditions", " ", ";")).alias("total"))


def month_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    end = F.add_months("d", (F.col("o_orderkey") % 14).cast("int"))
    return o.select("o_orderkey", text.months_in(F.col("d"), end).alias("months"), text.days_in_month(F.col("d")).alias("days"), F.size(text.month_starts(F.col("d"), end)).alias("starts"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = extract.pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return p.select("doc_id", "page", F.length("page_text").alias("n_chars"), F.sha2("page_text", 256).alias("sha"))


_HEAD = r"^\d{1,2}\. \S"


def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines per section of every document."""
    p = extract.lines(extract.pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")
    s = extract.with_section(p, "doc_id", F.col("line_text").rlike(_HEAD))
    return s.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line_text")).alias("n_chars"))


_ROW = r"^(\d{2}/\d{4});(\d[\d.]*);([^;]*)"


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows "month;number;use" of the tables in the documents."""
    p = extract.lines(extract.pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text"), "doc_id")
    r = extract.labelled_numbers(p, "doc_id", _ROW)
    return r.select("doc_id", "page", "line", F.col("label").alias("month"), F.coalesce(text.br_integer(F.col("number")), F.col("number").try_cast("bigint")).alias("volume"), "unit")


_CUES = {"applied": r"aplicad|applied|fertirriga", "generated": r"gera |gerada|gerou|generat"}


def page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = extract.pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return extract.cue_class(p, "doc_id", _CUES, 1)


def quote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted table rows against the page they came from; every ninth quote is damaged."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = extract.pages(d, "doc_id", "text")
    r = extract.labelled_numbers(extract.lines(p, "doc_id"), "doc_id", _ROW).select("doc_id", "page", "line", F.col("number").alias("value_text"), F.concat_ws(";", "label", "number").alias("quote"))
    r = r.withColumn("quote", F.when(F.col("line") % 9 == 0, F.concat(F.lit("x"), "quote")).otherwise(F.col("quote")))
    v = extract.verify_quotes(r, p, "doc_id")
    return v.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.sum(F.col("quote_found").cast("long")).alias("found"), F.sum(F.col("value_in_quote").cast("long")).alias("values_found"))


def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"))
    x = extract.plausible(o, {"price_per_unit": (F.round(F.try_divide(F.col("p"), F.col("q")), 6), 900.0, 1600.0), "discount": (F.round("d", 9), 0.02, 0.08)})
    return x.select("l_orderkey", "price_per_unit", "price_per_unit_ok", "discount", "discount_ok")


def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class breaks and half-even rounding."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    q = quantiles_of(c, ["c_mktsegment"], "c_acctbal", {f"q{i}": i / 100 for i in (20, 40, 60, 80)})
    ends = c.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("lowest"), F.max("c_acctbal").alias("highest"))
    return q.join(ends, "c_mktsegment").select("c_mktsegment", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in (20, 40, 60, 80)], "lowest", "highest", F.bround(F.floor("highest") + F.lit(0.5), 0).alias("half_even"))


def argmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best part per brand (ties: lowest key), and the brand's top three by price."""
    p = table(spark, sf_dir, "part")
    r = p.select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")).alias("r"))
    return r.where("r <= 3")


_P = "p AS (SELECT DISTINCT * FROM parameters)"
_PAGES = """pg0 AS (SELECT doc_id, string_split(text, chr(12)) AS a FROM documents WHERE text IS NOT NULL), pg1 AS (SELECT doc_id, CASE WHEN len(a) > 1 AND trim(a[-1]) = '' THEN a[1:len(a) - 1] ELSE a END AS a FROM pg0),
 pg AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS page, unnest(a) AS page_text FROM pg1)"""
_LINES = _PAGES + r""", ln0 AS (SELECT doc_id, page, regexp_split_to_array(page_text, '\r\n|\n|\r') AS b FROM pg), ln AS (SELECT doc_id, page, unnest(range(1, len(b) + 1)) AS line, unnest(b) AS line_text FROM ln0)"""
_FOLD = "translate(lower({c}), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn')"
_DIG = lambda i: f"substr(k, {i}, 1)::INT"
_S1 = " + ".join(f"{_DIG(i + 1)} * {w}" for i, w in enumerate(cnpj.WEIGHTS_1))
_S2 = " + ".join(f"{_DIG(i + 1)} * {w}" for i, w in enumerate(cnpj.WEIGHTS_2[:12]))
QUERIES = {f.__name__: f for f in (
    param_issues, factor_space, duplicate_ids, dangling_parts, value_conflicts, crosstab_totals, document_crosstab, exclusion_closure, worklist, cnpj_checks, br_numbers,
    name_keys, value_pairs, validators, month_functions, document_pages, section_lines, table_rows, page_context, quote_checks, plausibility, quantiles, argmax_rows,
)}
SQL = {
    "param_issues": f"""WITH {_P}, n AS (SELECT *, try_cast(low AS DOUBLE) AS lo, try_cast(central AS DOUBLE) AS ce, try_cast(high AS DOUBLE) AS hi FROM p), i AS (
        SELECT id, 'error' AS level, 'id is missing' AS message FROM n WHERE id IS NULL OR trim(id) = ''
        UNION ALL SELECT id, 'error', 'unknown confidence flag ' || coalesce(confidence, '') FROM n WHERE confidence NOT IN ('V', 'S', 'K', 'D')
        UNION ALL SELECT id, 'error', 'confidence is missing' FROM n WHERE confidence IS NULL
        UNION ALL SELECT id, 'error', 'unit is missing' FROM n WHERE unit IS NULL OR trim(unit) = ''
        UNION ALL SELECT id, 'error', 'low, central and high are not in order' FROM n WHERE lo > ce OR ce > hi OR lo > hi
        UNION ALL SELECT id, 'warning', 'central is no plain number' FROM n WHERE central IS NOT NULL AND ce IS NULL
        UNION ALL SELECT id, 'error', 'verified without page and quote' FROM n WHERE confidence = 'V' AND (page IS NULL OR quote IS NULL)
        UNION ALL SELECT id, 'error', 'verified_on is no date' FROM n WHERE verified_on IS NOT NULL AND NOT regexp_matches(verified_on, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$'))
        SELECT 'parameters' AS file, id AS row, level, message FROM i""",
    "factor_space": f"""WITH f AS (SELECT DISTINCT id, central_value AS central, low_value AS low, high_value AS high FROM parameters), r AS (SELECT *, CASE WHEN central IS NULL THEN 'no central value' WHEN low IS NULL OR high IS NULL THEN 'no range'
        WHEN low > high THEN 'range is inverted' WHEN low = high THEN 'range is empty' WHEN central < low OR central > high THEN 'central value outside its range' END AS excluded_because FROM f) SELECT *, excluded_because IS NULL AS is_factor FROM r""",
    "duplicate_ids": "SELECT * FROM (SELECT o_custkey, o_orderkey, count(*) OVER w AS n, min(o_orderkey) OVER w AS first_line FROM orders WINDOW w AS (PARTITION BY o_custkey)) WHERE n > 1",
    "dangling_parts": "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)",
    "value_conflicts": "SELECT o_custkey, year(o_orderdate) AS y, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, count(*) AS n FROM orders GROUP BY 1, 2 HAVING (max(o_totalprice) - min(o_totalprice)) / nullif(max(o_totalprice), 0) > 0.01",
    "crosstab_totals": "WITH l AS (SELECT coalesce(confidence, 'missing') AS r, coalesce(module, 'missing') AS c FROM parameters) SELECT coalesce(r, 'total') AS row_label, coalesce(c, 'total') AS column_label, count(*) AS n FROM l GROUP BY CUBE (r, c)",
    "document_crosstab": "WITH l AS (SELECT coalesce(source, 'missing') AS r, coalesce(lang, 'missing') AS c FROM documents) SELECT coalesce(r, 'total') AS row_label, coalesce(c, 'total') AS column_label, count(*) AS n FROM l GROUP BY CUBE (r, c)",
    "exclusion_closure": """WITH RECURSIVE r AS (SELECT p_partkey AS node, 0 AS steps FROM part WHERE p_size = 7 UNION SELECT p.p_partkey, r.steps + 1 FROM r JOIN part p ON p.p_partkey // 3 = r.node AND p.p_partkey > 0)
        SELECT node, min(steps) AS steps FROM r GROUP BY 1""",
    "worklist": """WITH p AS (SELECT DISTINCT id, central_value AS ce, low_value AS lo, high_value AS hi, confidence, page, quote, parameter FROM parameters), r AS (SELECT id, string_agg(DISTINCT source, ';' ORDER BY source) AS refs, count(DISTINCT source) AS n FROM parameters WHERE source IS NOT NULL GROUP BY 1),
        x AS (SELECT p.*, CASE WHEN ce IS NULL THEN 'no central value' WHEN lo IS NULL OR hi IS NULL THEN 'no range' WHEN lo > hi THEN 'range is inverted' WHEN lo = hi THEN 'range is empty' WHEN ce < lo OR ce > hi THEN 'central value outside its range' END AS why FROM p)
        SELECT x.id, length(parameter) % 7 AS priority, refs, coalesce(n, 0) AS n_sources, CASE WHEN confidence = 'V' THEN 'none: verified' WHEN page IS NOT NULL AND quote IS NOT NULL THEN 'check the quoted page' WHEN coalesce(n, 0) = 0 THEN 'find a source'
        WHEN n = 1 THEN 'find a second source' WHEN why IS NOT NULL THEN 'give a range: ' || why ELSE 'compare the sources' END AS next_step FROM x LEFT JOIN r USING (id)""",
    "cnpj_checks": f"""WITH k AS (SELECT DISTINCT cnpj, lpad(regexp_replace(regexp_replace(trim(cnpj), '\\.0+$', ''), '[^0-9]', '', 'g'), 14, '0') AS k FROM {SNAPSHOTS} WHERE cnpj IS NOT NULL),
        a AS (SELECT *, CASE WHEN ({_S1}) % 11 < 2 THEN 0 ELSE 11 - ({_S1}) % 11 END AS d1 FROM k), b AS (SELECT *, CASE WHEN ({_S2} + d1 * 2) % 11 < 2 THEN 0 ELSE 11 - ({_S2} + d1 * 2) % 11 END AS d2 FROM a)
        SELECT cnpj, k AS normalized, d1::VARCHAR || d2::VARCHAR = substr(k, 13, 2) AS valid, substr(k, 1, 2) || '.' || substr(k, 3, 3) || '.' || substr(k, 6, 3) || '/' || substr(k, 9, 4) || '-' || substr(k, 13, 2) AS formatted FROM b""",
    "br_numbers": r"""WITH p AS (SELECT DISTINCT id, central, trim(regexp_replace(trim(central), '\s*%\s*$', '')) AS n FROM parameters WHERE central IS NOT NULL),
        q AS (SELECT *, regexp_matches(n, '^[-+]?\d{1,3}(\.\d{3})+(,\d+)?$') OR regexp_matches(n, '^[-+]?\d{1,3}( \d{3})+(,\d+)?$') AS g, regexp_matches(n, '^[-+]?\d+,\d+$') AS c, regexp_matches(n, '^[-+]?\d+$') AS i, regexp_matches(n, '^[-+]?\d+\.\d+$') AS d FROM p)
        SELECT id, central, try_cast(CASE WHEN contains(trim(central), ',') THEN replace(replace(trim(central), '.', ''), ',', '.') ELSE trim(central) END AS DOUBLE) AS decimal,
        CASE WHEN g OR c OR i THEN try_cast(replace(regexp_replace(n, '[. ]', '', 'g'), ',', '.') AS DOUBLE) WHEN d THEN try_cast(n AS DOUBLE) END AS value,
        regexp_matches(n, '^[-+]?[1-9]\d{0,2}\.\d{3}$') AS ambiguous, regexp_matches(trim(central), '%\s*$') AS percent,
        CASE WHEN regexp_matches(trim(central), '^-?\d{1,3}(\.\d{3})*$') THEN replace(trim(central), '.', '')::BIGINT END AS whole FROM q""",
    "name_keys": f"""WITH f AS (SELECT ibge_code, municipio, {_FOLD.format(c='municipio')} AS x FROM municipalities), s AS (SELECT *, regexp_replace(regexp_replace(x, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM f)
        SELECT ibge_code, trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) AS name_key, CASE WHEN length(s) <= 20 THEN s ELSE substr(s, 1, 11) || '_' || substr(sha256(municipio), 1, 8) END AS slug, trim(regexp_replace(municipio, '\\s+', ' ', 'g')) AS clean FROM s""",
    "value_pairs": r"""WITH p AS (SELECT DISTINCT id, central FROM parameters WHERE central IS NOT NULL), m AS (SELECT id, central, '^\s*(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)\s*$' AS two,
        '^\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)\s*-\s*(-?\d+(?:\.\d+)?)\s*$' AS four FROM p),
        g AS (SELECT id, try_cast(nullif(regexp_extract(central, '^\s*(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)\s*$', 1), '') AS DOUBLE) AS a, try_cast(nullif(regexp_extract(central, '^\s*(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)\s*$', 2), '') AS DOUBLE) AS b FROM m)
        SELECT id, a AS first_low, a AS first_high, b AS second_low, b AS second_high FROM g""",
    "validators": r"""WITH p AS (SELECT DISTINCT id, source, conditions, 'https://www.' || replace(lower(source), ' ', '-') || '.org/x?y=1' AS u FROM parameters), l AS (SELECT *, list_filter(list_transform(string_split(replace(conditions, ' ', ';'), ';'), lambda x: try_cast(trim(x) AS DOUBLE)), lambda x: x IS NOT NULL) AS t FROM p)
        SELECT id, regexp_matches(id, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') AS is_snake, regexp_matches(u, '^https?://[^\s/]+\.[^\s]+$') AS is_url, regexp_replace(regexp_extract(u, '^https?://([^/:?#]+)', 1), '^www\.', '') AS domain, CASE WHEN len(t) > 0 THEN list_sum(t) END AS total FROM l""",
    "month_functions": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate::DATE + to_months((o_orderkey % 14)::INT))::DATE AS e FROM orders)
        SELECT o_orderkey, (year(e) - year(d)) * 12 + month(e) - month(d) + 1 AS months, day(last_day(d)) AS days, len(generate_series(date_trunc('month', d), date_trunc('month', e), INTERVAL 1 MONTH)) AS starts FROM o""",
    "document_pages": f"WITH {_PAGES} SELECT doc_id, page, length(page_text) AS n_chars, sha256(page_text) AS sha FROM pg",
    "section_lines": f"""WITH {_LINES}, s AS (SELECT *, last_value(CASE WHEN regexp_matches(line_text, '^\\d{{1,2}}\\. \\S') THEN line_text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line ROWS UNBOUNDED PRECEDING) AS section FROM ln)
        SELECT doc_id, section, count(*) AS n_lines, sum(length(line_text))::BIGINT AS n_chars FROM s GROUP BY 1, 2""",
    "table_rows": f"""WITH {_LINES} SELECT doc_id, page, line, regexp_extract(line_text, '{_ROW}', 1) AS month, try_cast(CASE WHEN regexp_matches(regexp_extract(line_text, '{_ROW}', 2), '^\\d{{1,3}}(\\.\\d{{3}})*$')
        THEN replace(regexp_extract(line_text, '{_ROW}', 2), '.', '') ELSE regexp_extract(line_text, '{_ROW}', 2) END AS BIGINT) AS volume, regexp_extract(line_text, '{_ROW}', 3) AS unit FROM ln WHERE regexp_matches(line_text, '{_ROW}')""",
    "page_context": f"""WITH {_PAGES}, m AS (SELECT doc_id, page, max(regexp_matches(lower(page_text), '{_CUES['applied']}')::INT) OVER w AS a, max(regexp_matches(lower(page_text), '{_CUES['generated']}')::INT) OVER w AS g FROM pg
        WINDOW w AS (PARTITION BY doc_id ORDER BY page RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)) SELECT doc_id, page, CASE WHEN a + g = 1 THEN CASE WHEN a = 1 THEN 'applied' ELSE 'generated' END END AS context FROM m""",
    "quote_checks": f"""WITH {_LINES}, r AS (SELECT doc_id, page, line, regexp_extract(line_text, '{_ROW}', 2) AS v, CASE WHEN line % 9 = 0 THEN 'x' ELSE '' END || regexp_extract(line_text, '{_ROW}', 1) || ';' || regexp_extract(line_text, '{_ROW}', 2) AS q FROM ln WHERE regexp_matches(line_text, '{_ROW}')),
        j AS (SELECT r.*, contains(trim(regexp_replace(page_text, '\\s+', ' ', 'g')), trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS f, contains(regexp_replace(q, '[^0-9]', '', 'g'), regexp_replace(v, '[^0-9]', '', 'g')) AS w FROM r JOIN pg USING (doc_id, page))
        SELECT doc_id, page, count(*) AS n, sum(f::INT)::BIGINT AS found, sum(w::INT)::BIGINT AS values_found FROM j GROUP BY 1, 2""",
    "plausibility": """WITH o AS (SELECT l_orderkey, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0), 6) AS a, round(avg(l_discount), 9) AS d FROM lineitem GROUP BY 1)
        SELECT l_orderkey, a AS price_per_unit, a BETWEEN 900 AND 1600 AS price_per_unit_ok, d AS discount, d BETWEEN 0.02 AND 0.08 AS discount_ok FROM o""",
    "quantiles": """SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.2), 6) AS q20, round(quantile_cont(c_acctbal, 0.4), 6) AS q40, round(quantile_cont(c_acctbal, 0.6), 6) AS q60, round(quantile_cont(c_acctbal, 0.8), 6) AS q80, min(c_acctbal) AS lowest, max(c_acctbal) AS highest,
        round_even(floor(max(c_acctbal)) + 0.5, 0) AS half_even FROM customer GROUP BY 1""",
    "argmax_rows": "SELECT * FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3",
}
