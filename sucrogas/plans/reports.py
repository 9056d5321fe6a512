"""Extraction from the documents: heads, anchored series, values in phrases, records per year and their checks, lists; with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.operators import extract
from sucrogas.plans import registry
from sucrogas.session import table

HEAD = {
    "number": r"(?:^|\n)[A-ZÇÃÉÍÓ]{3,}[A-ZÇÃÉÍÓ ]* (\d{4})\r?(?:\n|$)", "first_section": r"(?:^|\n)1\. ([^\r\n]+)", "season": r"(?:safra|crop year|zafra) (\d{4}/\d{2})", "cnpj": r"(\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2})",
}
VARIABLES = {
    "cane_pt": (r"(\d[\d.]*) t de cana na safra (\d{4}/\d{2})", "t"), "cane_en": (r"(\d[\d,]*) t of cane in crop year (\d{4}/\d{2})", "t"), "cane_es": (r"(\d[\d.]*) t de caña en la zafra (\d{4}/\d{2})", "t"),
}
UNITS = {"cane_pt": "t", "cane_en": "kt", "cane_es": "t"}
BANDS = {"cane_pt": (1000.0, 200000.0), "cane_en": (1000.0, 200000.0)}
_HEADER = r"^\d{1,2}\. \S"
_ROW = r"^(\d{2}/\d{4});(\d[\d.]*);([^;]*)"
_ITEM = r"^(?:•|[a-z]\)|-)\s+(.+)$"
_DONE = r"(?i)^(?:•|[a-z]\)|-)\s+(?:verificar|check|verify)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.pages(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.header_fields(_pages(spark, sf_dir), "doc_id", HEAD)


def anchored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three cells with the line above their block; lines on three or more pages are running heads."""
    ln = extract.lines(_pages(spark, sf_dir), "doc_id")
    return extract.anchored_rows(ln, "doc_id", _ROW, ["first", "second", "third"], extract.furniture(ln, "doc_id", 3)).select("doc_id", "anchor", "block", "page", "line", "first", "second", "third")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.phrase_values(_pages(spark, sf_dir), "doc_id", VARIABLES)


def phrase_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir)


def repeated_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.repeated_figures(_values(spark, sf_dir), "doc_id")


def year_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.year_records(_values(spark, sf_dir), "doc_id")


def record_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.regexp_replace("value_text", "[.,]", "").try_cast("double")
    return extract.record_issues(_values(spark, sf_dir), _pages(spark, sf_dir), "doc_id", value, UNITS, BANDS, 0.01)


def listed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln = extract.lines(_pages(spark, sf_dir), "doc_id")
    return extract.listed_items(ln, "doc_id", F.col("line_text").rlike(_HEADER), _ITEM, _DONE)


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per region with a table of its nations."""
    row = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey"), F.lit(" |  |"))
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("t"))
    p = n.select("n_regionkey", F.lit(1).alias("page"), F.concat(F.lit("Nations\n| name | key | note |\n|---|:--|---|\n"), "t").alias("page_text"))
    return extract.table_cells(extract.lines(p, "n_regionkey"), "n_regionkey")


def figure_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit words behind the numbers of the documents: how often, in how many documents."""
    t = text.number_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    u = t.select("doc_id", text.unit_behind(F.substring(F.col("text"), F.col("end_at") + 1, F.lit(24))).alias("unit"))
    return u.groupBy("unit").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


QUERIES = {f.__name__: f for f in (header_fields, anchored_rows, phrase_values, repeated_figures, year_records, record_issues, listed_items, table_cells, figure_units)}
_PG, _LN = registry._PAGES, registry._LINES
_PV = _PG + ", pv AS (" + " UNION ALL ".join(
    f"SELECT doc_id, page, '{n}' AS variable, unnest(range(0, len(v))) AS nth, unnest(v) AS value_text, unnest(p) AS period, '{u}' AS unit, unnest(q) AS quote FROM (SELECT doc_id, page, regexp_extract_all(page_text, '{r}', 1) AS v, regexp_extract_all(page_text, '{r}', 2) AS p, regexp_extract_all(page_text, '{r}', 0) AS q FROM pg)"
    for n, (r, u) in VARIABLES.items()
) + ")"
_RULES = [
    ("value is out of its band", "variable IN ('cane_pt', 'cane_en') AND NOT (n BETWEEN 1000 AND 200000)"), ("unit is not the variable''s", "variable = 'cane_en'"), ("value is given twice", "c > 1"), ("values differ", "(hi - lo) / nullif(hi, 0) > 0.01"),
]
_FU = _LN + ", nb AS (SELECT * FROM ln WHERE trim(line_text, ' ') <> ''), fu AS (SELECT doc_id, line_text FROM nb GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3)"
SQL = {
    "header_fields": f"WITH {_PG}, h AS (SELECT * FROM pg WHERE page <= 2) SELECT doc_id, " + ", ".join(f"arg_min(nullif(regexp_extract(page_text, '{p}', 1), ''), page) FILTER (WHERE regexp_extract(page_text, '{p}', 1) <> '') AS {n}" for n, p in HEAD.items()) + " FROM h GROUP BY 1",
    "anchored_rows": f"""WITH {_FU}, tx AS (SELECT *, regexp_matches(line_text, '{_ROW}') AS r FROM nb WHERE NOT EXISTS (SELECT 1 FROM fu WHERE fu.doc_id = nb.doc_id AND fu.line_text = nb.line_text)),
        mk AS (SELECT *, last_value(CASE WHEN NOT r THEN line_text END IGNORE NULLS) OVER w AS anchor, (r AND NOT coalesce(lag(r) OVER w, false))::BIGINT AS s FROM tx WINDOW w AS (PARTITION BY doc_id ORDER BY page, line)),
        bl AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY page, line)::BIGINT - 1 AS block FROM mk) SELECT doc_id, anchor, block, page, line, {', '.join(f"regexp_extract(line_text, '{_ROW}', {i}) AS {n}" for i, n in ((1, 'first'), (2, 'second'), (3, 'third')))} FROM bl WHERE r""",
    "phrase_values": f"WITH {_PV} SELECT doc_id, page, variable, nth, value_text, period, unit, quote FROM pv",
    "repeated_figures": f"""WITH {_PV}, g AS (SELECT doc_id, value_text, count(*) AS n, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages0, list_sort(list(DISTINCT page)) AS pl, count(DISTINCT variable) > 1 AS other_variable, count(DISTINCT unit) > 1 AS other_unit, count(DISTINCT period) > 1 AS other_period FROM pv GROUP BY 1, 2)
        SELECT doc_id, value_text, n, array_to_string(pl, ',') AS pages, other_variable, other_unit, other_period FROM g WHERE n > 1""",
    "year_records": f"WITH {_PV} SELECT doc_id, substr(period, 1, 4)::INT AS year, count(*) AS n, string_agg(variable || '=' || value_text || ' ' || unit || '@' || page, '; ' ORDER BY variable, page, nth) AS variables FROM pv GROUP BY 1, 2",
    "record_issues": f"""WITH {_PV}, x AS (SELECT *, regexp_replace(value_text, '[.,]', '', 'g')::DOUBLE AS n FROM pv), y AS (SELECT *, count(*) OVER (PARTITION BY doc_id, variable, period, value_text) AS c, min(n) OVER w AS lo, max(n) OVER w AS hi FROM x WINDOW w AS (PARTITION BY doc_id, variable, period))
        """ + " UNION ALL ".join(f"SELECT doc_id, variable, page, nth, '{r}' AS rule FROM y WHERE {c}" for r, c in _RULES),
    "listed_items": f"""WITH {_LN}, s AS (SELECT *, last_value(CASE WHEN regexp_matches(line_text, '{_HEADER}') THEN line_text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, line ROWS UNBOUNDED PRECEDING) AS section FROM ln)
        SELECT doc_id, section, page, line, trim(regexp_extract(line_text, '{_ITEM}', 1), ' ') AS item, regexp_matches(line_text, '{_DONE}') AS done FROM s WHERE regexp_matches(line_text, '{_ITEM}')""",
    "table_cells": """WITH n AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY '| ' || n_name) + 3 AS line, n_name, n_nationkey FROM nation), h AS (SELECT DISTINCT n_regionkey FROM nation)
        SELECT n_regionkey, 1 AS page, 2 AS line, cell, value FROM h, (VALUES (0, 'name'), (1, 'key'), (2, 'note')) v(cell, value) UNION ALL SELECT n_regionkey, 1, line, 0, n_name FROM n UNION ALL SELECT n_regionkey, 1, line, 1, n_nationkey::VARCHAR FROM n UNION ALL SELECT n_regionkey, 1, line, 2, '' FROM n""",
}
