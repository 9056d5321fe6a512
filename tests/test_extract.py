from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.operators import extract

TEXT = "BOLETIM 0042\nFirma X\n\n1. Moagem\nRunning head\n2019: 10\n\fRunning head\n\n2020: 20\nfim\n2021: 30\r\n\fRunning head\nsomou 1.200 t na safra 2019/20; depois 1.200 t na safra 2020/21\n"


def lines_of(spark, rows):
    paged = extract.pages(spark.createDataFrame(rows, "d int, t string"), "d", "t")
    return paged, extract.lines(paged, "d")


def test_head_series_and_furniture(spark):
    paged, ln = lines_of(spark, [(1, TEXT), (2, None), (3, "")])
    h = {r.d: (r.n, r.s) for r in extract.header_fields(paged, "d", {"n": r"BOLETIM (\d+)", "s": r"1\. ([^\r\n]+)"}).collect()}
    assert h == {1: ("0042", "Moagem"), 3: (None, None)}
    skip = extract.furniture(ln, "d", 3)
    assert [r.line_text for r in skip.collect()] == ["Running head"]
    rows = [(r.anchor, r.block, r.page, r.year, r.v) for r in extract.anchored_rows(ln, "d", r"^(\d{4}): (\d+)", ["year", "v"], skip).orderBy("block", "page", "line").collect()]
    assert rows == [("1. Moagem", 0, 1, "2019", "10"), ("1. Moagem", 0, 2, "2020", "20"), ("fim", 1, 2, "2021", "30")]
    # Without the list of running heads the page's first line ends the block.
    assert {r.anchor for r in extract.anchored_rows(ln, "d", r"^(\d{4}): (\d+)", ["year", "v"]).collect()} == {"Running head", "fim"}


def test_values_records_and_checks(spark):
    paged, _ = lines_of(spark, [(1, TEXT), (2, "somou 9 t na safra 2019/20")])
    v = extract.phrase_values(paged, "d", {"cane": (r"(\d[\d.]*) t na safra (\d{4}/\d{2})", "t")})
    assert sorted((r.d, r.page, r.nth, r.value_text, r.period) for r in v.collect()) == [(1, 3, 0, "1.200", "2019/20"), (1, 3, 1, "1.200", "2020/21"), (2, 1, 0, "9", "2019/20")]
    assert [(r.n, r.pages, r.other_period, r.other_unit) for r in extract.repeated_figures(v, "d").collect()] == [(2, "3", True, False)]
    assert {(r.d, r.year, r.variables) for r in extract.year_records(v, "d").collect()} == {(1, 2019, "cane=1.200 t@3"), (1, 2020, "cane=1.200 t@3"), (2, 2019, "cane=9 t@1")}
    extra = [(1, 9, "cane", 0, "7", "2022/23", "t", "7 t na safra 2022/23"), (1, 3, "cane", 7, "1.300", "2019/20", "kg", "somou 1.200 t"), (2, 1, "cane", 1, "9", "2019/20", "t", "somou 9 t na safra 2019/20")]
    all_ = v.unionByName(spark.createDataFrame(extra, "d int, page int, variable string, nth int, value_text string, period string, unit string, quote string"))
    number = F.replace("value_text", F.lit("."), F.lit("")).try_cast("double")
    issues = {(r.d, r.page, r.nth, r.rule) for r in extract.record_issues(all_, paged, "d", number, {"cane": "t"}, {"cane": (8.0, 5000.0)}, 0.01).collect()}
    assert issues == {
        (1, 9, 0, "page does not exist"), (1, 9, 0, "value is out of its band"), (1, 3, 7, "value is not in the quote"), (1, 3, 7, "period is not in the quote"), (1, 3, 7, "unit is not the variable's"),
        (1, 3, 7, "values differ"), (1, 3, 0, "values differ"), (2, 1, 0, "value is given twice"), (2, 1, 1, "value is given twice"),
    }


def test_lists_and_tables(spark):
    _, ln = lines_of(spark, [(1, "# Plan\n- [x] one\n- [ ] two\n| a | b |\n|---|:-:|\n| 1 |  |\n|")])
    items = [(r.section, r.item, r.done) for r in extract.listed_items(ln, "d", F.col("line_text").startswith("# "), r"^- \[.\] (.+)$", r"^- \[x\]").orderBy("line").collect()]
    assert items == [("# Plan", "one", True), ("# Plan", "two", False)]
    assert [(r.line, r.cell, r.value) for r in extract.table_cells(ln, "d").orderBy("line", "cell").collect()] == [(4, 0, "a"), (4, 1, "b"), (6, 0, "1"), (6, 1, "")]


def test_units_of_names_and_numbers(spark):
    df = spark.createDataFrame([(" m3/d total",), ("%",), (" Nm³ / h",), (". End",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.unit_behind(F.col("t"))).collect()] == ["m3/d", "%", "Nm³ / h", None, None, None]
    units = {"m3d": "m3/d", "d": "d"}
    assert text.column_unit("flow_m3d", units) == "m3/d" and text.column_unit("flow", units) is None
    assert text.columns_without_unit(["flow_m3d", "mass", "id"], units, ("id",), False) == ["mass"] and text.columns_without_unit(["mass"], units, (), True) == []
