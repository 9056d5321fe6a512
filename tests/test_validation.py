from pyspark.sql import functions as F

from sucrogas.operators import calibrate, validation


def got(df):
    return sorted((r.row or "", r.level, r.message) for r in df.collect())


def test_projects(spark):
    schema = "id string, source string, confidence string, capacity_value double, capacity_unit string, investment_total_brl_m double, bndes_brl_m double, extra string"
    rows = [("a", "x", "V", 5.0, "Nm³/d", 10.0, 12.0, "e"), ("b", " ", "Q", -1.0, None, -3.0, None, None), ("c", "x", "S", None, "MW", None, None, None), ("d", "x", "K", 1.0, "m3/h", None, None, None), ("d", "x", "K", 1.0, "Nm3/h", None, None, None), (None, "x", "K", None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert got(validation.validate(df, "p", "id", validation.project_rules())) == sorted([
        ("a", "warning", "loan above the investment"), ("b", "error", "source is missing"), ("b", "error", "confidence is none of V, S, K, D: Q"), ("b", "error", "capacity_value is not above 0"), ("b", "error", "capacity without unit"),
        ("b", "error", "investment_total_brl_m is below 0"), ("c", "warning", "unit without capacity"), ("c", "warning", "capacity is no gas flow"), ("d", "warning", "gas flow without reference conditions"), ("d", "error", "id is used by 2 rows"), ("", "error", "id is missing"),
    ])
    assert validation.validate(df.limit(0), "p", "id", validation.project_rules()).collect() == []


def test_periods_and_reported_values(spark):
    df = spark.createDataFrame([("safra", "2023/24"), ("safra", "2023/25"), ("safra", "1999/00"), ("calendar", "2023"), ("calendar", "2023/24"), (None, None)], "k string, p string")
    a, b = validation.period_bounds(F.col("k"), F.col("p"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("2023-04", "2024-03"), (None, None), ("1999-04", "2000-03"), ("2023-01", "2023-12"), (None, None), (None, None)]
    schema = "row_id string, plant_id string, period_kind string, period string, start_month string, end_month string, quantity string, unit string, value string, page string, quote string, confidence string"
    base = ("p", "safra", "2023/24", "2023-04", "2024-03", "biogas", "Nm3")
    rows = [("1", *base, "100", "3", "q", "V"), ("2", *base, "103", "3", "q", "V"), ("3", "p", "safra", "2023/24", "2023-01", "2024-03", "biogas", "t", "x", "0", None, "V"), ("4", "p", "calendar", "2023", "2023-01", "2023-12", "cake", "t", "5", "1", "q", "V"), ("5", "p", "calendar", "2023", "2023-01", "2023-12", "cake", "t", "5.04", "1", "q", "V")]
    r = spark.createDataFrame(rows, schema)
    assert {m for row, _, m in got(validation.validate(r, "reported", "row_id", validation.reported_rules())) if row == "3"} == {"months do not fit the period", "unit should be Nm3", "value is no number", "page is no positive whole number", "quote is missing"}
    assert got(validation.reported_conflicts(r)) == [("1", "warning", "values differ: 2 of biogas")]


def test_references_and_links(spark):
    refs = spark.createDataFrame([("a_b", "p1; p9;", "https://x.org/1;https://www.x.org/2"), ("c_d", "p2", "https://x.org/1; https://y.org"), ("e_f", None, None)], "ref_id string, used_for string, evidence string")
    params = spark.createDataFrame([("p1", "Silva et al. 2020"), ("p2", "x"), ("p3", "10.1000/abc study"), ("p4", None)], "id string, source string")
    found = got(validation.reference_links(refs, params, F.col("ref_id") != "e_f"))
    assert found == [("a_b", "error", "two sources need two domains, found 1"), ("a_b", "error", "used for an unknown parameter: p9"), ("p3", "warning", "cites a paper that no reference names")]


def test_mills_and_verdict(spark):
    mills = spark.createDataFrame([("m", "M", "S1", 1.0, 0.5, 0.2, None, 0.1), ("n", None, "S0", 1.5, 0.5, None, None, None)], "mill_id string, name string, strategy string, share_vinasse double, share_cake double, share_straw double, store_share double, loss double")
    years = spark.createDataFrame([("m", 2024, 5.0, "r"), ("n", 2024, None, None), ("n", 2023, 4.0, " ")], "mill_id string, crop_year int, cane_t double, source string")
    issues = validation.mill_issues(mills, years, [2024])
    assert got(issues) == sorted([("m", "missing", "storage settings"), ("n", "error", "name is missing"), ("n", "error", "share_vinasse is no share"), ("n", "error", "share_straw is no share"), ("n", "missing", "cane of 2024"), ("n", "error", "cane of 2023 needs a source and must not be negative")])
    only = issues.where("level = 'missing'").withColumn("level", F.lit("warning"))
    assert validation.verdict(only).first().passes and not validation.verdict(only, strict=True).first().passes and not validation.verdict(issues).first().passes


def test_curve_problems(spark):
    rows = [("a", 0, 0.0), ("a", 2, 5.0), ("a", 1, 6.0), ("b", 1, 1.0), ("b", 1, 1.0), ("c", 0, None), ("c", -1, 3.0), ("c", 1, float("nan")), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, day int, y double")
    assert {tuple(r) for r in calibrate.load_problems(df, ["k"]).collect()} == {("a", "falls from the day before", 2), ("b", "day repeated", 1), ("b", "no day 0", None), ("c", "no value", 0), ("c", "day below zero", -1), ("c", "no value", 1), ("d", "no day", None), ("d", "no day 0", None)}
    assert calibrate.load_problems(df.limit(0), ["k"]).collect() == []
