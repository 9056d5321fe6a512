from datetime import date, datetime

from pyspark.sql import functions as F

from sucrogas.functions import cnpj
from sucrogas.operators.snapshots import latest, snapshot_changes

SCHEMA = "snapshot_date date, cnpj string, cap double, delivered_at timestamp, _key string, change string"
D = [date(2025, 1, 1), date(2025, 2, 10), date(2025, 3, 1), date(2025, 7, 1)]


def run(spark, rows):
    rows = [(d, k, v, datetime(2025, 1, 1, h), "clash", "clash") for d, k, v, h in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    out = snapshot_changes(df, "snapshot_date", cnpj.normalize(F.col("cnpj")), "cap", "delivered_at", 0.01)
    return sorted((str(r["snapshot_date"]), r["key"], r["change"]) for r in out.collect())


def test_added_removed_changed_returned(spark):
    a, b, c = "00000000000191", "11222333000181", "22333444000105"
    rows = [
        (D[0], "191.0", 5.0, 1), (D[1], "00.000.000/0001-91", 5.0003, 1), (D[2], a, None, 1), (D[3], a, 9.0, 1),
        (D[0], b, 1.0, 1), (D[2], b, 1.0, 1), (D[3], b, 2.0, 1), (D[3], b, 1.0, 2),
        (D[1], c, 1.0, 1), (D[2], c, 3.0, 1), (D[2], None, 3.0, 1), (D[0], "", 3.0, 1), (D[0], "no digits", 3.0, 1),
    ]
    assert run(spark, rows + rows) == sorted([
        (str(D[1]), b, "removed"), (str(D[2]), b, "added"),
        (str(D[1]), c, "added"), (str(D[2]), c, "changed"), (str(D[3]), c, "removed"),
    ])


def test_change_next_to_null_is_none_and_empty_table(spark):
    a = "00000000000191"
    assert run(spark, [(D[0], a, 1.0, 1), (D[1], a, None, 1), (D[2], a, 2.0, 1)]) == []
    assert run(spark, []) == []


def test_snapshot_without_keys_counts(spark):
    a = "00000000000191"
    assert run(spark, [(D[0], a, 1.0, 1), (D[1], None, 1.0, 1)]) == [(str(D[1]), a, "removed")]


def test_latest_takes_the_last_version_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, None, 7.0), (2, None, 8.0), (None, 9, 1.0)], "k int, v int, x double")
    assert sorted((r.k, r.x) for r in latest(df, ["k"], "v", ["x"]).collect()) == [(1, None), (2, 8.0)]


def test_cnpj(spark):
    df = spark.createDataFrame([("191.0",), ("CNPJ 11222333000181 ",), ("11.222.333/0001-82",), ("123456789012345",), ("",), (None,)], "c string")
    n = cnpj.normalize(F.col("c"))
    out = [(r.n, r.v) for r in df.select(n.alias("n"), cnpj.is_valid(n).alias("v")).collect()]
    assert out == [("00000000000191", True), ("11222333000181", True), ("11222333000182", False), (None, None), (None, None), (None, None)]
