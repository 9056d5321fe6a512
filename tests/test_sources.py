import json
import os

import pytest
from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.sources import files
from sucrogas.sources import registry_files as R


def test_csv_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿Mês;Valor;cod_ibge\n01/2024;1.234,5;0012\n02/2024;7,0;0013\n", encoding="utf-8")
    df = files.read_text_csv(spark, str(p), ["month", "value", "cod_ibge"], sep=";")
    typed = files.decimal_comma_columns(df)
    assert dict(typed.dtypes) == {"month": "string", "value": "double", "cod_ibge": "string"}
    assert [r.value for r in typed.orderBy("month").collect()] == [1234.5, 7.0]
    with pytest.raises(ValueError):
        files.read_text_csv(spark, str(p), ["month"], sep=";")


def test_specs(spark, tmp_path):
    for y in (2023, 2024):
        (tmp_path / f"t_{y}.csv").write_text(f"k,n,junk\na,{y},x\n")
    spec = files.TableSpec("t", tuple(str(tmp_path / f"t_{y}.csv") for y in (2023, 2024)), "src", drop=("junk",), integers=("n",), from_name={"year": r"_(\d{4})\."})
    assert files.plan_specs([spec, files.TableSpec("again", spec.paths, "src")], {"src"}) == [spec]
    with pytest.raises(ValueError, match="not registered.*denied"):
        files.plan_specs([files.TableSpec("u", ("/secret/x",), "other")], {"src"}, ["secret"])
    rows = files.read_spec(spark, spec).collect()
    assert sorted((r.n, r.year, r._source_file) for r in rows) == [(2023, "2023", "t_2023.csv"), (2024, "2024", "t_2024.csv")]


def test_needs_load(spark):
    s = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    ledger, cur = s([("a", "1"), ("b", "1"), ("d", "1")], "name string, input_hash string"), s([("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")], "name string, input_hash string")
    have = s([("a",), ("b",)], "name string")
    assert sorted(r.name for r in files.needs_load(ledger, cur, have).collect()) == ["b", "c", "d"]
    assert files.needs_load(ledger, cur, have, force=True).count() == 4


def test_bundle_round_trip_and_tampering(spark, tmp_path):
    out = str(tmp_path / "b")
    t = {"x": spark.range(5).withColumn("v", F.col("id") * 2)}
    m = files.write_bundle(t, {"x": ["id"]}, out, "1.0.0")
    assert m["tables"]["x"]["rows"] == 5 and files.verify_bundle(spark, out) == []
    with pytest.raises(ValueError, match="exists"):
        files.write_bundle(t, {"x": ["id"]}, out, "1.0.0")
    with pytest.raises(ValueError, match="duplicate.*NULL|NULL.*duplicate|duplicate"):
        files.write_bundle({"x": spark.createDataFrame([(1,), (1,)], "id int")}, {"x": ["id"]}, str(tmp_path / "c"), "1.0")
    man = json.load(open(f"{out}/manifest.json"))
    man["tables"]["x"]["rows"] = 4
    with open(f"{out}/manifest.json", "w") as f:
        json.dump(man, f)
    assert files.verify_bundle(spark, out)[0].startswith("manifest.json: ")  # the file system's checksum tells
    os.remove(f"{out}/.manifest.json.crc")
    os.makedirs(f"{out}/y.parquet")
    assert files.verify_bundle(spark, out) == ["y: not listed", "x: 5 rows, expected 4"]


def test_inventory_and_hash(spark, tmp_path):
    for n in ("a.shp", "a.dbf", "b.csv"):
        (tmp_path / n).write_text(n)
    rows = {r.stem.rsplit("/", 1)[1]: r.parts for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert rows == {"a": 2, "b": 1}
    assert files.canonical_hash({"b": 1, "a": float("nan")}) == files.canonical_hash({"a": None, "b": 1})


def test_table_functions(spark):
    spark.udtf.register("name_rows", text.name_and_integers_udtf())
    df = spark.createDataFrame([(1, "Total 1.234,5 m3, 12 %"), (2, None), (3, ""), (4, "x" * 50_000)], "i int, t string")
    got = [tuple(r)[2:] for r in text.number_tokens(df, "i", "t").collect()]
    assert got == [(6, 13, "1.234,5", False), (18, 20, "12", True)]
    got = [tuple(r) for r in spark.sql("SELECT * FROM name_rows('Adamantina 1.000 20 Agudos 3 4', 2)").collect()]
    assert got == [("Adamantina", [1000, 20]), ("Agudos", [3, 4])]


def test_text_edges(spark):
    df = spark.createDataFrame([("1.234",), ("12,5 %",), ("x",), ("",), (None,)], "t string")
    n = text.br_number(F.col("t"))
    got = [(r.v, r.a) for r in df.select(n["value"].alias("v"), n["ambiguous"].alias("a")).collect()]
    assert got == [(1234.0, True), (12.5, False), (None, False), (None, False), (None, None)]
    assert [r[0] for r in spark.createDataFrame([("ﬁm①",), (None,)], "t string").select(text.nfkc("t")).collect()] == ["fim1", None]


def test_registry_readers(spark, tmp_path):
    head = ",".join(R.PARAMETER_COLUMNS)
    (tmp_path / "p.csv").write_text(f'{head},extra\nvin_gen,supply,"Vinasse, generated",12,10,~15,L,x,S,"says ""so""",,,z\n')
    row = R.read_parameters(spark, str(tmp_path / "p.csv")).first()
    assert (row.central, row.low, row.high, row.raw_high, row.notes, row.page) == (12.0, 10.0, None, "~15", 'says "so"', "")
    assert R.parameter(R.read_parameters(spark, str(tmp_path / "p.csv")), "vin_gen")["central"] == 12.0
    with pytest.raises(KeyError):
        R.parameter(R.read_parameters(spark, str(tmp_path / "p.csv")), "nothing")
    (tmp_path / "q.csv").write_text("id,module\n1,2\n")
    with pytest.raises(ValueError):
        R.read_parameters(spark, str(tmp_path / "q.csv"))
    (tmp_path / "j.csv").write_text('id,total\n1,"1,234.5"\n2,\n3,n/a\n')
    assert [r.total for r in R.read_projects(spark, str(tmp_path / "j.csv"), ["total", "other"]).orderBy("id").collect()] == [1234.5, None, None]


def test_yaml_sources(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("sources:\n- id: a\n  also: [x, y]\n- id: b\n  n: 3\n")
    assert {(r.id, r.also, r.n) for r in R.read_sources(spark, str(tmp_path / "s.yaml")).collect()} == {("a", "x;y", None), ("b", None, "3")}
    (tmp_path / "t.yaml").write_text("other: 1\n")
    with pytest.raises(ValueError):
        R.read_sources(spark, str(tmp_path / "t.yaml"))


def test_candidates_are_refused_as_a_whole(spark):
    ok = spark.createDataFrame([("a", "1.5", "-40"), ("b", "-91", "0")], "id string, lat string, lon string")
    assert [tuple(r) for r in R.extra_candidates(ok.limit(1)).collect()] == [("a", "extra", "", "", 1.5, -40.0)]
    with pytest.raises(ValueError, match="1 rows without coordinates in degrees"):
        R.extra_candidates(ok)
    with pytest.raises(ValueError, match="rows without id; 1 repeated ids"):
        R.extra_candidates(spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), (None, 1.0, 1.0)], "id string, lat double, lon double"))
    with pytest.raises(ValueError, match="lon"):
        R.extra_candidates(ok.drop("lon"))
    long = R.criteria(spark.createDataFrame([(1, "0.5", "", "True"), (2, "x", "1", None)], "i int, n_a string, n_b string, excluded string"), "i")
    assert sorted((r.i, r.criterion, r.value, r.excluded) for r in long.collect() if r.value is not None) == [(1, "a", 0.5, True), (2, "b", 1.0, False)]
    with pytest.raises(KeyError):
        R.plant_series(spark.createDataFrame([("a", None)], "p string, d date"), "b", "p", "d", [])


def test_staged_load_keeps_the_old_table(spark, tmp_path):
    root = str(tmp_path / "db")
    good = lambda n: lambda: spark.range(n)

    def bad():
        raise ValueError("no such file\nmore")

    assert [(x["name"], x["ok"], x["rows"]) for x in R.staged_load(spark, root, {"a": good(3), "b": bad, "c": good(1)})] == [("a", True, 3), ("b", False, None), ("c", True, 1)]
    assert R.staged_load(spark, root, {"a": bad})[0]["error"] == "no such file" and spark.read.parquet(f"{root}/a").count() == 3
    R.staged_load(spark, root, {"a": good(5)})
    assert spark.read.parquet(f"{root}/a").count() == 5 and spark.read.parquet(f"{root}/_load_log").count() == 5
    assert not [x for x in os.listdir(root) if x.startswith(("_stage", "_old"))]
    R.write_small(spark.range(2), f"{root}/x", "json")
    assert spark.read.json(f"{root}/x").count() == 2
    with pytest.raises(ValueError):
        R.write_small(spark.range(2), f"{root}/x", "xml")
