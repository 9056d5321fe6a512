from datetime import date, datetime

from pyspark.sql import functions as F

from sucrogas.llm.match import one_to_one, slots, sorted_neighbourhood
from sucrogas.llm.names_link import name_classes
from sucrogas.llm.places import PlaceIndex, places_of, state_of
from sucrogas.llm.projects import match_projects
from sucrogas.llm.titles import gazetteer


def classes_of(projects, snaps, muni):
    return name_classes(snaps.select(F.col("razao_social").alias("name")), projects.select(F.col("project").alias("name")), gazetteer(muni, "municipio"))


def test_slots_are_the_global_order(spark):
    keys = spark.createDataFrame([(f"{i * 7919 % 1000:04d}",) for i in range(500)] * 2 + [(None,)], "key string").repartition(7)
    got = slots(keys).orderBy("key").collect()
    assert [r.slot for r in got] == list(range(500))


def test_window_counts_distinct_keys(spark):
    left = spark.createDataFrame([(1, "b"), (2, "x"), (3, None)], "l int, k string")
    right = spark.createDataFrame([(i, "b") for i in range(50)] + [(100, "a"), (101, "d"), (102, "e"), (103, "c")], "r int, k string")
    got = {(r.l, r.r) for r in sorted_neighbourhood(left, right, "l", "r", [("k", F.col("k"), F.col("k"))], window=1).collect()}
    assert got == {(1, i) for i in range(50)} | {(1, 100), (1, 103)} | {(2, 102)}


def test_one_to_one(spark):
    s = spark.createDataFrame([("b", 1, "x", 0.9), ("b", 1, "y", 0.8), ("b", 2, "x", 0.85), ("c", 3, "z", 0.5)], "block string, i int, j string, confidence double")
    assert sorted((r.i, r.j) for r in one_to_one(s, "i", "j", "block").collect()) == [(1, "y"), (2, "x"), (3, "z")]


def test_places():
    ix = PlaceIndex(["Monte Vererapó", "Sapebucu do Brejo", "Nova Jambulândia", "Norte Jambulândia"])
    assert places_of("M. Vererapo/SP; região de Sapebuucu do Brejo (zona rural)", ix) == ["monte vererapo", "sapebucu do brejo"]
    assert places_of("N. Jambulandia", ix) == [] and places_of(None, ix) == [] and places_of("", ix) == [] and places_of("Sapebucu d0 Brejo - MG", ix) == ["sapebucu do brejo"]
    assert places_of("x" * 50_000, ix) == [] and places_of("Sapebucu do Brejoo", ix) == ["sapebucu do brejo"]
    assert state_of("X - MG") == "MG" and state_of("X") is None and state_of(None) is None


def test_projects(spark):
    muni = spark.createDataFrame([("Monte Vererapó", "SP"), ("Ararimbora", "SP"), ("Ararimbora", "MG")], "municipio string, uf string")
    d = date(2025, 1, 1)
    snap = lambda c, n, m, uf, cap: (d, c, n, m, uf, cap, datetime(2025, 1, 2))
    snaps = spark.createDataFrame(
        [snap("1", "Gojeguli Biometano Ltda.", "MONTE VERERAPO", "SP", 1000.0), snap("2", "GOJEGULI BIOMETANO LTDA.", "ARARIMBORA", "MG", 2000.0), snap("3", "Gojeguli Biometano Ltda.", "ARARIMBORA", "MG", 9000.0), snap("4", "Paninini Energia Renovável", "ARARIMBORA", "SP", None), snap(None, "x", None, None, None)],
        "snapshot_date date, cnpj string, razao_social string, municipio string, uf string, cap_biometano_m3d double, delivered_at timestamp",
    )
    rows = [
        (1, "Biometano Monte Vererapó (Gojegulli)", "Monte Vererapo/SP", None, 1000.0, "m3/d", None, None, None),
        (2, "Gojeguli plant 2", "região de Ararimborra", "MG", 9.0, "mil m3/d", None, None, None),
        (3, "Gojeguli (expansion)", "Ararimbora", "SP", 2000.0, "m3/d", None, None, None),  # another place of that name
        (4, "JV Gojeguli e Paninini", "Ararimbora", "SP", None, None, None, None, None),
        (5, "Gojeguli", "Nowhere", "SP", 5.0, "m3/d", None, None, None),
        (6, None, "Ararimbora", "SP", None, None, None, None, None),
        (2, "Gojeguli plant 2", "região de Ararimborra", "MG", 9.0, "mil m3/d", None, None, None),
        (7, "Outracoisa", "Ararimbora", None, None, None, None, None, "x"),
    ]
    projects = spark.createDataFrame(rows, "id long, project string, location string, uf string, capacity_value double, capacity_unit string, capacity_basis string, notes string, core string")
    names = classes_of(projects, snaps, muni)
    got = {r.id: r.cnpj.lstrip("0") for r in match_projects(projects, snaps, names, muni).collect()}
    assert got == {1: "1", 2: "3", 4: "4"}
    assert match_projects(projects.limit(0), snaps, names, muni).collect() == []
    assert match_projects(projects, snaps.limit(0), names, muni).collect() == []


def test_unplaced_project_states_an_earlier_capacity(spark):
    muni = spark.createDataFrame([("Ararimbora", "SP")], "municipio string, uf string")
    plant = lambda c, town, cap, year: (date(year, 1, 1), c, "Gojeguli Biometano Ltda.", town, "SP", cap, datetime(year, 1, 2))
    # Plant 1 grew from 1,000 to 90,000; six others of the company lie between in the order of the latest capacities.
    rows = [plant("1", "ZULAIMA", 1000.0, 2023), plant("1", "ZULAIMA", 90000.0, 2025)] + [plant(str(i), f"TOWN {i}", 1000.0 * 1.9 ** (i - 1), 2025) for i in range(2, 8)]
    snaps = spark.createDataFrame(rows, "snapshot_date date, cnpj string, razao_social string, municipio string, uf string, cap_biometano_m3d double, delivered_at timestamp")
    projects = spark.createDataFrame(
        [(1, "Gojeguli", None, "SP", 1000.0, "m3/d", None, None)], "id long, project string, location string, uf string, capacity_value double, capacity_unit string, capacity_basis string, notes string"
    )
    got = match_projects(projects, snaps, classes_of(projects, snaps, muni), muni).collect()
    assert [(r.id, r.cnpj.lstrip("0")) for r in got] == [(1, "1")]
