from fractions import Fraction

import pytest

from sucrogas.functions.units import choose, convert, number, parse_unit, single_value
from sucrogas.operators.units import capacities_in_common_units, capacity_value, reading_value, readings_in_common_units


@pytest.mark.parametrize(
    ("unit", "quantity", "one"),
    [
        ("MG/L", "concentration", 1), ("g/100 mL", "concentration", 10000), ("kg m-3", "concentration", 1000), ("g·L⁻¹", "concentration", 1000),
        ("Mm3/yr", "gas flow", Fraction(10**6, 365)), ("mil m3/mês", "gas flow", Fraction(12000, 365)), ("m3d", "gas flow", 1), ("Nm³ / h", "gas flow", 24), ("NM3/D", "gas flow", 1),
        ("kg VS/m3.d", "organic load", 1), ("g VS/L.d", "organic load", 1), ("kg VS m⁻³ dia⁻¹", "organic load", 1), ("MJ Nm⁻³", "energy per gas volume", Fraction(10, 36)),
        ("kcal/Nm3", "energy per gas volume", Fraction(4184, 3600000)), ("ppm v/v", "share", Fraction(1, 10000)), ("(0-1)", "share", 100), ("m3/t VS", "methane yield", 1), ("mL g-1 VS", "methane yield", 1),
        ("t per t cane", "mass per tonne of cane", 1000), ("L per m3 ethanol", "volume per ethanol", Fraction(1, 1000)), ("KM", "distance", 1), ("m", "distance", Fraction(1, 1000)), ("semanas", "duration", 7), ("kWe", "electric power", 1),
    ],
)
def test_factor(unit, quantity, one):
    name, reading = choose(unit, (quantity,))
    assert convert(Fraction(1), reading, name) == one


def test_temperatures():
    for unit, value, out in (("K", "300.15", "27"), ("deg F", "212", "100"), ("graus Celsius", "30", "30")):
        name, reading = choose(unit, ("temperature",))
        assert convert(Fraction(value), reading, name) == Fraction(out)


def test_no_unit():
    assert parse_unit("") == () and parse_unit("see name") == () and choose("m3 per season", ("gas flow",)) is None and choose("t/d", ("gas flow", "electric power")) is None


def test_numbers():
    assert number("1.234,5") == Fraction("1234.5") and number("1,234.5") == Fraction("1234.5") and number("7 690") == 7690
    assert number("2.183", "pt") == 2183 and number("2.183", "en") == Fraction("2.183") and number("15,126", "en") == 15126 and number("1.2.3") is None
    assert single_value("~0.51") == (Fraction("0.51"), "") and single_value("0.4 (0-1)")[1] == "(0-1)"
    assert single_value("1 / 2") is None and single_value("10-12") is None and single_value("low") is None and single_value(None) is None and single_value("") is None


def test_reading_sources():
    assert reading_value("5", None, "Stillage COD (g/L)", [])[0] == 5
    assert reading_value("5", "?", "Stillage COD", ["values in kg m-3"]) is not None
    assert reading_value("50", None, "Digester temperature", ["at 35 °C"]) is None  # a figure of its own
    assert reading_value("50", None, "Stillage COD", [None, ""]) is None


def test_capacity_phrases():
    day = lambda *a: (lambda h: h and convert(h[0], h[2], h[1]))(capacity_value(*a))
    assert day(None, None, ["nominal", "also 12 t/d of food-grade CO2; biomethane capacity of 6,408 m3/day"]) == 6408
    assert day(None, None, ["total de 2.183 Nm³/h"]) == 2183 * 24
    assert day(2.5, None, ["stated in million m3 per year"]) == Fraction(2500000, 365)
    assert day(7.0, "m3/safra", ["nominal"]) is None and day(None, "m3/d", [None]) is None and day(9.0, "?", ["65 km pipeline planned"]) is None


def test_frames_with_nulls_copies_and_clashing_names(spark):
    rows = [("a", "5", "g/L", "Stillage COD", None, 1), ("a", "5", "g/L", "Stillage COD", None, 1), ("b", None, None, None, None, 1), (None, "5", "g/L", "Stillage COD", None, 1)]
    df = spark.createDataFrame(rows, "id string, central string, unit string, parameter string, notes string, value int")
    out = readings_in_common_units(df, "id", "central", "unit", "parameter", ["notes"]).collect()
    assert [(r.record_id, r.common_unit, r.value_milli) for r in out] == [("a", "mg/L", 5_000_000)] * 2
    assert readings_in_common_units(df.limit(0), "id", "central", "unit", "parameter", ["notes"]).collect() == []
    caps = spark.createDataFrame([(1, 2.0, "MW", None), (2, float("nan"), None, "x" * 100_000)], "id long, v double, u string, n string")
    assert [(r.record_id, r.value_milli) for r in capacities_in_common_units(caps, "id", "v", "u", ["n"]).collect()] == [("1", 2_000_000)]


def test_nothing_is_cut_off(spark):
    long_unit = "milhões de metros cúbicos".replace("metros cúbicos", "m3") + " " * 20 + "de  biometano" + " " * 20 + "por    ano"
    assert len(long_unit) > 60
    name, reading = choose(long_unit, ("gas flow",))
    assert convert(Fraction(1), reading, name) == Fraction(10**6, 365)
    hit = capacity_value(None, None, ["capacity of 3 million m3 biomethane gas CH4 gas CH4 biomethane gas CH4 per year"])
    assert hit and convert(hit[0], hit[2], hit[1]) == Fraction(3 * 10**6, 365)
    df = spark.createDataFrame([("a", "9" * 30, "g/L", "Stillage COD", None), ("b", "9" * 400, "g/L", "Stillage COD", None), ("c", "1", "k" * 5000, "Stillage COD", None)], "id string, central string, unit string, parameter string, notes string")
    got = {r.record_id: (r.value, r.value_milli) for r in readings_in_common_units(df, "id", "central", "unit", "parameter", ["notes"]).collect()}
    assert got == {"a": (1e33, None), "b": (float("inf"), None)}


def test_notation_follows_the_language():
    from sucrogas.functions.units import language

    assert language("a unidade vai produzir cerca de 2.183 m3 por dia") == "pt" and language("the unit will produce about 2,183 m3 per day") == "en" and language("2.183 Nm³/d") == "pt"
