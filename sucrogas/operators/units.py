"""Quantities recorded in different units, brought to the common unit of each quantity."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sucrogas.functions.units import QUANTITIES, Reading, choose, convert, number, phrase_value, prior_of, single_value, stated_unit

CAPACITY = ("gas flow", "electric power")
UNSTATED = frozenset(["", "?", "-", "–", "see name", "see notes", "n/a", "na", "none", "a confirmar", "unknown"])
SCHEMA = "record_id string, quantity string, common_unit string, value double, value_milli long"


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None


def _row(record: object, hit: tuple[Fraction, str, Reading] | None) -> tuple | None:
    if hit is None:
        return None
    value, quantity, reading = hit
    v = convert(value, reading, quantity)
    milli = v * 1000
    whole = int(abs(milli) + Fraction(1, 2)) * (1 if milli >= 0 else -1)
    try:
        as_float = float(v)
    except OverflowError:
        as_float = float("inf") if v > 0 else float("-inf")
    return (str(record), quantity, QUANTITIES[quantity].unit, as_float, whole if abs(whole) < 2**63 else None)


def reading_value(central: str | None, unit: str | None, field: str | None, texts: list[str | None]) -> tuple[Fraction, str, Reading] | None:
    """Value and unit of one text reading.

    The unit is taken from behind the number, else from the unit column, else from the field's
    name, else from the other texts.  The field name's dimension prior decides between readings.
    """
    one = single_value(central)
    if one is None:
        return None
    value, rest = one
    prior = prior_of(field)
    allowed = (prior,) if prior else tuple(QUANTITIES)
    if rest:
        hit = choose(rest, allowed)
        return (value, *hit) if hit else None
    if unit is not None and unit.strip().lower() not in UNSTATED:
        hit = choose(unit.strip(), allowed)
        return (value, *hit) if hit else None
    for t in (field, *texts):
        hit = stated_unit(t, allowed)
        if hit:
            return (value, *hit)
    return None


def capacity_value(value: float | None, unit: str | None, texts: list[str | None]) -> tuple[Fraction, str, Reading] | None:
    """Value and unit of a capacity that stands in its columns, or partly or wholly in phrases."""
    stated = unit is not None and unit.strip().lower() not in UNSTATED
    if value is None or value != value:
        for t in texts:
            hit = phrase_value(t, CAPACITY)
            if hit:
                return hit
        return None
    exact = number(format(value, "f").rstrip("0").rstrip(".")) if abs(value) < 1e15 else None
    exact = Fraction(repr(float(value))) if exact is None or float(exact) != value else exact
    if stated:
        hit = choose(unit.strip(), CAPACITY)
        return (exact, *hit) if hit else None
    for t in texts:
        hit = stated_unit(t, CAPACITY)
        if hit:
            return (exact, *hit)
    return None


def readings_in_common_units(df: DataFrame, record: str, central: str, unit: str, field: str, texts: list[str]) -> DataFrame:
    """Text readings in the common unit of their quantity.

    One row per record whose ``central`` holds exactly one number and whose unit is stated anywhere in
    the row and has a fixed relation to the common unit of the field's quantity (fields without a
    prior may take any quantity).  A value whose thousandths do not fit a long has ``value_milli`` NULL.  No row for NULL, empty or wordy values, ranges, pairs, unknown
    units; repeated records give one row each (copies stay copies).  Embarrassingly parallel: no
    shuffle; parses are cached per distinct string in each worker.
    """
    cols = [record, central, unit, field, *texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, c, u, f, *ts in zip(*[b[n] for n in range(len(cols))], strict=True):
                row = _row(r, reading_value(_text(c), _text(u), _text(f), [_text(t) for t in ts])) if r is not None else None
                if row:
                    out.append(row)
            yield _frame(out)

    # Positions instead of names: extra or clashing column names of the input do not matter.
    flat = df.select(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(cols)])
    return flat.mapInPandas(lambda it: run(_by_position(it)), SCHEMA)


def capacities_in_common_units(df: DataFrame, record: str, value: str, unit: str, texts: list[str]) -> DataFrame:
    """Gas or power capacities in m3/d or kW.

    The value and its unit may stand in their columns, the unit alone in a text ("value in m3/h"), or
    both in a phrase ("capacity of 5,792 m3/day"), whose numbers are read in the notation of its
    language.  Other figures (distances, money, other mass flows) have other dimensions and are
    passed over.  Units per season have no fixed relation and give no row; NULL records neither.
    """
    cols = [record, value, unit, *texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, v, u, *ts in zip(*[b[n] for n in range(len(cols))], strict=True):
                number_ = float(v) if isinstance(v, str) else None
                row = _row(r, capacity_value(number_, _text(u), [_text(t) for t in ts])) if r is not None else None
                if row:
                    out.append(row)
            yield _frame(out)

    flat = df.select(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(cols)])
    return flat.mapInPandas(lambda it: run(_by_position(it)), SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
    return out.assign(value_milli=pd.array([r[4] for r in rows], dtype="Int64"))


def _by_position(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b.columns = range(b.shape[1])
        yield b.astype(object).where(b.notna(), None)
