"""Text, number and date functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

ACCENTED, PLAIN = "áàâãäéèêëíìîïóòôõöúùûüçñ", "aaaaaeeeeiiiiooooouuuucn"


def br_decimal(c: Column) -> Column:
    """A decimal as published in Brazil: with a comma the dots group and the comma is decimal; else a plain number.  NULL if neither."""
    t = F.trim(c)
    plain = F.when(t.contains(","), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t)
    return plain.try_cast("double")


def br_number(c: Column) -> Column:
    """Strict Brazilian number: struct(value, ambiguous, alternative, percent).

    Optional sign and "%"; groups of three by dots or spaces; comma decimal.  One dot before exactly three digits may
    group or be decimal: ``ambiguous``, with the grouped value and the decimal one as alternative.  Other texts give NULLs.
    """
    t = F.regexp_replace(F.trim(c), "[\\u00a0\\u202f]", " ")
    percent = t.rlike(r"%\s*$")
    n = F.trim(F.regexp_replace(t, r"\s*%\s*$", ""))
    digits = F.regexp_replace(n, r"[. ]", "")
    grouped = n.rlike(r"^[-+]?\d{1,3}(\.\d{3})+(,\d+)?$") | n.rlike(r"^[-+]?\d{1,3}( \d{3})+(,\d+)?$")
    comma = n.rlike(r"^[-+]?\d+,\d+$")
    integer = n.rlike(r"^[-+]?\d+$")
    dotted = n.rlike(r"^[-+]?\d+\.\d+$") & ~grouped
    one_group = n.rlike(r"^[-+]?[1-9]\d{0,2}\.\d{3}$")
    value = F.when(grouped | comma | integer, F.replace(digits, F.lit(","), F.lit(".")).try_cast("double")).when(dotted, n.try_cast("double"))
    return F.struct(value.alias("value"), one_group.alias("ambiguous"), F.when(one_group, n.try_cast("double")).alias("alternative"), percent.alias("percent"))


def br_integer(c: Column) -> Column:
    """An integer with dots between groups of three; NULL for anything else."""
    t = F.trim(c)
    return F.when(t.rlike(r"^-?\d{1,3}(\.\d{3})*$"), F.replace(t, F.lit("."), F.lit("")).cast("bigint"))


def name_key(c: Column) -> Column:
    """A key that ignores accents, case, hyphens and repeated blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[^a-z0-9]+", " "))


def slug(c: Column, most: int = 63) -> Column:
    """An ASCII identifier of bounded length; a longer one ends with eight characters of its hash."""
    s = F.regexp_replace(F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 9), F.lit("_"), F.substring(F.sha2(c, 256), 1, 8)))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which no SQL function offers."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank; bullets at the start are dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[•\-–▪]\s+", ""))


def sum_list(c: Column, sep: str = ";") -> Column:
    """Sum of the numbers of a list text; parts that are no number count nothing, no number at all gives NULL."""
    parts = F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))


def key_values(c: Column, sep: str = ";", eq: str = "=") -> Column:
    """A text of pairs ("a=1; b=2") as a map; parts without a key or without the sign are left out, of a repeated key the last counts; NULL stays NULL."""
    pairs = F.filter(F.transform(F.split(c, sep), lambda x: F.transform(F.split(x, eq, 2), lambda y: F.trim(y))), lambda x: (F.size(x) == 2) & (x[0] != ""))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x[0]), F.create_map(x[0], x[1])))
    return F.when(c.isNotNull(), last)


def url_domain(c: Column) -> Column:
    """The host of a URL without "www."; NULL for anything that is no URL."""
    return F.regexp_replace(F.regexp_extract(F.lower(c), r"^https?://([^/:?#]+)", 1), r"^www\.", "")


def pair(c: Column) -> Column:
    """Text of two values or two ranges, "a / b" or "a-b / c-d": struct of the bounds, NULL where absent."""
    num = r"(-?\d+(?:\.\d+)?)"
    two = rf"^\s*{num}\s*/\s*{num}\s*$"
    four = rf"^\s*{num}\s*-\s*{num}\s*/\s*{num}\s*-\s*{num}\s*$"
    g = lambda p, i: F.when(c.rlike(p), F.regexp_extract(c, p, i)).cast("double")
    return F.struct(
        F.coalesce(g(two, 1), g(four, 1)).alias("first_low"), F.coalesce(g(two, 1), g(four, 2)).alias("first_high"),
        F.coalesce(g(two, 2), g(four, 3)).alias("second_low"), F.coalesce(g(two, 2), g(four, 4)).alias("second_high"),
    )


# Patterns of identifiers and dates.
PATTERNS = {
    "snake_case": r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$", "doi": r"^10\.\d{4,9}/\S+$", "iso_date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "run_id": r"^[a-z0-9]+(-[a-z0-9]+)*-[0-9a-f]{8,}$", "gas_flow": r"^(Nm3|Sm3|m3)/(d|day|dia|h|yr|year|ano)$",
    "http_url": r"^https?://[^\s/]+\.[^\s]+$", "semver": r"^\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?$", "hex": r"^[0-9a-f]+$",
}


def conforms(c: Column, kind: str) -> Column:
    """Whether a text has the form of ``kind`` (a key of PATTERNS); NULL stays NULL."""
    return c.rlike(PATTERNS[kind])


def month_starts(first: Column, last: Column) -> Column:
    """All month starts from ``first`` to ``last``, both included."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def months_in(first: Column, last: Column) -> Column:
    """Number of calendar months from ``first`` to ``last``, both included."""
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first) + 1


def days_in_month(c: Column) -> Column:
    """Days of the month of a date."""
    return F.dayofmonth(F.last_day(c))


_TOKEN = re.compile(r"(?<![\w.,])(?:[-+]?\d{1,3}(?:\.\d{3})+(?:,\d+)?|[-+]?\d+(?:,\d+)?(?:\.\d+)?)")


@F.pandas_udf(ArrayType(StructType([StructField("start_at", IntegerType()), StructField("end_at", IntegerType()), StructField("token", StringType()), StructField("percent", BooleanType())])))
def _tokens_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: [(m.start(), m.end(), m.group(), x[m.end() :].lstrip()[:1] == "%") for m in _TOKEN.finditer(x)] if isinstance(x, str) else [])


def number_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """All number tokens of a text with their character offsets: key, ``text``, ``start_at``, ``end_at``, ``token``, ``percent``.

    Texts are read in Arrow batches; NULL and texts without numbers give no row.  A sign belongs to the number only where no letter, digit or mark stands before it.
    """
    return df.select(key, F.col(text).alias("text"), F.explode(_tokens_of(F.col(text))).alias("_t")).select(key, "text", "_t.*")


def unit_behind(c: Column) -> Column:
    """The unit word behind a number at the start of a text: letters with exponents, slashes and a percent sign; NULL if none follows."""
    return F.nullif(F.regexp_extract(c, r"^\s*([%°‰]|[A-Za-zµ°][A-Za-zµ³²º°0-9]*(?:\s?/\s?[A-Za-z³²0-9]+)*)", 1), F.lit(""))


def column_unit(column: str, units: dict[str, str]) -> str | None:
    """The unit a column's name ends with, the longest of the known suffixes; None if it names none."""
    return next((units[s] for s in sorted(units, key=len, reverse=True) if column.lower().endswith("_" + s)), None)


def columns_without_unit(columns: list[str], units: dict[str, str], plain: tuple[str, ...], has_unit_column: bool) -> list[str]:
    """Columns whose name neither ends with a unit nor is of a kind that needs none (``plain`` names and beginnings); none where the table states units in a column."""
    return [] if has_unit_column else [c for c in columns if column_unit(c, units) is None and not c.lower().startswith(plain)]


class _NameAndIntegers:
    """Rows "name int int ..." with exactly n integers; several may share a line."""

    def eval(self, line: str, n: int) -> Iterator[tuple]:
        number = r"\d{1,3}(?:\.\d{3})*"
        for m in re.finditer(rf"([^\d\W][^\d\n]*?)((?:\s+{number}){{{n}}})(?!\s*\.?\d)", line or ""):
            yield m.group(1).strip(), [int(x.replace(".", "")) for x in m.group(2).split()]


def name_and_integers_udtf():
    """Table function (line, n) -> name, numbers."""
    return udtf(_NameAndIntegers, returnType="name string, numbers array<bigint>")
