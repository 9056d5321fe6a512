"""The Brazilian company number (CNPJ) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public check-digit weights.
WEIGHTS_1 = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
WEIGHTS_2 = [6, *WEIGHTS_1]


def normalize(c: Column) -> Column:
    """The 14 digits of a CNPJ however it was written.

    A float ending (".0") is dropped, everything but digits is removed, leading zeros
    lost on export are put back.  NULL for NULL, for texts without a digit and for more
    than 14 digits.
    """
    digits = F.regexp_replace(F.regexp_replace(F.trim(c), r"\.0+$", ""), r"[^0-9]", "")
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 14), F.lpad(digits, 14, "0"))


def check_digits(c: Column) -> Column:
    """The two check digits that the first twelve digits of a normalised CNPJ call for."""

    def digit(n: int, weights: list[int], last: Column | None = None) -> Column:
        total = F.lit(0)
        for i, w in enumerate(weights[:12] if last is None else weights):
            d = F.substring(c, i + 1, 1).cast("int") if i < 12 else last
            total = total + d * F.lit(w)
        r = total % 11
        return F.when(r < 2, F.lit(0)).otherwise(F.lit(11) - r)

    first = digit(12, WEIGHTS_1)
    second = digit(13, WEIGHTS_2, first)
    return F.concat(first.cast("string"), second.cast("string"))


def is_valid(c: Column) -> Column:
    """Whether a normalised CNPJ carries the check digits it should; NULL stays NULL."""
    return check_digits(c) == F.substring(c, 13, 2)


def pretty(c: Column) -> Column:
    """``12.345.678/9012-34`` for a normalised CNPJ."""
    return F.regexp_replace(c, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
