"""Annuity arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: megajoules per million British thermal units.
MJ_PER_MMBTU = 1055.05585


def crf(rate: Column, years: Column) -> Column:
    """Capital recovery factor; 1 / years at a zero rate, NULL for years <= 0."""
    grow = F.pow(1 + rate, years)
    return F.when(years > 0, F.when(rate == 0, 1 / years.cast("double")).otherwise(rate * grow / (grow - 1)))


def power_law(capacity: Column, specific: Column, reference: Column, exponent: Column) -> Column:
    """Investment: linear, or scaled by (capacity / reference) ** exponent of the reference's investment; both or neither must be given."""
    both = reference.isNotNull() & exponent.isNotNull()
    neither = reference.isNull() & exponent.isNull()
    return F.when(both, specific * reference * F.pow(capacity / reference, exponent)).when(neither, specific * capacity)


def unit_cost(investment: Column, output: Column, rate: Column, years: Column, *, fixed: Column | None = None, variable: Column | None = None, feedstock: Column | None = None, transport: Column | None = None, coproduct: Column | None = None) -> Column:
    """Cost per unit of output in five parts and their total: a struct (``investment``, ``operation``, ``feedstock``, ``transport``, ``coproduct``, ``total``).

    All but ``variable`` (per unit) are amounts a year; the co-product is income and is taken off.  NULL where there is no output, or the investment is
    negative; a part that is not given is 0.
    """
    zero = F.lit(0.0)
    per = lambda c: (c if c is not None else zero) / output
    parts = {
        "investment": investment * crf(rate, years) / output, "operation": per(fixed) + (variable if variable is not None else zero),
        "feedstock": per(feedstock), "transport": per(transport), "coproduct": per(coproduct),
    }
    total = parts["investment"] + parts["operation"] + parts["feedstock"] + parts["transport"] - parts["coproduct"]
    return F.when((output > 0) & (investment >= 0), F.struct(*[v.alias(k) for k, v in parts.items()], total.alias("total")))


def per_mmbtu(cost: Column, heating_value_mj: Column, exchange_rate: Column) -> Column:
    """Cost per normal cubic metre in another currency per million BTU (1055.05585 MJ); NULL unless heating value and exchange rate are positive."""
    return F.when((heating_value_mj > 0) & (exchange_rate > 0), cost / exchange_rate / heating_value_mj * MJ_PER_MMBTU)


def against_anchors(results: DataFrame, key: str, cost: str, anchors: list[tuple[str, float | None, float | None, str]], heating_value_mj: float, exchange_rate: float | None) -> DataFrame:
    """Every result beside every published anchor: the cost in the anchor's unit and whether it lies within the anchor's range.

    ``anchors``: (id, low, high, unit), the unit "US$ per MMBtu..." or "R$ per m3...".  Another unit, or no
    exchange rate where one is needed, gives NULL.
    """
    each = [F.struct(F.lit(i).alias("anchor_id"), F.lit(lo).cast("double").alias("low"), F.lit(hi).cast("double").alias("high"), F.lit(u).alias("unit")) for i, lo, hi, u in anchors]
    j = results.select(key, cost, F.explode(F.array(*each)).alias("_a")).select(key, cost, "_a.*")
    value = F.when(F.col("unit").startswith("US$ per MMBtu"), per_mmbtu(F.col(cost), F.lit(heating_value_mj), F.lit(exchange_rate).cast("double"))).when(F.col("unit").startswith("R$ per m3"), F.col(cost))
    return j.select(key, "anchor_id", "low", "high", "unit", value.alias("engine_value"), value.between(F.col("low"), F.col("high")).alias("within_range"))


def annuity_cost(investment: Column, output: Column, rate: Column, years: Column, fixed: Column, variable: Column) -> Column:
    """Cost per unit of output: annuity and fixed cost over the output, plus variable cost; NULL where there is no output."""
    return F.when(output > 0, (investment * crf(rate, years) + fixed) / output + variable)


def power_fit(df: DataFrame, keys: list[str], size: str, amount: str) -> DataFrame:
    """Scaling exponent and intercept of ln(amount) on ln(size) per key, with r2 and n; only positive pairs count, NULL where undetermined."""
    use = df.where((F.col(size) > 0) & (F.col(amount) > 0)).select(*keys, F.log(size).alias("x"), F.log(amount).alias("y"))
    return use.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("exponent"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
