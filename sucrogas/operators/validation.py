"""Validation of registry tables: rules of a row, unique keys and links between tables, all as issue rows (``file``, ``row``, ``level``, ``message``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sucrogas.functions import text
from sucrogas.operators import quality

Rule = tuple[str, Column, Column]

# Flags of confidence, kinds of references, quantities of a plant's report with their unit.
FLAGS = ("V", "S", "K", "D")
GAS_FLOW = r"^(nm3|sm3|m3)/(d|day|dia|h|hour|yr|year|ano|month)$"
QUANTITY_UNITS = {"biogas": "Nm3", "vinasse": "m3", "cake": "t", "cofeed": "t"}


def blank(c: str) -> Column:
    """Whether a text is missing."""
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def required(*columns: str) -> list[Rule]:
    """Columns that must be filled."""
    return [("error", blank(c), F.lit(f"{c} is missing")) for c in columns]


def one_of(c: str, values: tuple[str, ...]) -> Rule:
    """A column with a closed list of values; a missing one is not of the list."""
    return ("error", ~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.concat(F.lit(f"{c} is none of {', '.join(values)}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))))


def formed(c: str, kind: str, level: str = "error") -> Rule:
    """A column that, where filled, has the form of a known pattern."""
    return (level, ~blank(c) & ~text.conforms(F.trim(c), kind), F.concat(F.lit(f"{c} is no {kind}: "), F.col(c)))


def at_least(c: str, low: float, strict: bool = False) -> list[Rule]:
    """A column that, where filled, is a number not below ``low`` (or above it)."""
    v = F.col(c).try_cast("double")
    return [("error", ~blank(c) & v.isNull(), F.lit(f"{c} is no number")), ("error", (v <= low) if strict else (v < low), F.lit(f"{c} is {'not above' if strict else 'below'} {low:g}"))]


def page_rules() -> list[Rule]:
    """A page is a positive whole number, and a quote stands beside it."""
    return [("error", ~F.coalesce(F.trim("page").rlike(r"^[1-9]\d*$"), F.lit(False)), F.lit("page is no positive whole number")), ("error", blank("quote"), F.lit("quote is missing"))]


def validate(df: DataFrame, file: str, key: str, rules: list[Rule], unique: bool = True, links: list[tuple[str, DataFrame, str]] | None = None) -> DataFrame:
    """Issues of one table.

    ``rules`` are (level, condition that must not hold, message), evaluated in one pass; with ``unique`` every row whose ``key`` occurs again is an error (a
    hot key is counted before the shuffle); ``links`` are (column, parent, parent column): filled values without a parent are errors.  NULL
    conditions hold nothing; an empty table has no issues.
    """
    parts = [quality.issues(df, file, key, rules)]
    if unique:
        counts = df.where(~blank(key)).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
        parts.append(counts.select(F.lit(file).alias("file"), F.col(key).cast("string").alias("row"), F.lit("error").alias("level"), F.concat(F.lit(f"{key} is used by "), F.col("_n"), F.lit(" rows")).alias("message")))
    for column, parent, parent_key in links or []:
        lost = quality.dangling(df.where(~blank(column)), column, parent, parent_key)
        parts.append(lost.select(F.lit(file).alias("file"), F.col(key).cast("string").alias("row"), F.lit("error").alias("level"), F.concat(F.lit(f"{column} is unknown: "), F.col(column).cast("string")).alias("message")))
    return reduce(DataFrame.unionByName, parts)


def project_rules() -> list[Rule]:
    """Projects: a positive capacity with its unit, gas flows at reference conditions, investments that fit together."""
    unit = F.replace(F.replace(F.lower(F.trim("capacity_unit")), F.lit(" "), F.lit("")), F.lit("³"), F.lit("3"))
    return [
        *required("id", "source"), one_of("confidence", FLAGS), *at_least("capacity_value", 0, strict=True),
        ("error", F.col("capacity_value").isNotNull() & blank("capacity_unit"), F.lit("capacity without unit")),
        ("warning", F.col("capacity_value").isNull() & ~blank("capacity_unit"), F.lit("unit without capacity")),
        ("warning", ~blank("capacity_unit") & ~unit.rlike(GAS_FLOW), F.lit("capacity is no gas flow")),
        ("warning", unit.rlike(GAS_FLOW) & unit.startswith("m3"), F.lit("gas flow without reference conditions")),
        *at_least("investment_total_brl_m", 0), *at_least("bndes_brl_m", 0),
        ("warning", F.col("bndes_brl_m") > F.col("investment_total_brl_m"), F.lit("loan above the investment")),
    ]


def source_rules() -> list[Rule]:
    """Sources: identifier, module and publisher filled, a web address or an explicit placeholder, a record of what was downloaded."""
    url = F.lower(F.trim("url"))
    placeholder = url.isin("todo", "tbd", "n/a", "none") | (url.startswith("<") & url.endswith(">"))
    return [
        *required("id", "module", "publisher"), formed("id", "snake_case", "warning"), one_of("confidence", FLAGS),
        ("warning", placeholder, F.lit("url is a placeholder")), ("error", ~blank("url") & ~placeholder & ~text.conforms(url, "http_url"), F.lit("url is no web address")), ("error", blank("url"), F.lit("url is missing")),
        ("warning", (F.col("status") == "have") & (blank("sha256") | blank("retrieved_on")), F.lit("download is not recorded")),
    ]


def reference_rules() -> list[Rule]:
    """References: form of id, year, identifier and address, and what they are used for."""
    return [
        *required("ref_id", "used_for"), formed("ref_id", "snake_case"), ("error", ~blank("year") & ~F.trim("year").rlike(r"^\d{4}$"), F.lit("year is not four digits")), formed("doi", "doi"), formed("url", "http_url"),
    ]


def reference_links(references: DataFrame, params: DataFrame, two_sources: Column) -> DataFrame:
    """Links of references: those used for unknown parameters, those that claim two sources but give fewer than two domains, and parameters that cite a paper no reference names.

    ``references``: ``ref_id``, ``used_for`` and ``evidence`` (";"-separated ids and addresses); ``params``: ``id``, ``source``.
    """
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    used = references.select("ref_id", F.explode(split("used_for")).alias("id")).distinct()
    row = lambda df, key, level, message: df.select(F.lit("references").alias("file"), F.col(key).alias("row"), F.lit(level).alias("level"), message.alias("message"))
    lost = row(quality.dangling(used, "id", params, "id"), "ref_id", "error", F.concat(F.lit("used for an unknown parameter: "), F.col("id")))
    domains = references.select("ref_id", two_sources.alias("_two"), F.size(F.array_distinct(F.filter(F.transform(split("evidence"), text.url_domain), lambda d: d != ""))).alias("_n"))
    few = row(domains.where(F.coalesce(F.col("_two"), F.lit(False)) & (F.col("_n") < 2)), "ref_id", "error", F.concat(F.lit("two sources need two domains, found "), F.col("_n")))
    papers = params.where(F.col("source").contains("et al") | F.col("source").rlike(r"\b10\.\d{4,9}/\S"))
    unlinked = row(quality.dangling(papers.select("id"), "id", used, "id"), "id", "warning", F.lit("cites a paper that no reference names"))
    return lost.unionByName(few).unionByName(unlinked)


def period_bounds(kind: Column, period: Column) -> tuple[Column, Column]:
    """First and last month (yyyy-MM) of a season "2023/24" (April to March) or a calendar year; NULL for a label of another form."""
    y = F.substring(period, 1, 4).try_cast("int")
    season = (kind == "safra") & period.rlike(r"^\d{4}/\d{2}$") & (F.substring(period, 6, 2).try_cast("int") == (y + 1) % 100)
    year = (kind == "calendar") & period.rlike(r"^\d{4}$")
    return (
        F.when(season, F.format_string("%04d-04", y)).when(year, F.format_string("%04d-01", y)),
        F.when(season, F.format_string("%04d-03", y + 1)).when(year, F.format_string("%04d-12", y)),
    )


def reported_rules() -> list[Rule]:
    """Values a plant reported: its period and bounds, quantity and unit, a number not below zero, page and quote."""
    first, last = period_bounds(F.col("period_kind"), F.col("period"))
    unit = F.element_at(F.create_map(*[x for q, u in QUANTITY_UNITS.items() for x in (F.lit(q), F.lit(u))]), F.col("quantity"))
    known = F.col("quantity").isin(*QUANTITY_UNITS)
    return [
        *required("row_id", "plant_id"), one_of("period_kind", ("safra", "calendar")),
        ("error", F.col("period_kind").isin("safra", "calendar") & first.isNull(), F.lit("period label does not fit its kind")),
        ("error", (F.col("start_month") != first) | (F.col("end_month") != last), F.lit("months do not fit the period")),
        ("error", ~F.coalesce(known, F.lit(False)), F.lit("unknown quantity")), ("error", known & ~F.col("unit").eqNullSafe(unit), F.concat(F.lit("unit should be "), unit)),
        ("error", F.col("value").try_cast("double").isNull(), F.lit("value is no number")), *at_least("value", 0)[1:], *page_rules(), one_of("confidence", FLAGS),
    ]


def reported_conflicts(df: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Plants, periods and quantities whose values differ by more than ``tolerance`` of the largest absolute one: both are kept, one issue names the range."""
    v = F.col("value").try_cast("double")
    g = df.groupBy("plant_id", "period_kind", "period", "quantity").agg(F.min("row_id").alias("row"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))
    apart = F.try_divide(F.col("hi") - F.col("lo"), F.greatest(F.abs("hi"), F.abs("lo"))) > tolerance
    return g.where((F.col("n") > 1) & apart).select(F.lit("reported").alias("file"), F.col("row").cast("string").alias("row"), F.lit("warning").alias("level"), F.concat(F.lit("values differ: "), F.col("n"), F.lit(" of "), F.col("quantity")).alias("message"))


def mill_issues(mills: DataFrame, years: DataFrame, crop_years: list[int]) -> DataFrame:
    """What a run of each mill still needs: shares that are none, a name, the cane of a crop year, the storage settings of a storing strategy.

    ``mills``: ``mill_id``, ``name``, ``strategy``, ``share_vinasse``, ``share_cake``, ``share_straw``, ``store_share``, ``loss``; ``years``: ``mill_id``, ``crop_year``, ``cane_t``, ``source``.
    """
    shares = [c for c in ("share_vinasse", "share_cake", "share_straw")]
    rules = [
        *required("mill_id", "name"), one_of("strategy", ("S0", "S1")), *[("error", ~F.coalesce(F.col(c).between(0, 1), F.lit(False)), F.lit(f"{c} is no share")) for c in shares],
        ("missing", (F.col("strategy") == "S1") & (F.col("store_share").isNull() | F.col("loss").isNull()), F.lit("storage settings")),
    ]
    own = validate(mills, "mills", "mill_id", rules)
    need = mills.select("mill_id", F.explode(F.array(*[F.lit(y) for y in crop_years])).alias("crop_year"))
    have = years.where(F.col("cane_t").isNotNull()).select("mill_id", "crop_year").distinct()
    lost = need.join(have, ["mill_id", "crop_year"], "left_anti")
    odd = years.where((F.col("cane_t") < 0) | (F.col("cane_t").isNotNull() & blank("source")))
    row = lambda df, level, message: df.select(F.lit("mills").alias("file"), F.col("mill_id").cast("string").alias("row"), F.lit(level).alias("level"), message.alias("message"))
    return own.unionByName(row(lost, "missing", F.concat(F.lit("cane of "), F.col("crop_year")))).unionByName(row(odd, "error", F.concat(F.lit("cane of "), F.col("crop_year"), F.lit(" needs a source and must not be negative"))))


def verdict(issues: DataFrame, strict: bool = False) -> DataFrame:
    """Issues per file and level, and whether the file passes: no error, in strict mode no warning either."""
    bad = F.col("level").isin("error", "warning") if strict else F.col("level") == "error"
    return issues.groupBy("file").agg(*[F.sum((F.col("level") == x).cast("long")).alias(f"{x}s") for x in ("error", "warning")], (F.sum(bad.cast("int")) == 0).alias("passes"))


def registry_summary(sections: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Two-way counts with totals of several tables: ``section``, ``row_label``, ``column_label``, ``n``."""
    return reduce(DataFrame.unionByName, [quality.crosstab(df, a, b).select(F.lit(name).alias("section"), "row_label", "column_label", "n") for name, (df, a, b) in sections.items()])


def used_flags(params: DataFrame, ids: list[str]) -> DataFrame:
    """How many of the parameters a run used carry each flag of confidence; ids without a row count as "unknown"."""
    used = params.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    return used.join(params.select("id", "confidence").distinct(), "id", "left").groupBy(F.coalesce("confidence", F.lit("unknown")).alias("confidence")).agg(F.count("*").alias("n"))


