"""Tables out of text: pages, sections, labelled series, context classes, checks of extracted records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pages(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row per page of form-feed separated texts, counted from 1; one blank page at the end is dropped; NULL texts have none."""
    parts = F.split(text, "\f")
    kept = F.when((F.size(parts) > 1) & (F.trim(F.element_at(parts, -1)) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.where(F.col(text).isNotNull()).select(doc, F.posexplode(kept).alias("_p", "page_text")).select(doc, (F.col("_p") + 1).alias("page"), "page_text")


def lines(paged: DataFrame, doc: str) -> DataFrame:
    """One row per line, counted from 1 within a page; all kinds of line ends."""
    return paged.select(doc, "page", F.posexplode(F.split("page_text", r"\r\n|\n|\r")).alias("_l", "line_text")).select(doc, "page", (F.col("_l") + 1).alias("line"), "line_text")


def with_section(numbered: DataFrame, doc: str, header: Column, end: Column | None = None) -> DataFrame:
    """Adds the last header line above each line of the document; a line for which ``end`` holds closes the section."""
    mark = F.when(header, F.col("line_text"))
    if end is not None:
        mark = F.when(end, F.lit("")).otherwise(mark)
    order = Window.partitionBy(doc).orderBy("page", "line")
    return numbered.withColumn("section", F.nullif(F.last(mark, ignorenulls=True).over(order), F.lit("")))


def labelled_numbers(numbered: DataFrame, doc: str, pattern: str) -> DataFrame:
    """Lines "label ... number": label, first number token and unit word; the pattern has those three groups."""
    hit = numbered.where(F.col("line_text").rlike(pattern))
    return hit.select(doc, "page", "line", *[F.regexp_extract("line_text", pattern, i).alias(n) for i, n in ((1, "label"), (2, "number"), (3, "unit"))])


def cue_class(paged: DataFrame, doc: str, cues: dict[str, str], lookback: int) -> DataFrame:
    """The class whose cue phrases stand on a page or up to ``lookback`` pages before; NULL for none or several."""
    w = Window.partitionBy(doc).orderBy("page").rangeBetween(-lookback, 0)
    marked = paged.select(doc, "page", *[F.max(F.lower("page_text").rlike(p).cast("int")).over(w).alias(f"_{k}") for k, p in cues.items()])
    n = sum((F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in cues), F.lit(0))
    label = F.coalesce(*[F.when(F.col(f"_{k}") == 1, F.lit(k)) for k in cues])
    return marked.select(doc, "page", F.when(n == 1, label).alias("context"))


def verify_quotes(records: DataFrame, paged: DataFrame, doc: str) -> DataFrame:
    """Checks of extracted values: ``quote`` stands on its ``page``, the value's digits stand in the quote.

    White space is folded on both sides.  Returns the record with ``quote_found`` and ``value_in_quote`` (NULL without a quote).
    """
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    j = records.join(paged, [doc, "page"], "left")
    found = F.coalesce(F.contains(fold(F.col("page_text")), fold(F.col("quote"))), F.lit(False))
    return j.withColumn("quote_found", F.when(F.col("quote").isNotNull(), found)).withColumn("value_in_quote", F.contains(F.regexp_replace("quote", r"[^0-9]", ""), F.regexp_replace("value_text", r"[^0-9]", ""))).drop("page_text")


def plausible(df: DataFrame, bands: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """Ratios against their bands: a value and a flag per name; NULL where a part is missing."""
    return df.select("*", *[x for n, (ratio, lo, hi) in bands.items() for x in (ratio.alias(n), ratio.between(lo, hi).alias(f"{n}_ok"))])


def header_fields(paged: DataFrame, doc: str, patterns: dict[str, str], last_page: int = 2) -> DataFrame:
    """Fields of a report's head: for each name the first group of its pattern's first match on the first pages; NULL where there is none.

    The pages are looked at one by one, so a later page counts only where no earlier one has the field.
    """
    head = paged.where(F.col("page") <= last_page)
    hit = lambda p: F.nullif(F.regexp_extract("page_text", p, 1), F.lit(""))
    return head.groupBy(doc).agg(*[F.min_by(hit(p), F.when(hit(p).isNotNull(), F.col("page"))).alias(n) for n, p in patterns.items()])


def furniture(numbered: DataFrame, doc: str, least_pages: int) -> DataFrame:
    """Lines that stand on at least so many pages of a document (running heads and feet): doc, ``line_text``; blank lines are none."""
    per = numbered.where(F.trim("line_text") != "").groupBy(doc, "line_text").agg(F.count_distinct("page").alias("_p"))
    return per.where(F.col("_p") >= least_pages).select(doc, "line_text")


def anchored_rows(numbered: DataFrame, doc: str, row: str, names: list[str], skip: DataFrame | None = None) -> DataFrame:
    """Blocks of lines of one form with the line above each block, across page ends.

    ``row`` matches a line and has one group per name.  Blank lines and those in ``skip`` (doc, ``line_text``: running heads) do not end a block, any other line
    does.  Returns doc, ``anchor`` (the line above the block, NULL at the start), ``block`` (from 0 within the document), ``page``, ``line``, ``quote``, the groups.
    """
    text = numbered.where(F.trim("line_text") != "")
    if skip is not None:
        text = text.join(skip.select(doc, "line_text"), [doc, "line_text"], "left_anti")
    order = Window.partitionBy(doc).orderBy("page", "line")
    is_row = F.col("line_text").rlike(row)
    marked = text.withColumn("anchor", F.last(F.when(~is_row, F.col("line_text")), ignorenulls=True).over(order)).withColumn("_start", (is_row & ~F.coalesce(F.lag(is_row).over(order), F.lit(False))).cast("long"))
    numbered_blocks = marked.withColumn("block", F.sum("_start").over(order) - 1).where(is_row)
    return numbered_blocks.select(doc, "anchor", "block", "page", "line", F.col("line_text").alias("quote"), *[F.regexp_extract("line_text", row, i).alias(n) for i, n in enumerate(names, 1)])


def phrase_values(paged: DataFrame, doc: str, variables: dict[str, tuple[str, str]]) -> DataFrame:
    """Values stated in phrases, with their period: doc, ``variable``, ``page``, ``nth`` on it, ``value_text``, ``period``, ``unit``, ``quote``.

    ``variables``: name to (pattern with the groups value and period, unit).  All matches of a page are taken.
    """
    hits = []
    for name, (pattern, unit) in variables.items():
        groups = [F.regexp_extract_all("page_text", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((0, "quote"), (1, "value_text"), (2, "period"))]
        zipped = F.arrays_zip(*groups)
        hits.append(F.transform(zipped, _hit(name, unit)))
    return paged.select(doc, "page", F.explode(F.concat(*hits)).alias("_h")).select(doc, "page", "_h.*")


def _hit(name: str, unit: str):
    """What ``phrase_values`` makes of one match and its place."""
    return lambda x, i: F.struct(F.lit(name).alias("variable"), i.alias("nth"), x["value_text"].alias("value_text"), x["period"].alias("period"), F.lit(unit).alias("unit"), x["quote"].alias("quote"))


def repeated_figures(values: DataFrame, doc: str) -> DataFrame:
    """Notes on figures that stand in a document more than once: doc, ``value_text``, ``n``, ``pages``, and whether their variables, units or periods differ."""
    g = values.groupBy(doc, "value_text").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"),
        *[(F.count_distinct(c) > 1).alias(f"other_{c}") for c in ("variable", "unit", "period")],
    )
    return g.where("n > 1")


def year_records(values: DataFrame, doc: str) -> DataFrame:
    """One record per document and year: doc, ``year``, ``n`` and the ``variables`` with value, unit and page in order; several values of a variable are all kept.

    ``values`` as from ``phrase_values``; the year is the one a period starts with.  Periods of another form give no record.
    """
    year = F.substring("period", 1, 4).try_cast("int")
    one = F.struct("variable", "page", "nth", F.concat(F.col("variable"), F.lit("="), F.col("value_text"), F.lit(" "), F.col("unit"), F.lit("@"), F.col("page")).alias("text"))
    g = values.withColumn("year", year).where("year IS NOT NULL").groupBy(doc, "year").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("_v"))
    return g.select(doc, "year", "n", F.array_join(F.transform("_v", lambda x: x["text"]), "; ").alias("variables"))


def record_issues(values: DataFrame, paged: DataFrame, doc: str, number: Column, units: dict[str, str], bands: dict[str, tuple[float, float]], tolerance: float) -> DataFrame:
    """Checks of extracted values, one row per broken rule: doc, ``variable``, ``page``, ``nth``, ``rule``.

    The page exists; the quote stands on it; the value's digits stand in the quote; the period stands in the quote; the unit is the variable's; ``number`` (the
    value as a number) is stated and within the variable's band; a value is not given twice for one variable and period; two values of one
    variable and period do not differ by more than ``tolerance`` of the larger.
    """
    fold = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    digits = lambda c: F.regexp_replace(c, r"[^0-9]", "")
    same = Window.partitionBy(doc, "variable", "period")
    v = values.withColumn("_v", number).withColumns({"_n": F.count("*").over(Window.partitionBy(doc, "variable", "period", "value_text")), "_lo": F.min("_v").over(same), "_hi": F.max("_v").over(same)})
    j = v.join(paged.select(doc, "page", F.col("page_text").alias("_text")), [doc, "page"], "left")
    unit = F.element_at(F.create_map(*[x for k, u in units.items() for x in (F.lit(k), F.lit(u))]), F.col("variable"))
    inside = F.coalesce(*[F.when(F.col("variable") == k, F.col("_v").between(lo, hi)) for k, (lo, hi) in bands.items()], F.lit(True))
    rules = {
        "page does not exist": F.col("_text").isNull(), "quote is not on its page": ~F.contains(fold(F.col("_text")), fold(F.col("quote"))), "value is not in the quote": ~F.contains(digits(F.col("quote")), digits(F.col("value_text"))),
        "period is not in the quote": ~F.contains(F.col("quote"), F.col("period")), "unit is not the variable's": ~F.col("unit").eqNullSafe(unit), "value is no number": F.col("_v").isNull(), "value is out of its band": ~inside,
        "value is given twice": F.col("_n") > 1, "values differ": F.try_divide(F.col("_hi") - F.col("_lo"), F.col("_hi")) > tolerance,
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(r)) for r, bad in rules.items()]))
    return j.select(doc, "variable", "page", "nth", F.explode(broken).alias("rule"))


def listed_items(numbered: DataFrame, doc: str, header: Column, item: str, done: str) -> DataFrame:
    """Items of lists and check lists with the heading above: doc, ``section``, ``page``, ``line``, ``item``, ``done``.

    ``item`` has one group, the text; ``done`` is a pattern of items that are ticked.
    """
    s = with_section(numbered, doc, header)
    return s.where(F.col("line_text").rlike(item)).select(doc, "section", "page", "line", F.trim(F.regexp_extract("line_text", item, 1)).alias("item"), F.col("line_text").rlike(done).alias("done"))


def table_cells(numbered: DataFrame, doc: str, sep: str = "|") -> DataFrame:
    """Cells of tables written with a separator at both ends of a line: doc, ``page``, ``line``, ``cell`` (from 0), ``value``; rules of dashes are left out."""
    inner = F.regexp_replace(F.regexp_replace(F.trim("line_text"), rf"^\{sep}", ""), rf"\{sep}$", "")
    rows = numbered.where(F.trim("line_text").startswith(sep) & F.trim("line_text").endswith(sep) & (F.length(F.trim("line_text")) > 1) & ~F.col("line_text").rlike(rf"^[\s\-:{sep}]+$"))
    return rows.select(doc, "page", "line", F.posexplode(F.split(inner, rf"\{sep}")).alias("cell", "_v")).select(doc, "page", "line", "cell", F.trim("_v").alias("value"))
