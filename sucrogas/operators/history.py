"""History of changing attributes: type-two versions, merged delivery by delivery."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sucrogas.functions.names import same_company, vocabulary
from sucrogas.operators.snapshots import latest
from sucrogas.operators.vocabulary import learn, name_tokens
from sucrogas.session import ensure_checkpoint_dir

OPEN_END = "9999-12-31"
READING = "struct<date:date,capacity:double,company:int>"


def canonical_names(names: list[str], same: Callable[[str, str], bool]) -> list[int]:
    """Group numbers for spellings: two names share one if ``same`` links them, directly or through others."""
    group = list(range(len(names)))

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(names)):
        for j in range(i):
            a, b = root(i), root(j)
            if a != b and same(names[i], names[j]):
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(names))]


def company_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """The companies behind the spellings of each key: ``key``, ``name``, ``company`` (a number within the key).

    The common words are learned from all names; the spellings of one key, which are few whatever its rows, are compared
    with each other.  NULL keys and names have no row.
    """
    spelt = df.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("key"), F.col(name).alias("name")).distinct()
    names = spelt.select("name").distinct()
    common, total = learn(names.withColumn("words", name_tokens("name")), "name", "words")

    @F.pandas_udf(ArrayType(IntegerType()))
    def groups(spellings: pd.Series) -> pd.Series:
        words = vocabulary(common, total)
        return spellings.map(lambda xs: canonical_names(list(xs), lambda a, b: same_company(a, b, words)) if len(xs) > 1 else [0] * len(xs))

    per_key = spelt.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("names"))
    both = F.arrays_zip("names", groups("names").alias("company"))
    return per_key.select("key", F.explode(both).alias("_g")).select("key", F.col("_g.names").alias("name"), F.col("_g.company").alias("company"))


def empty_dimension(df: DataFrame, key: str) -> DataFrame:
    """A dimension of ``merge_versions`` without rows, for the keys of ``df``."""
    fields = f"key {dict(df.dtypes)[key]}, valid_from date, valid_to date, capacity double, company int, attr_hash bigint, seed_capacity double, seed_company int"
    return df.sparkSession.createDataFrame([], f"{fields}, readings array<{READING}>")


def merge_versions(current: DataFrame, delivery: DataFrame, tolerance: float) -> DataFrame:
    """Type-two merge of one delivery of readings into a dimension.

    ``current``: one row per key and version with its period, attributes, ``attr_hash``, the attributes last stated before it (``seed_*``) and the
    readings it was stated by.  ``delivery``: ``key``, ``date``, ``version``, ``capacity``, ``company``, any number of dates per key in any
    order, late ones and corrections too.  Deliveries come in the order of their versions: a delivered reading replaces the one the dimension holds for that
    date, and of those of one delivery the latest version is valid (equal versions: the larger payload).

    The attribute hash of each reading is compared with that of the version it follows: an equal hash confirms the version, another one closes
    it the day before and opens a new one.  Before the hash is taken, a capacity within ``tolerance`` of the last stated one is replaced by that
    one, and so is a NULL attribute.  Closed history from before a key's first delivered date passes through untouched; the versions
    that the delivery reaches are opened again.  All comparisons are made on one partitioning by key; a key is as
    large as its calendar.  NULL keys and dates are ignored; an empty delivery changes nothing.
    """
    reading = F.struct("date", F.col("capacity").cast("double").alias("capacity"), F.col("company").cast("int").alias("company"))
    given = delivery.where(F.col("key").isNotNull() & F.col("date").isNotNull()).select("key", reading.alias("_r"), F.lit(None).cast("struct<valid_from:date,c:double,o:int>").alias("_s"), F.lit(True).alias("_new"), "version")
    first = given.groupBy("key").agg(F.min("_r.date").alias("_first"))
    known = current.join(first, "key", "left").withColumn("_reached", F.coalesce(F.col("valid_to") >= F.date_sub("_first", 1), F.lit(False)))
    untouched = known.where("NOT _reached").select(*current.columns)
    seed = F.struct("valid_from", F.col("seed_capacity").alias("c"), F.col("seed_company").alias("o"))
    opened = known.where("_reached").select("key", F.explode("readings").alias("_r"), seed.alias("_s"), F.lit(False).alias("_new"), F.lit(None).cast(dict(delivery.dtypes)["version"]).alias("version"))
    rows = opened.unionByName(given).withColumn("_d", F.col("_r.date"))

    key = Window.partitionBy("key")
    newest = F.row_number().over(Window.partitionBy("key", "_d").orderBy(F.desc("_new"), F.desc_nulls_last("version"), F.desc("_r")))
    valid = rows.withColumn("_seed", F.min("_s").over(key)).withColumn("_n", newest).where("_n = 1").drop("_n", "_s", "_new", "version")
    order = key.orderBy("_d")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c, o = F.col("_r.capacity"), F.col("_r.company")
    last = lambda a, seed: F.coalesce(F.last(a, ignorenulls=True).over(before), F.col(seed))
    stated = valid.withColumns({"_c": last(c, "_seed.c"), "_o": last(o, "_seed.o"), "_start": F.row_number().over(order) == 1})
    new_c = F.when(F.abs(c - F.col("_c")) > tolerance, c).otherwise(F.col("_c"))
    new_o = F.when(o != F.col("_o"), o).otherwise(F.col("_o"))
    differs = attribute_hash(new_c, new_o) != attribute_hash(F.col("_c"), F.col("_o"))
    placed = stated.withColumn("_from", F.last(F.when(differs | F.col("_start"), F.col("_d")), ignorenulls=True).over(order))
    stated_first = lambda a: F.min_by(f"_r.{a}", F.when(F.col(f"_r.{a}").isNotNull(), F.col("_d")))
    versions = placed.groupBy("key", F.col("_from").alias("valid_from")).agg(
        F.collect_list("_r").alias("readings"), stated_first("capacity").alias("_capacity"), stated_first("company").alias("_company"), F.max(F.when(F.col("_d") == F.col("_from"), F.struct("_c", "_o"))).alias("_at")
    )
    end = F.coalesce(F.date_sub(F.lead("valid_from").over(key.orderBy("valid_from")), 1), F.lit(OPEN_END).cast("date"))
    capacity, company = F.coalesce("_capacity", "_at._c"), F.coalesce("_company", "_at._o")
    fresh = versions.select(
        "key", "valid_from", end.alias("valid_to"), capacity.alias("capacity"), company.alias("company"), attribute_hash(capacity, company).alias("attr_hash"), F.col("_at._c").alias("seed_capacity"), F.col("_at._o").alias("seed_company"), "readings"
    )
    return untouched.unionByName(fresh)


def attribute_hash(*attributes: Column) -> Column:
    """The hash of a version's attributes; NULL is a value."""
    return F.xxhash64(*[F.coalesce(a.cast("string"), F.lit("\0")) for a in attributes])


def delivered_history(df: DataFrame, key: str, date: str, version: str, capacity: str, operator: str, tolerance: float) -> DataFrame:
    """The history of a table of readings, its rows merged delivery by delivery: one delivery is what was loaded in one calendar year.

    See ``merge_versions``.  The company of each spelling is found first (``company_numbers``), so that another spelling is no change.  The years
    are those of the table (NULL versions come first); each merge is cut off by ``checkpoint()``.  Returns key (named as given),
    ``valid_from``, ``valid_to``, ``capacity``, ``company`` (number within the key), ``attr_hash``.  An empty table gives no rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = numbered_readings(df, key, date, version, capacity, operator).withColumn("_year", F.coalesce(F.year("version"), F.lit(0))).checkpoint()
    years = sorted(r[0] for r in rows.select("_year").distinct().collect())  # a calendar
    dimension = empty_dimension(df, key)
    for y in years:
        dimension = merge_versions(dimension, rows.where(F.col("_year") == y).drop("_year"), tolerance).checkpoint()
    return dimension.select(F.col("key").alias(key), "valid_from", "valid_to", "capacity", "company", "attr_hash")


def recomputed_history(df: DataFrame, key: str, date: str, version: str, capacity: str, operator: str, tolerance: float) -> DataFrame:
    """The same from all readings at once: one delivery merged into an empty dimension."""
    rows = numbered_readings(df, key, date, version, capacity, operator)
    return merge_versions(empty_dimension(df, key), rows, tolerance).select(F.col("key").alias(key), "valid_from", "valid_to", "capacity", "company", "attr_hash")


def numbered_readings(df: DataFrame, key: str, date: str, version: str, capacity: str, operator: str) -> DataFrame:
    """Readings as ``merge_versions`` takes them, the spelling of the operator replaced by its company; spellings are joined by their hash, so the texts are not shuffled."""
    numbers = company_numbers(df, key, operator).select("key", F.xxhash64("name").alias("_spelt"), "company")
    cells = df.select(F.col(key).alias("key"), F.col(date).cast("date").alias("date"), F.col(version).cast("timestamp").alias("version"), F.col(capacity).cast("double").alias("capacity"), F.when(F.col(operator).isNotNull(), F.xxhash64(operator)).alias("_spelt"))
    return cells.join(numbers, ["key", "_spelt"], "left").drop("_spelt")


def scd2_merge(current: DataFrame, updates: DataFrame, key: str, attributes: list[str], date: str) -> DataFrame:
    """Type-two merge of one delivery into a dimension.

    ``current`` has key, attributes, ``valid_from``, ``valid_to`` (open rows end 9999-12-31) and
    ``attr_hash``; ``updates`` one row per key with the attributes and the date they hold from
    (of several the latest date wins).  Hashes are compared with the open version: an equal hash
    changes nothing, another one closes the open row the day before and opens a new version, an
    unknown key opens its first version.  Closed history passes through untouched, so only open
    rows take part in the join.  Updates dated before the open version's start are ignored, NULL keys
    too; the hash covers NULL attributes as values.
    """
    given = updates.select(key, F.col(date).alias("_version"), F.col(date).alias("_from"), *[F.col(a).alias(f"_new_{a}") for a in attributes])
    new = latest(given, [key], "_version", ["_from", *[f"_new_{a}" for a in attributes]])
    new = new.withColumn("_new_hash", F.xxhash64(*[F.coalesce(F.col(f"_new_{a}").cast("string"), F.lit("\0")) for a in attributes]))
    end = F.lit(OPEN_END).cast("date")
    columns = [key, *attributes, "valid_from", "valid_to", "attr_hash"]
    closed = current.where(F.col("valid_to") != end).select(*columns)
    opened = current.where(F.col("valid_to") == end).select(*columns)
    both = opened.join(new, key, "full_outer")
    known = F.col("valid_from").isNotNull()
    differs = F.col("_new_hash").isNotNull() & (~known | ((F.col("_new_hash") != F.col("attr_hash")) & (F.col("_from") > F.col("valid_from"))))
    kept = F.struct(*[F.col(a).alias(a) for a in attributes], F.col("valid_from").alias("valid_from"), F.when(differs, F.date_sub("_from", 1)).otherwise(end).alias("valid_to"), F.col("attr_hash").alias("attr_hash"))
    fresh = F.struct(*[F.col(f"_new_{a}").alias(a) for a in attributes], F.col("_from").alias("valid_from"), end.alias("valid_to"), F.col("_new_hash").alias("attr_hash"))
    rows = F.array_compact(F.array(F.when(known, kept), F.when(differs, fresh)))
    merged = both.select(key, F.explode(rows).alias("_v")).select(key, "_v.*")
    return closed.unionByName(merged.select(*columns))


def with_hash(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Adds the ``attr_hash`` that ``scd2_merge`` compares."""
    return df.withColumn("attr_hash", F.xxhash64(*[F.coalesce(F.col(a).cast("string"), F.lit("\0")) for a in attributes]))
