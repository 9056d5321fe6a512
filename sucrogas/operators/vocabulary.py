"""The common words of a set of names, learned from the names themselves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sucrogas.functions.names import tokens

#: A word is common if it stands with at least so many different companies, and at least this share of all names does so.
MIN_COMPANIES = 10
SHARE = 1 / 1000

Counts = tuple[tuple[str, int], ...]


@F.pandas_udf(ArrayType(StringType()))
def name_tokens(names: pd.Series) -> pd.Series:
    """The word tokens of each name; NULL has none."""
    return names.map(lambda x: tokens(x) if isinstance(x, str) else [])


def learn(names: DataFrame, name: str, words: str) -> tuple[Counts, int]:
    """Common words with the number of names that hold each, and the number of names.

    ``names`` has one row per distinct name with its ``words`` (array).  Beside each word stands the rarest other word of its name,
    which for a common word is mostly another company's own word each time; a word with at least ``MIN_COMPANIES`` and ``SHARE`` x
    names such partners is common.  The result is bounded: a name counts once for each of its words, so not more than words per name /
    ``SHARE`` words pass (a few thousand), whatever the number of names.  No names give no words.
    """
    each = names.select(F.xxhash64(name).alias("_n"), F.explode(F.array_distinct(words)).alias("_w")).where("_w <> ''")
    df = each.groupBy("_w").agg(F.count("*").alias("_df"))
    per = each.join(df, "_w").groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("_df", "_w"))).alias("_ws"))
    rarest, second = F.col("_ws")[0]["_w"], F.col("_ws")[1]["_w"]
    pairs = per.where(F.size("_ws") > 1).select(F.explode("_ws").alias("_x"), rarest.alias("_a"), second.alias("_b"))
    partner = F.when(F.col("_x._w") == F.col("_a"), F.col("_b")).otherwise(F.col("_a"))
    spread = pairs.groupBy(F.col("_x._w").alias("w")).agg(F.max("_x._df").alias("n"), F.count_distinct(partner).alias("partners"))
    total = names.count()
    rows = spread.where(F.col("partners") >= max(MIN_COMPANIES, total * SHARE)).select("w", "n").orderBy("w").collect()
    return tuple((r["w"], int(r["n"])) for r in rows), total
