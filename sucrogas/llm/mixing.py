"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is a shuffled stream of its documents, cut into blocks of equally many tokens; a document that
crosses a border goes on in the source's next block.  A schedule of slots, each of one block, says which source comes next, so the shares
are those of the slots to within one block per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sucrogas.operators.ranks import buckets_for, spread_rank

#: Tokens of a block.
BLOCK_TOKENS = 512
#: Most rows of the plan that are broadcast.
MAX_BROADCAST = 20_000
GOLDEN = 0.6180339887498949


def mix_plan(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per mix and source: tokens at hand, blocks at most, and the slots of the whole mix.

    The mix is as large as the scarcest source allows: a source with share s and t tokens, each used
    at most r times, allows r * t / s tokens in all.  A source without tokens cannot take part: it has ``tokens`` 0 and the others keep their
    proportions; ``mix_report`` shows it with an actual share of 0.  Sources with a share of 0 or NULL take no part.  A few rows per mix.
    """
    sizes = docs.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    t = targets.where((F.col("target_share") > 0) & F.col("source").isNotNull()).groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = t.join(sizes, "source").where("tokens > 0")
    mix = Window.partitionBy("mix_id")
    allowed = F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).over(mix)
    by_source = mix.orderBy("source")
    share = F.col("target_share") / F.sum("target_share").over(mix)
    return have.select(
        "mix_id", "source", share.alias("target_share"), "max_repeats", "tokens", "docs",
        F.floor(allowed / block_tokens).cast("long").alias("slots"),
        (F.sum("target_share").over(by_source) / F.sum("target_share").over(mix) - share).alias("share_from"),
        (F.sum("target_share").over(by_source) / F.sum("target_share").over(mix)).alias("share_to"),
    )


def schedule(plan: DataFrame) -> DataFrame:
    """The source of every slot: slot i of a mix belongs to the source whose cumulative share holds frac(i * golden ratio).

    ``block`` counts the slots of a source within its mix.  Slots are made in parallel from the few rows of the
    plan; the count within a source is a spread rank.  Returns ``mix_id``, ``source``, ``slot``, ``block``.
    """
    mixes = plan.where("slots > 0").groupBy("mix_id").agg(F.max("slots").alias("slots"), F.sort_array(F.collect_list(F.struct("share_to", "source"))).alias("_cum"))
    # Long mixes are made in stretches of 4096 slots, so that no task expands a whole mix.
    stretches = mixes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / 4096))).alias("_s")).repartition("mix_id", "_s")
    each = stretches.select("mix_id", "slots", "_cum", F.explode(F.sequence(F.col("_s") * 4096, F.least(F.col("_s") * 4096 + 4095, F.col("slots") - 1))).alias("slot"))
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    placed = each.withColumn("_p", point - F.floor(point))
    hit = F.filter("_cum", lambda c: c["share_to"] > F.col("_p"))
    named = placed.select("mix_id", "slot", F.coalesce(hit[0]["source"], F.element_at("_cum", -1)["source"]).alias("source"), "slots")
    # Slots of a mix are spread evenly over the range of a long, so the order is that of the slots.
    order = ((F.col("slot").cast("double") / F.col("slots") * 2.0 - 1.0) * F.lit(2.0**62)).cast("long")
    slots = plan.groupBy("mix_id").agg(F.max("slots").alias("n")).agg(F.sum("n")).first()[0] or 0
    return spread_rank(named, ["mix_id", "source"], order, buckets_for(slots), rank="block").select("mix_id", "source", "slot", "block")


def source_blocks(docs: DataFrame, plan: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """The stream of each mix and source, cut into blocks of equal tokens.

    Every repeat is shuffled anew and follows the one before.  A document has one row for each block that it reaches into: ``start`` is the first of its tokens
    there, ``tokens`` their number, ``at`` their place in the block.  Returns ``mix_id``, ``source``, ``repeat``, ``doc_id``, ``start``, ``tokens``, ``block``, ``at``.
    """
    need = F.ceil((F.col("slots") * F.col("target_share") + 8) * block_tokens / F.col("tokens")).cast("int")
    uses = plan.where("slots > 0").select("mix_id", "source", F.explode(F.sequence(F.lit(1), F.least(need, F.col("max_repeats")))).alias("repeat"), F.col("tokens").alias("source_tokens"), "docs")
    # One row per mix, source and repeat: counted before it is sent to every task, joined by shuffle beyond the bound.
    few = uses.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    rows = docs.where("tokens > 0").select("doc_id", "source", "tokens").join(F.broadcast(uses.drop("docs")) if few else uses.drop("docs"), "source")
    total = uses.agg(F.sum("docs")).first()[0] or 0
    ordered = spread_rank(rows, ["mix_id", "source", "repeat"], F.xxhash64("doc_id", "repeat", "mix_id", F.lit(seed)), buckets_for(total), rank="_rank", weight="tokens", before="_before")
    first = (F.col("repeat") - 1) * F.col("source_tokens") + F.col("_before")
    reached = F.sequence(F.floor(F.col("_first") / block_tokens), F.floor((F.col("_first") + F.col("tokens") - 1) / block_tokens))
    cut = ordered.withColumn("_first", first).withColumn("block", F.explode(reached))
    start = F.greatest(F.col("block") * block_tokens - F.col("_first"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_tokens - F.col("_first"), F.col("tokens"))
    at = F.greatest(F.col("_first") - F.col("block") * block_tokens, F.lit(0))
    return cut.select("mix_id", "source", "repeat", "doc_id", start.alias("start"), (end - start).alias("tokens"), "block", at.alias("at"))


def mix(docs: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """Documents of every mix in the order of its schedule.

    ``docs``: ``doc_id`` (unique), ``source``, ``tokens``.  Documents without a source or without tokens are in no mix.  No
    document is used more than ``max_repeats`` times in a mix: a use may be cut into consecutive pieces, and only its last ones may be missing.
    Returns ``mix_id``, ``slot``, ``source``, ``doc_id``, ``repeat``, ``start``, ``tokens``, ``at``: the mix is read by slot and, within it, by ``at``.
    """
    plan = mix_plan(docs, targets, block_tokens)
    slots = schedule(plan)
    blocks = source_blocks(docs, plan, block_tokens, seed)
    return blocks.join(slots, ["mix_id", "source", "block"]).select("mix_id", "slot", "source", "doc_id", "repeat", "start", "tokens", "at")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target and reached share, documents, tokens, slots, highest number of uses of a document, filled slots of the mix and slots it has.

    A use is a repeat of a document, in however many pieces.  Sources that gave nothing have 0 throughout.
    """
    per_doc = mixed.groupBy("mix_id", "source", "doc_id").agg(F.count_distinct("repeat").alias("uses"), F.sum("tokens").alias("tokens"))
    per = per_doc.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"), F.max("uses").alias("most_uses"))
    slots = mixed.groupBy("mix_id", "source", "slot").agg(F.lit(1).alias("one")).groupBy("mix_id", "source").agg(F.count("*").alias("slots"), F.max("slot").alias("_last"))
    mix = Window.partitionBy("mix_id")
    t = targets.select("mix_id", "source", "target_share", "max_repeats")
    joined = t.join(per, ["mix_id", "source"], "left").join(slots, ["mix_id", "source"], "left").na.fill(0, ["tokens", "docs", "most_uses", "slots"])
    out = joined.withColumns({
        "actual_share": F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(mix), F.lit(0)), F.lit(0.0)),
        "mix_slots_filled": F.sum("slots").over(mix), "mix_slots": F.coalesce(F.max("_last").over(mix) + 1, F.lit(0)),
    })
    return out.drop("_last")
