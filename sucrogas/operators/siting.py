"""Site scores, weight robustness, distance-decay coverage and hub selection."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sucrogas.operators.ranks import quantiles, running_before, value_ranks
from sucrogas.operators.spatial import haversine_km
from sucrogas.session import ensure_checkpoint_dir


#: Rows of one draw that a single window may rank.
ROWS_PER_WINDOW = 1_000_000


def normalize(df: DataFrame, criteria: dict[str, str], method: str = "linear", excluded: str | None = None) -> DataFrame:
    """Criteria mapped to [0, 1] (1 best) as columns ``n_<name>``; ``criteria`` is column -> "higher" or "lower".

    Bounds (linear) and ranks (percentile: mid-rank share) are taken over the rows that are not excluded.  A constant
    criterion gives 1; NULL stays NULL.  The bounds are one aggregated row, joined as such.
    """
    if method not in ("linear", "percentile"):
        raise ValueError("method must be linear or percentile")
    kept = ~F.coalesce(F.col(excluded), F.lit(False)) if excluded else F.lit(True)
    out = df
    if method == "linear":
        bounds = df.where(kept).agg(*[f(c).alias(f"_{n}_{c}") for c in criteria for n, f in (("lo", F.min), ("hi", F.max))]).first()
        for c, way in criteria.items():
            lo, hi = bounds[f"_lo_{c}"], bounds[f"_hi_{c}"]
            if lo is None:
                x: Column = F.lit(None).cast("double")
            elif lo == hi:
                x = F.when(F.col(c).isNotNull(), F.lit(1.0))
            else:
                x = F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.lit(lo)) / F.lit(hi - lo))))
                x = 1 - x if way == "lower" else x
            out = out.withColumn(f"n_{c}", x)
        return out
    for c, way in criteria.items():
        every = df.where(kept & F.col(c).isNotNull()).count()
        # Excluded values between the kept ones are placed by the same order.
        values = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.sum(kept.cast("long")).alias("k"))
        placed = running_before(values, [], [F.col("_v")], ["k"])
        share = F.try_divide((2 * F.col("before_k") + F.col("k")).cast("double"), F.lit(2.0 * (every or 0)))
        table = placed.select("_v", (1 - share if way == "lower" else share).alias(f"n_{c}"))
        out = out.join(table, F.col(c) == F.col("_v"), "left").drop("_v")
    return out


def score(df: DataFrame, weights: dict[str, float], excluded: str | None = None, name: str = "score") -> DataFrame:
    """Weighted sum of ``n_`` columns; NULL for excluded rows and where a criterion with weight is NULL.  Weights are scaled to 1."""
    total = sum(weights.values())
    if total <= 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative and must not all be 0")
    s: Column = F.lit(0.0)
    for c, w in weights.items():
        if w:
            s = s + F.col(f"n_{c}") * (w / total)
    return df.withColumn(name, F.when(~F.coalesce(F.col(excluded), F.lit(False)), s) if excluded else s)


def rank_scores(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Competition rank in descending order; NULL values stay unranked.  Ties share the smallest rank."""
    by = by or []
    ranked = value_ranks(df, by, value).select(*by, value, "rank")
    return df.join(ranked, [*by, value], "left")


def weight_draws(names: list[str], n: int, concentration: float, seed: int) -> list[tuple]:
    """Seeded Dirichlet weight vectors around equal weights: (draw, weight...)."""
    w = np.random.default_rng(seed).dirichlet([concentration] * len(names), size=n)
    return [(i, *map(float, row)) for i, row in enumerate(w)]


def weight_sensitivity(df: DataFrame, key: str, names: list[str], draws: list[tuple], top_k: int) -> DataFrame:
    """Rank statistics of every row over weight vectors: median, 5 % and 95 % rank, share of draws in the top k (ties included).

    The draws are a short parameter list, exploded from one literal; ranks are made per draw.  Up to ``ROWS_PER_WINDOW`` rows a draw is
    ranked by one window of its own (there are as many tasks as draws); with more rows, which are counted first, the ranks come
    from ``value_ranks``, which splits a draw.  Both give the same ranks.  A row's ranks are as many as there are draws.
    """
    fields = ", ".join(f"w{i}: double" for i in range(len(names)))
    lit = F.from_json(F.lit(json.dumps([{"draw": d[0], **{f"w{i}": x for i, x in enumerate(d[1:])}} for d in draws])), f"array<struct<draw: int, {fields}>>")
    s: Column = F.lit(0.0)
    for i, c in enumerate(names):
        s = s + F.col(f"n_{c}") * F.col(f"_d.w{i}")
    long = df.select(key, *[f"n_{c}" for c in names], F.explode(lit).alias("_d")).select(key, F.col("_d.draw").alias("draw"), F.round(s, 12).alias("s")).where(F.col("s").isNotNull())
    if df.count() <= ROWS_PER_WINDOW:
        ranked = long.select(key, F.rank().over(Window.partitionBy("draw").orderBy(F.col("s").desc())).alias("r"))
    else:
        ranked = long.join(value_ranks(long, ["draw"], "s").select("draw", "s", F.col("rank").cast("int").alias("r")), ["draw", "s"]).select(key, "r")
    per = ranked.groupBy(key).agg(F.sort_array(F.collect_list("r")).alias("_r"))

    def at(q: float) -> Column:
        place = F.lit(q) * (F.size("_r") - 1)
        lo, hi = F.col("_r")[F.floor(place).cast("int")], F.col("_r")[F.ceil(place).cast("int")]
        return lo + (hi - lo) * (place - F.floor(place))

    top = F.size(F.filter("_r", lambda r: r <= top_k)) / F.size("_r")
    return per.select(key, at(0.5).alias("rank_median"), at(0.05).alias("rank_p05"), at(0.95).alias("rank_p95"), top.alias("p_top_k"))


def one_at_a_time(df: DataFrame, key: str, weights: dict[str, float], delta: float, top_k: int) -> DataFrame:
    """Share of the base top k that stays when one weight moves by +-delta (relative); exactly k rows by score, then key."""
    if not 0 < delta < 1:
        raise ValueError("delta must lie in (0, 1)")
    vectors = [("base", 0, weights)]
    for c in weights:
        vectors += [(c, sign, {**weights, c: weights[c] * (1 + sign * delta)}) for sign in (-1, 1)]
    structs = []
    for c, sign, w in vectors:
        total = sum(w.values())
        structs.append(F.struct(F.lit(c).alias("criterion"), F.lit(sign).alias("sign"), *[F.lit(w[x] / total).alias(f"w_{x}") for x in weights]))
    s: Column = F.lit(0.0)
    for c in weights:
        s = s + F.col(f"n_{c}") * F.col(f"_w.w_{c}")
    long = df.select(key, *[f"n_{c}" for c in weights], F.explode(F.array(*structs)).alias("_w")).select(key, "_w.criterion", "_w.sign", F.round(s, 12).alias("s")).where(F.col("s").isNotNull())
    top = long.withColumn("r", F.row_number().over(Window.partitionBy("criterion", "sign").orderBy(F.col("s").desc(), key))).where(F.col("r") <= top_k)
    base = top.where("sign = 0").select(key, F.lit(True).alias("in_base"))
    moved = top.where("sign <> 0").join(base, key, "left")
    return moved.groupBy("criterion", "sign").agg((F.sum(F.coalesce("in_base", F.lit(False)).cast("long")) / F.lit(top_k)).alias("top_k_kept"))


def spaced_selection(df: DataFrame, key: str, rank: str, min_km: float, n: int) -> DataFrame:
    """Up to ``n`` sites, best rank first (ties by key), at least ``min_km`` apart.  ``rank`` is any column that orders them.

    Each pick is one distributed top-1 over the candidates that are far enough from all earlier picks; the driver holds only the picks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    left = df.where(F.col(rank).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(key, rank, "lat", "lon").checkpoint()
    picks: list[tuple] = []
    far: Column = F.lit(True)
    while len(picks) < n:
        best = left.where(far).orderBy(rank, key).limit(1).collect()
        if not best:
            break
        picks.append((len(picks) + 1, best[0][key]))
        far = far & (haversine_km(F.col("lat"), F.col("lon"), F.lit(best[0]["lat"]), F.lit(best[0]["lon"])) >= min_km) & (F.col(key) != best[0][key])
    return df.sparkSession.createDataFrame(picks, f"pick int, {key} {dict(df.dtypes)[key]}")


def decay_weight(km: Column, full_km: float, zero_km: float) -> Column:
    """1 up to ``full_km``, 0 from ``zero_km``, linear between; a step if they are equal; 0 for NULL."""
    if zero_km <= full_km:
        return F.when(km <= full_km, 1.0).otherwise(0.0)
    return F.when(km <= full_km, 1.0).when(km < zero_km, (F.lit(zero_km) - km) / (zero_km - full_km)).otherwise(0.0)


def upper_bound(edges: DataFrame, supply: DataFrame, q_min: float) -> DataFrame:
    """Supply covered if every hub that could reach ``q_min`` alone were open: hubs, covered supply.

    ``edges``: ``i``, ``j``, ``w``; ``supply``: ``i``, ``s``.
    """
    e = edges.join(supply, "i")
    viable = e.groupBy("j").agg(F.sum(F.col("w") * F.col("s")).alias("q")).where((F.col("q") >= q_min) & (F.col("q") > 0))
    best = e.join(viable.select("j"), "j", "left_semi").groupBy("i", "s").agg(F.max("w").alias("w"))
    return best.agg(F.coalesce(F.sum(F.col("w") * F.col("s")), F.lit(0.0)).alias("covered")), viable


def upper_bound_of(pairs: Callable[[DataFrame], DataFrame], hubs: DataFrame, q_min: float) -> tuple[DataFrame, DataFrame]:
    """``upper_bound`` where edges are cheaper to make again than to keep: ``pairs`` gives the edges ``i``, ``j``, ``w``, ``s`` of some of the ``hubs`` (``j``).

    The second time only the hubs that reach ``q_min`` are paired; no edge is shuffled.
    """
    ensure_checkpoint_dir(hubs.sparkSession)
    viable = pairs(hubs).groupBy("j").agg(F.sum(F.col("w") * F.col("s")).alias("q")).where((F.col("q") >= q_min) & (F.col("q") > 0)).checkpoint()
    best = pairs(hubs.join(viable.select("j"), "j", "left_semi")).groupBy("i").agg(F.max("w").alias("w"), F.first("s").alias("s"))
    return best.agg(F.coalesce(F.sum(F.col("w") * F.col("s")), F.lit(0.0)).alias("covered")), viable


def greedy_coverage(edges: DataFrame, supply: DataFrame, q_min: float, max_hubs: int | None = None, target_share: float | None = None, fixed: list | None = None, cut_every: int = 5) -> DataFrame:
    """Hubs opened one by one, each the one that adds most supply (ties: lowest hub), while it adds at least ``q_min``.

    Every step is one aggregation over the edges joined with the best weight each source has so far; the
    driver sees one row per step.  The state is checkpointed every few steps.  ``fixed`` hubs are opened first.
    Stops at ``max_hubs`` new hubs (None: no limit), at ``target_share`` of all supply or when nothing adds enough.
    Returns ``step``, ``hub``, ``fixed``, ``gain``, ``covered``.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.where("w > 0").join(supply, "i").select("i", "j", "w", "s").repartition("i").checkpoint()
    total = supply.agg(F.sum("s")).first()[0] or 0.0
    best = e.select("i").distinct().select("i", F.lit(0.0).alias("b")).checkpoint()
    steps: list[tuple] = []
    covered = 0.0
    waiting = list(fixed or [])
    while True:
        gains = e.join(best, "i").groupBy("j").agg(F.sum(F.greatest(F.col("w") - F.col("b"), F.lit(0.0)) * F.col("s")).alias("g"))
        done = [s[1] for s in steps]
        if waiting:
            hub = waiting.pop(0)
            row = gains.where(F.col("j") == hub).collect()
            gain, is_fixed = (row[0]["g"] if row else 0.0), True
        else:
            if (max_hubs is not None and sum(not s[2] for s in steps) >= max_hubs) or (target_share is not None and total > 0 and covered >= target_share * total):
                break
            row = gains.where(~F.col("j").isin(done)).select("j", F.round("g", 9).alias("g")).orderBy(F.col("g").desc(), "j").limit(1).collect()
            if not row or row[0]["g"] <= 0 or row[0]["g"] < q_min:
                break
            hub, gain, is_fixed = row[0]["j"], row[0]["g"], False
        covered += gain
        steps.append((len(steps) + 1, hub, is_fixed, float(gain), float(covered)))
        mine = e.where(F.col("j") == hub).select("i", F.col("w").alias("_w"))
        best = best.join(mine, "i", "left").select("i", F.greatest("b", F.coalesce("_w", F.lit(0.0))).alias("b"))
        if len(steps) % cut_every == 0:
            best = best.checkpoint()
    return spark.createDataFrame(steps, f"step int, hub {dict(edges.dtypes)['j']}, fixed boolean, gain double, covered double")


def allocate(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each source to its best open hub; ties to the hub opened earlier.  ``hubs``: ``hub``, ``step``.  Returns ``i``, ``hub``, ``w``."""
    open_ = edges.join(hubs.select(F.col("hub").alias("j"), "step"), "j").where("w > 0")
    best = open_.groupBy("i").agg(F.max_by(F.struct("j", "w"), F.struct("w", -F.col("step"))).alias("_b"))
    return best.select("i", F.col("_b.j").alias("hub"), F.col("_b.w").alias("w"))


def allocate_to(pairs: Callable[..., DataFrame], sources: DataFrame) -> DataFrame:
    """``allocate`` where edges are cheaper to make again than to keep; ties of weight and step to the lowest hub.  Returns ``i``, ``hub``, ``w``.

    ``pairs`` gives the edges ``i``, ``j``, ``step``, ``w`` > 0 of the ``sources`` (``i``) with the named columns of theirs.  The best weight of every source is
    found first, so that only hubs of that weight are compared by step.
    """
    best = pairs(sources).groupBy("i").agg(F.max("w").alias("top"))
    tied = pairs(sources.join(best, "i"), "top").where(F.col("w") == F.col("top"))
    return tied.groupBy("i", "w").agg(F.min(F.struct("step", "j")).alias("_b")).select("i", F.col("_b.j").alias("hub"), "w")


def allowed_pairs(edges: DataFrame, routes: DataFrame, kinds: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Edges whose residue may go to that kind of hub.

    ``routes``: ``i``, ``route`` (blank or NULL: may go anywhere); ``kinds``: ``j``, ``kind``; ``allowed``: (route, kind).  The list is a condition of the join's result, so
    pairs that are not allowed never reach the weighting.
    """
    return edges.join(routes, "i").join(kinds, "j").where(may_go(F.col("route"), F.col("kind"), allowed)).select(*edges.columns)


def pairs_from_matrix(matrix: DataFrame, row: str, columns: list[str], most: float) -> DataFrame:
    """A dense matrix (one row per origin, one column per destination) as the pairs at most ``most`` apart: row, ``destination``, ``km``.  NULL and NaN are no pair."""
    long = matrix.select(row, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([row], columns, "destination", "km")
    return long.where(F.col("km").isNotNull() & ~F.isnan("km") & (F.col("km") <= most))


def factor_codes(df: DataFrame, column: str) -> DataFrame:
    """Adds ``code``: the place of each value among the sorted distinct values, from 0; NULL values get -1.

    Only the distinct values are ordered (by range partitions), not the rows.
    """
    levels = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_one", F.lit(1))
    codes = running_before(levels, [], [F.col(column)], ["_one"]).select(column, F.col("before__one").cast("long").alias("code"))
    return df.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(-1).cast("long")))


def nearest_of(distances: list[str]) -> Column:
    """The least of several distances, NULL ones left out; NULL if none is known."""
    return F.least(*[F.col(d) for d in distances])


def top_per_place(cells: DataFrame, rank: str, places: DataFrame, place: str, top: int) -> DataFrame:
    """Cells among the ``top`` ranked ones per place; places without any have 0."""
    n = cells.where(F.col(rank) <= top).groupBy(place).agg(F.count("*").alias("n_top"))
    return places.select(place).distinct().join(n, place, "left").select(place, F.coalesce("n_top", F.lit(0)).alias("n_top"))


def grid_scores(cells: DataFrame, criteria: dict[str, str], weights: dict[str, float], *, gate: tuple[str, float] | None, extra_exclusions: Column | None, clip: float | None, draws: list[tuple], top_k: int, key: str) -> DataFrame:
    """The scoring job over a grid: exclusions, gate, bounds, scores, ranks, contributions and how robust each rank is.

    Excluded are rows with ``excluded``, those for which ``extra_exclusions`` holds and those below the ``gate`` (column, quantile of the kept rows).  Criteria are cut at
    their ``clip`` quantile (of the kept rows) before they are normalised, so that one extreme cell does not flatten the others.  Each ``n_`` column's share of the
    score is its ``part_``.  Returns key, ``excluded``, ``score``, ``rank``, parts, and rank statistics over the weight draws (NULL for excluded cells).
    """
    base = cells.withColumn("excluded", F.coalesce(F.col("excluded"), F.lit(False)) | F.coalesce(extra_exclusions, F.lit(False)) if extra_exclusions is not None else F.coalesce(F.col("excluded"), F.lit(False)))
    if gate:
        base = quantile_gate(base, gate[0], gate[1], "excluded")
    if clip is not None:
        for c in criteria:
            row = quantiles(base.where("NOT excluded"), [], c, {"top": clip}).first()
            if row:
                base = base.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.col(c), F.lit(row["top"]))))
    normal = normalize(base, criteria, "linear", "excluded")
    total = sum(weights.values())
    scored = score(normal, weights, "excluded").withColumn("score", F.round("score", 10))
    ranked = rank_scores(scored, "score").withColumns({f"part_{c}": F.when(~F.col("excluded"), F.col(f"n_{c}") * (w / total)) for c, w in weights.items()})
    robust = weight_sensitivity(normal.where("NOT excluded"), key, list(criteria), draws, top_k)
    return ranked.select(key, "excluded", "score", "rank", *[f"part_{c}" for c in weights]).join(robust, key, "left")


def hubs_for_share(trace: DataFrame, total: float, shares: list[float]) -> DataFrame:
    """How many hubs, fixed ones not counted, it takes to reach each share of the supply; NULL if none does.  The trace is one row per step."""
    new = trace.withColumn("_new", F.sum((~F.col("fixed")).cast("int")).over(Window.orderBy("step")))
    return new.agg(*[F.min(F.when(F.col("covered") >= s * total, F.col("_new"))).cast("int").alias(f"step_{round(s * 100)}") for s in shares])


def prune_hubs(edges: DataFrame, supply: DataFrame, hubs: DataFrame, q_min: float) -> DataFrame:
    """Hubs left when those with less than ``q_min`` after allocation are closed, smallest first (ties: the later step), their sources going to the next best.

    ``hubs``: ``hub``, ``step``, ``fixed`` (fixed ones stay).  One aggregation per closed hub; the driver holds the hubs, a row per greedy step.  Returns ``step``, ``hub``, ``fixed``,
    ``closed``, ``supply`` and ``sources`` of the open ones (0 for closed ones).
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    mine = edges.join(hubs.select(F.col("hub").alias("j")), "j", "left_semi").join(supply, "i").checkpoint()
    all_ = [(r["step"], r["hub"], bool(r["fixed"])) for r in hubs.select("step", "hub", "fixed").orderBy("step").collect()]
    open_ = list(all_)
    kind = dict(hubs.dtypes)["hub"]
    while True:
        now = spark.createDataFrame(open_, f"step int, hub {kind}, fixed boolean") if open_ else hubs.select(F.col("step").cast("int").alias("step"), "hub", "fixed").limit(0)
        got = allocate(mine.select("i", "j", "w"), now).join(supply, "i").groupBy("hub").agg(F.sum(F.col("w") * F.col("s")).alias("q"), F.count_distinct(F.when(F.col("w") * F.col("s") > 0, F.col("i"))).alias("n"))
        have = {r["hub"]: (r["q"], r["n"]) for r in got.collect()}
        weak = [(have.get(h, (0.0, 0))[0], -step, h) for step, h, fixed in open_ if not fixed and have.get(h, (0.0, 0))[0] < q_min]
        if not weak:
            rows = [(step, h, f, h not in {x[1] for x in open_}, float(have.get(h, (0.0, 0))[0]), int(have.get(h, (0.0, 0))[1])) for step, h, f in all_]
            return spark.createDataFrame(rows, f"step int, hub {kind}, fixed boolean, closed boolean, supply double, sources long")
        open_ = [x for x in open_ if x[1] != min(weak)[2]]


def cells_behind(allocation: DataFrame, supply: DataFrame, hubs: DataFrame) -> DataFrame:
    """Distinct sources with supply behind a set of hubs, and their allocated supply: one row."""
    a = allocation.join(hubs.select("hub").distinct(), "hub", "left_semi").join(supply, "i").where(F.col("w") * F.col("s") > 0)
    return a.agg(F.count_distinct("i").alias("sources"), F.coalesce(F.sum(F.col("w") * F.col("s")), F.lit(0.0)).alias("supply"))


def edge_issues(edges: DataFrame) -> DataFrame:
    """What keeps edges from being weights: repeated pairs, and weights that are missing or outside [0, 1]: ``i``, ``j``, ``issue``."""
    g = edges.groupBy("i", "j").agg(F.count("*").alias("n"), F.bool_or(~F.coalesce(F.col("w").between(0, 1), F.lit(False))).alias("bad"))
    found = F.array_compact(F.array(F.when(F.col("n") > 1, F.lit("repeated")), F.when(F.col("bad"), F.lit("no weight in [0, 1]"))))
    return g.select("i", "j", F.explode(found).alias("issue"))


def withhold_small(df: DataFrame, count: str, values: list[str], k_min: int) -> DataFrame:
    """Disclosure rule: values behind 0 < count < k_min become NULL and are flagged."""
    hide = (F.col(count) > 0) & (F.col(count) < k_min)
    return df.withColumns({v: F.when(~hide, F.col(v)) for v in values}).withColumn("withheld", F.coalesce(hide, F.lit(False)))


def quantile_gate(df: DataFrame, value: str, q: float, excluded: str) -> DataFrame:
    """Rows below the q-quantile of the kept rows become excluded too (one scalar; NULL values are not gated)."""
    row = quantiles(df.where(~F.coalesce(F.col(excluded), F.lit(False))), [], value, {"cut": q}).first()
    cut = row["cut"] if row else None
    below = F.coalesce(F.col(value) < F.lit(cut), F.lit(False)) if cut is not None else F.lit(False)
    return df.withColumn(excluded, F.coalesce(F.col(excluded), F.lit(False)) | below)


def huff_allocation(edges: DataFrame, mills: DataFrame, cells: DataFrame, alpha: float, beta: float | str, max_km: float, by: str = "year") -> DataFrame:
    """Spatial interaction: every cell's amount goes to the mills in reach in proportion to capacity ** alpha * exp(-beta km).

    ``edges``: ``cell``, ``mill``, ``km``; ``mills``: ``by``, ``mill``, ``capacity``, ``active``; ``cells``: ``cell``, ``amount`` and ``by`` (left out: the amount holds for all).  ``by`` is the
    year, or another dimension such as a grid of ``beta`` (then the name of its column).  Scores are shifted by their maximum; cells without an active mill in reach give nothing.
    """
    reach = edges.where(F.col("km") <= max_km).join(mills.where("active AND capacity > 0"), "mill")
    b = F.col(beta) if isinstance(beta, str) else F.lit(beta)
    s = reach.select(by, "cell", "mill", (alpha * F.log("capacity") - b * F.col("km")).alias("s"))
    w = Window.partitionBy(by, "cell")
    e = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(w)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(w))
    on = [by, "cell"] if by in cells.columns else ["cell"]
    return p.join(cells, on).groupBy(by, "mill").agg(F.sum(F.col("p") * F.col("amount")).alias("amount"))


def huff_grid(pairs: Callable[..., DataFrame], cells: DataFrame, betas: Sequence[float]) -> DataFrame:
    """``huff_allocation`` for every value of ``betas`` at once: ``beta``, ``mill``, ``amount``.

    ``pairs`` gives the edges ``cell``, ``mill``, ``km`` and ``pull`` (alpha * ln(capacity)) of cells with the named columns of theirs; ``cells``: ``cell``, ``amount`` and what
    ``pairs`` needs.  The values are columns, so an edge is not repeated, and edges are made again for each of the three sums instead of sorted by cell.
    """
    s = [F.col("pull") - b * F.col("km") for b in betas]
    top = pairs(cells).groupBy("cell").agg(*[F.max(x).alias(f"m{k}") for k, x in enumerate(s)])
    e = [F.exp(x - F.col(f"m{k}")) for k, x in enumerate(s)]
    with_top = cells.join(top, "cell")
    total = pairs(with_top, *top.columns[1:]).groupBy("cell").agg(*[F.sum(x).alias(f"z{k}") for k, x in enumerate(e)])
    # A cell's factor is amount / total, one column per value.
    ready = with_top.join(total, "cell").withColumns({f"z{k}": F.col("amount") / F.col(f"z{k}") for k in range(len(betas))})
    wide = pairs(ready, *top.columns[1:], *total.columns[1:]).groupBy("mill").agg(*[F.sum(x * F.col(f"z{k}")).alias(f"a{k}") for k, x in enumerate(e)])
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("beta"), F.col(f"a{k}").alias("amount")) for k, b in enumerate(betas)]))
    return wide.select("mill", each.alias("_e")).select("_e.beta", "mill", "_e.amount")


def may_go(route: Column, kind: Column, allowed: list[tuple[str, str]]) -> Column:
    """Whether a residue of that route (blank or NULL: any) may go to that kind of hub."""
    listed = F.lit(False)
    for r, k in allowed:
        listed = listed | ((route == r) & (kind == k))
    return (F.coalesce(F.trim(route), F.lit("")) == "") | F.coalesce(listed, F.lit(False))


def coverage_by_route(pairs: Callable[..., DataFrame], sources: DataFrame, hubs: DataFrame, routes: list[str], allowed: list[tuple[str, str]], q_min: float, max_hubs: int) -> tuple[DataFrame, DataFrame]:
    """Greedy hubs, allocation and upper bound under the rule of ``may_go``, where edges are cheaper to make again than to keep.

    ``sources``: ``i``, ``lat``, ``lon`` and for the k-th of ``routes`` supply ``s<k>`` and sources with supply ``n<k>``; ``hubs``: ``j``, ``lat``, ``lon``, ``kind``, of one place and kind the lowest
    (others add nothing once it is open).  ``pairs`` gives the edges ``i``, ``j``, ``w`` > 0 of sources and hubs with the named columns of either.  A step pairs every place once and sums what each route would gain; the
    driver sees one row per step.  Returns the hubs (``step``, ``hub``, ``supply``, ``sources``) and one row ``covered``, the upper bound.
    """
    spark = sources.sparkSession
    ensure_checkpoint_dir(spark)
    every = range(len(routes))
    s, n, b = ([f"{x}{k}" for k in every] for x in "snb")
    goes = [may_go(F.lit(r), F.col("kind"), allowed) for r in routes]
    places = hubs.groupBy("lat", "lon").agg(F.min("j").alias("j"))
    kinds = hubs.withColumnRenamed("j", "hub").join(places, ["lat", "lon"]).checkpoint()
    places = kinds.select("lat", "lon", "j").distinct()
    best = sources.withColumns({x: F.lit(0.0) for x in b}).checkpoint()
    steps: list[tuple] = []
    viable = None
    while viable is None or len(steps) < max_hubs:
        gains = pairs(best, places, [*s, *b]).groupBy("j").agg(*[F.sum(F.greatest(F.col("w") - F.col(b[k]), F.lit(0.0)) * F.col(s[k])).alias(f"t{k}") for k in every])
        now = kinds.join(gains, "j").withColumn("g", sum((F.when(goes[k], F.col(f"t{k}")).otherwise(0.0) for k in every), F.lit(0.0))).checkpoint()
        if viable is None:
            viable = now.where((F.col("g") >= q_min) & (F.col("g") > 0))
            if max_hubs < 1:
                break
        row = now.where(~F.col("hub").isin([x[1] for x in steps])).select("hub", "kind", F.round("g", 9).alias("g")).orderBy(F.col("g").desc(), "hub").limit(1).collect()
        if not row or row[0]["g"] <= 0 or row[0]["g"] < q_min:
            break
        steps.append((len(steps) + 1, row[0]["hub"]))
        one = kinds.where(F.col("hub") == row[0]["hub"]).select("lat", "lon", F.col("hub").alias("j"))
        mine = pairs(sources, one, []).select("i", F.col("w").alias("_w"))
        better = {b[k]: F.greatest(F.col(b[k]), F.when(may_go(F.lit(r), F.lit(row[0]["kind"]), allowed), F.coalesce("_w", F.lit(0.0))).otherwise(0.0)) for k, r in enumerate(routes)}
        best = best.join(mine, "i", "left").withColumns(better).drop("_w").checkpoint()
    hub_kind = dict(hubs.dtypes)["j"]
    opened = spark.createDataFrame(steps, f"step int, hub {hub_kind}")
    open_ = kinds.drop("j").join(F.broadcast(opened), "hub").withColumnRenamed("hub", "j").checkpoint()
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("r"), goes[k].alias("goes"), F.col(s[k]).alias("s"), F.col(n[k]).alias("n")) for k in every]))
    reach = pairs(sources, open_, [*s, *n], ["step", "kind"]).select("i", "j", "w", "step", long.alias("_r")).where("_r.goes")
    taken = reach.groupBy("i", "_r.r").agg(F.max_by(F.struct("j", "w", "_r.s", "_r.n"), F.struct("w", -F.col("step"))).alias("_b"))
    per = taken.groupBy(F.col("_b.j").alias("hub")).agg(F.sum(F.col("_b.w") * F.col("_b.s")).alias("supply"), F.sum("_b.n").alias("sources"))
    takes = viable.groupBy("lat", "lon", "j").agg(*[F.bool_or(goes[k]).alias(f"v{k}") for k in every])
    top = pairs(sources, takes, s, [f"v{k}" for k in every]).groupBy("i").agg(*[F.max(F.when(F.col(f"v{k}"), F.col("w"))).alias(b[k]) for k in every], *[F.first(x).alias(x) for x in s])
    bound = top.agg(F.sum(sum((F.coalesce(F.col(b[k]) * F.col(s[k]), F.lit(0.0)) for k in every), F.lit(0.0))).alias("covered"))
    return opened.join(per, "hub", "left").na.fill(0, ["supply", "sources"]), bound
