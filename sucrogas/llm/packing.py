"""Filling containers of fixed capacity: configuration LP over the length histogram.

The lengths are grouped into classes; a *configuration* says how many items of each class share a
container.  The covering LP over configurations is solved by multiplicative weights: the
weights price the classes, a knapsack dynamic program finds the configuration of highest price,
a small share of the demand is covered by it and its classes become cheaper.  The same prices bound
the LP from below, and the search ends when the cover is within ``GAP`` of that bound.  The fractional
solution is rounded, and what is left is packed by the same dynamic program with whole counts.  Only
the length histogram (at most ``capacity`` numbers) reaches the driver; items get their containers in
parallel by their rank in a class.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sucrogas.operators.ranks import buckets_for, spread_rank

#: Most classes; with the capacity, which is the length of the knapsack table, they bound the driver's work whatever the data.
CLASSES = 384
#: Most of a class's demand that one round covers in the first passes (then halved), and how much cheaper (as a power of e) such a round makes it.
STEPS = (1.0, 0.1)
LEARN = 0.1
#: A cover this near to the lower bound of the LP, or within the same whole container, ends the search; no pass begins that would exceed so many rounds.
GAP = 0.005
ROUNDS = 8000
#: A class's first price is its length to this power: above 1, long items, which are hard to place, come first.
SLOPE = 1.05

class Plan(NamedTuple):
    """Containers per configuration: class of each size, per class the slots with their containers, and the LP's lower bound for these classes."""

    class_of: np.ndarray
    slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    containers: int
    rounds: int
    bound: float


def group_sizes(sizes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Linear grouping: the largest size of each class, so that classes hold about equal total length.

    Few distinct sizes keep a class each; otherwise neighbouring sizes share one and count as its largest.
    """
    if len(sizes) <= most:
        return sizes
    share = np.cumsum(counts * np.sqrt(sizes.astype(float)))
    edges = np.searchsorted(share, share[-1] * np.arange(1, most + 1) / most)
    return np.unique(sizes[np.minimum(edges, len(sizes) - 1)])


def knapsack(cells: np.ndarray, prices: np.ndarray, supply: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each class that maximise the price within the capacity and the supply (bounded knapsack).

    Multiplicities are split into powers of two, so every step is one vector operation over the table.
    """
    value = np.zeros(capacity + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for k in np.flatnonzero((supply > 0) & (prices > 0) & (cells <= capacity)):
        left = int(min(supply[k], capacity // cells[k]))
        copies = 1
        while left > 0:
            take = min(copies, left)
            left -= take
            copies *= 2
            room = take * int(cells[k])
            new = value[: capacity + 1 - room] + take * prices[k]
            better = new > value[room:] + 1e-15
            value[room:] = np.where(better, new, value[room:])
            steps.append((k, take, np.packbits(better)))
    out = np.zeros(len(cells), dtype=np.int64)
    at = int(np.argmax(value >= value[-1] - 1e-12)) if capacity else 0
    for k, take, better in reversed(steps):
        room = take * int(cells[k])
        if at >= room and better[(at - room) >> 3] >> (7 - (at - room & 7)) & 1:
            out[k] += take
            at -= room
    return out


def cover(cells: np.ndarray, demand: np.ndarray, room: int, prices: np.ndarray) -> tuple[list[list[tuple[np.ndarray, float]]], float, np.ndarray, int]:
    """Fractional covers of the demand by configurations: those of the first pass and of the best one.

    A pass covers every class exactly.  Prices are dual values: divided by the dearest configuration, what they
    give for the demand is a lower bound of the LP.  Each pass takes smaller steps and starts at the prices of the
    best bound so far.  Returns also that bound, its prices and the number of rounds.
    """
    length = cells / room
    bound, best = float(length @ demand) / float(length @ knapsack(cells, length, demand, room)), prices
    covers: list[tuple[float, list[tuple[np.ndarray, float]]]] = []
    rounds, step = 0, STEPS[0]
    while True:
        before, start, covered = rounds, best, np.zeros(len(cells))
        patterns: dict[bytes, list] = {}
        while (open_ := covered < 1 - 1e-9).any():
            rounds += 1
            p = start * np.exp(-LEARN / step * covered)
            p /= p[open_].max()
            a = knapsack(cells, np.where(open_, p, 0.0), np.where(open_, demand, 0), room)
            if open_.all() and (low := float(p @ demand) / float(p @ a)) > bound:
                bound, best = low, p
            used = a > 0
            x = float(np.min(demand[used] * np.minimum(1 - covered[used], step) / a[used]))
            covered += a * x / demand
            patterns.setdefault(a.tobytes(), [a, 0.0])[1] += x
        covers.append((sum(x for _, x in patterns.values()), [(a, x) for a, x in patterns.values()]))
        finer = STEPS[len(covers)] if len(covers) < len(STEPS) else step / 2
        if min(covers, key=lambda c: c[0])[0] <= max(bound * (1 + GAP), np.ceil(bound - 1e-6)) or rounds + (rounds - before) * step / finer > ROUNDS:
            break
        step = finer
    found = [covers[0], min(covers, key=lambda c: c[0])]
    return [c for _, c in found[: 1 + (found[0] is not found[1])]], bound, best, rounds


def whole(patterns: list[tuple[np.ndarray, float]], cells: np.ndarray, demand: np.ndarray, room: int, prices: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """A fractional cover in whole containers, rounded so that the running total keeps up; the rest by the same program with whole counts."""
    todo = demand.copy()
    chosen: list[tuple[np.ndarray, int]] = []
    due = 0.0
    for a, x in sorted(patterns, key=lambda e: -e[1]):
        used = a > 0
        due += x
        n = min(int(due + 1e-9), int(np.min(todo[used] // a[used])))
        due -= int(due + 1e-9)
        if n > 0:
            chosen.append((a, n))
            todo -= a * n
    while todo.any():
        a = knapsack(cells, prices / prices[todo > 0].max(), todo, room)
        used = a > 0
        n = int(np.min(todo[used] // a[used]))
        chosen.append((a, n))
        todo -= a * n
    return chosen


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Configurations with whole multiplicities that hold all items of the histogram (sizes 1..capacity)."""
    tops = group_sizes(sizes, counts, CLASSES)
    cls = np.searchsorted(tops, sizes)
    demand = np.bincount(cls, weights=counts, minlength=len(tops)).astype(np.int64)
    mean = (np.bincount(cls, weights=counts * sizes, minlength=len(tops)) / np.maximum(demand, 1) / capacity) ** SLOPE
    covers, bound, dual, rounds = cover(tops, demand, capacity, mean)
    # Rounded with either price for the rest; every plan is a whole one, the one with fewest containers is taken.
    plans = [whole(c, tops, demand, capacity, p) for c in covers for p in ((tops / capacity) ** SLOPE, dual)]
    chosen = min(plans, key=lambda c: sum(n for _, n in c))

    slots: dict[int, list[tuple[int, int, int]]] = {}
    at = np.zeros(len(tops), dtype=np.int64)
    first = 0
    for a, n in chosen:
        for k in np.flatnonzero(a):
            slots.setdefault(int(k), []).append((int(at[k]), int(a[k]), first))
            at[k] += a[k] * n
        first += n
    table = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}
    class_of = np.full(capacity + 1, -1, dtype=np.int32)
    class_of[sizes] = cls
    return Plan(class_of, table, first, rounds, bound)


def pack(items: DataFrame, item: str, size: str, limits: list[tuple[str, int]]) -> tuple[DataFrame, dict[str, Plan]]:
    """Containers for all items under each limit.

    ``items`` has one row per item with a non-negative size; ``limits`` are (name, capacity).  An item within the
    capacity is never split; a longer one fills whole containers of its own and its rest is an
    item.  Items of size 0 take no room and get container -1; NULL sizes count as 0.  Equal items
    (repeated rows) are items of their own as long as their ids differ; of rows with one id each is packed.

    Returns the rows ``limit_id``, ``capacity``, item, ``piece`` (0 unless split), ``start`` (offset of the piece), ``size``, ``container``, and the
    plan of each limit that has items to share containers, with the lower bound of its LP.
    """
    base = items.select(F.col(item), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    cap = F.array(*[F.struct(F.lit(n).alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for n, c in limits])
    each = base.select(item, "_size", F.explode(cap).alias("_l")).select(item, "_size", "_l.*")
    last = F.greatest(F.ceil(F.col("_size") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    pieces = each.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "limit_id", "capacity", item, "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.least(F.col("_size") - F.col("piece") * F.col("capacity"), F.col("capacity")).alias("size")
    )
    histogram = pieces.where("size > 0 AND size < capacity").groupBy("limit_id", "size").agg(F.count("*").alias("n")).toPandas()
    sized = {n: buckets_for(int(histogram.loc[histogram["limit_id"] == n, "n"].sum())) for n, _ in limits}
    buckets = max(sized.values(), default=8)
    plans = {}
    for name, capacity in limits:
        h = histogram[histogram["limit_id"] == name].sort_values("size")
        plans[name] = (capacity, solve(h["size"].to_numpy(dtype=np.int64), h["n"].to_numpy(dtype=np.int64), capacity)) if len(h) else (capacity, None)
    look = {n: p.class_of for n, (_, p) in plans.items() if p}

    @F.pandas_udf("int")
    def class_of(limit: pd.Series, s: pd.Series) -> pd.Series:
        out = np.full(len(s), -1, dtype=np.int32)
        for n in limit.unique():
            if n in look:
                at = (limit == n).to_numpy()
                out[at] = look[n][np.minimum(s.to_numpy()[at], len(look[n]) - 1)]
        return pd.Series(out)

    slots = {n: p.slots for n, (_, p) in plans.items() if p}

    @F.pandas_udf("long")
    def container_of(limit: pd.Series, k: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.full(len(rank), -1, dtype=np.int64)
        frame = pd.DataFrame({"l": limit, "k": k, "r": rank})
        for (n, c), g in frame.groupby(["l", "k"], sort=False):
            start, copies, first = slots[n][int(c)]
            at = np.searchsorted(start, g.r.to_numpy(), side="right") - 1
            out[g.index.to_numpy()] = first[at] + (g.r.to_numpy() - start[at]) // copies[at]
        return pd.Series(out)

    packed = pieces.where("size > 0 AND size < capacity").withColumn("_k", class_of("limit_id", "size"))
    ranked = spread_rank(packed, ["limit_id", "_k"], F.xxhash64(item, "piece"), buckets, rank="_rank")
    shared = ranked.select("limit_id", "capacity", item, "piece", "start", "size", container_of("limit_id", "_k", "_rank").alias("container"))
    own = pieces.where("size = capacity OR size = 0").withColumn("container", F.when(F.col("size") == 0, F.lit(-1).cast("long")))
    # Full pieces need no plan: their containers are numbered behind the planned ones by a spread rank.
    full = own.where("size > 0").drop("container")
    numbered = spread_rank(full, ["limit_id"], F.xxhash64(item, "piece"), buckets_for(full.count()), rank="_rank")
    after = F.create_map(*[x for n, (_, p) in plans.items() for x in (F.lit(n), F.lit(p.containers if p else 0).cast("long"))])
    alone = numbered.select("limit_id", "capacity", item, "piece", "start", "size", (after[F.col("limit_id")] + F.col("_rank")).alias("container"))
    rows = shared.unionByName(alone).unionByName(own.where("size = 0").select("limit_id", "capacity", item, "piece", "start", "size", "container"))
    return rows, {n: p for n, (_, p) in plans.items() if p}


def packing_report(packed: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """Per limit: items, tokens, containers, their fill, the least number of containers the tokens need, and how the plan compares with its LP.

    ``lp_bound`` is the lower bound of the configuration LP, ``planned`` the containers of the plan (full pieces stand alone beside it), ``lp_gap``
    their relative distance, ``rounds`` the rounds of multiplicative weights.
    """
    real = packed.where("container >= 0")
    look = lambda f: F.create_map(*[x for n, p in plans.items() for x in (F.lit(n), F.lit(f(p)))])[F.col("limit_id")] if plans else F.lit(None)
    report = real.groupBy("limit_id", "capacity").agg(
        F.count("*").alias("pieces"),
        F.sum("size").alias("tokens"),
        (F.max("container") + 1).alias("containers"),
    ).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity"))).withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity")))
    return report.withColumns({
        "planned": look(lambda p: int(p.containers)).cast("long"), "lp_bound": look(lambda p: float(p.bound)).cast("double"),
        "lp_gap": look(lambda p: float(p.containers / p.bound - 1)).cast("double"), "rounds": look(lambda p: int(p.rounds)).cast("long"),
    })
