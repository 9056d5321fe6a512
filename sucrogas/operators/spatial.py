"""Distances, radius joins, disc sums, polygons and grids as relational operators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sucrogas.operators.ranks import buckets_for, spread_rank

#: Mean and authalic Earth radius.
EARTH_KM = 6371.0088
AUTHALIC_M = 6371007.181

#: Tasks that share a cube of a radius join, and keys of one place in one list.
SPLITS = 8
KEYS_PER_LIST = 10_000


def _square(c: Column) -> Column:
    return c * c


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def sphere_xyz_m(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Points on the sphere in metres."""
    r = EARTH_KM * 1000
    return F.lit(r) * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.lit(r) * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.lit(r) * F.sin(F.radians(lat))


def detour_ratio(road_km: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Road over great-circle distance; NULL at zero distance."""
    return F.try_divide(road_km, haversine_km(lat1, lon1, lat2, lon2))


def at_places(df: DataFrame, key: str, *aggs: Column, by: Sequence[str] = ()) -> DataFrame:
    """One row per place (equal ``lat`` and ``lon``, and equal ``by``): its least ``key`` under the same name, ``n`` rows, and ``aggs``.  Rows without coordinates are left out."""
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy("lat", "lon", *by).agg(F.min(key).alias(key), F.count("*").alias("n"), *aggs)


def listed_at_places(df: DataFrame, key: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``at_places`` with all keys of a place as the list ``name``.  A place of more than ``KEYS_PER_LIST`` rows has several lists, so none grows without bound."""
    most = at_places(df, key, by=by).agg(F.max("n")).first()[0] or 1
    lists = -(-most // KEYS_PER_LIST)
    parted = df.withColumn("_list", F.pmod(F.xxhash64(key), F.lit(lists)))
    return at_places(parted, key, F.collect_list(key).alias(name), by=[*by, "_list"]).drop("_list")


def pairs_within(a: DataFrame, b: DataFrame, a_id: str, b_id: str, max_km: float, a_with: Sequence[str] = (), b_with: Sequence[str] = (), allowed: Column | None = None) -> DataFrame:
    """All (a, b) pairs at most ``max_km`` apart, by an equi-join on a grid of cubes around the sphere: the ids, ``km``, and the columns ``a_with`` and ``b_with``.

    Cubes have an edge of the chord of ``max_km``, so partners lie in the same or a neighbouring cube; ``b`` is
    exploded over those of its 27 neighbours that hold a part of the sphere in reach, and the distance decides.  Chords settle all
    pairs but those at the very border; ``km`` is computed once, for true pairs.  ``allowed`` is a condition on the columns that come along.  Both need ``lat`` and ``lon``; rows with a NULL are left out.

    The tables are small and the pairs many, so partitions are numbered by the cores, not by bytes (which would leave one task);
    every cube of ``a`` is dealt to ``SPLITS`` tasks.
    """
    if max_km <= 0:
        raise ValueError("max_km must be positive")
    chord = 2 * EARTH_KM * 1000 * math.sin(min(max_km / EARTH_KM, math.pi) / 2)
    edge = chord * (1 + 1e-9) + 1e-3
    inner = max(0.0, chord * (1 - 1e-9) - 1e-3)
    spark = a.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def points(df: DataFrame, key: str, tag: str, carried: Sequence[str]) -> DataFrame:
        x, y, z = sphere_xyz_m(F.col("lat"), F.col("lon"))
        known = df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        at = known.select(F.col(key).alias(f"_{tag}"), F.radians("lat").alias(f"_{tag}p"), F.col("lon").alias(f"_{tag}lon"), x.alias(f"_{tag}x"), y.alias(f"_{tag}y"), z.alias(f"_{tag}z"), *carried)
        return at.withColumns({f"_{tag}cos": F.cos(f"_{tag}p"), **{f"c{i}": F.floor(F.col(f"_{tag}{c}") / edge).cast("int") for i, c in enumerate("xyz")}})

    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    near = points(b, b_id, "b", b_with).withColumn("_n", steps).withColumns({"c0": F.col("c0") + F.col("_n.i"), "c1": F.col("c1") + F.col("_n.j"), "c2": F.col("c2") + F.col("_n.k")}).drop("_n")
    gap, low, high = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i, c in enumerate("xyz"):
        lo, hi = F.col(f"c{i}") * F.lit(edge), (F.col(f"c{i}") + 1) * F.lit(edge)
        gap = gap + _square(F.greatest(lo - F.col(f"_b{c}"), F.col(f"_b{c}") - hi, F.lit(0.0)))
        low, high = low + _square(F.greatest(lo, -hi, F.lit(0.0))), high + _square(F.greatest(-lo, hi))
    r = EARTH_KM * 1000
    near = near.where((gap <= edge * edge * (1 + 1e-9)) & (low <= (r + 1) ** 2) & (high >= (r - 1) ** 2))
    left = points(a, a_id, "a", a_with).withColumn("_s", F.pmod(F.xxhash64("_a"), F.lit(SPLITS)).cast("int")).repartition(parts, "c0", "c1", "c2", "_s")
    right = near.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))).repartition(parts, "c0", "c1", "c2", "_s")

    d2 = sum((_square(F.col(f"_a{c}") - F.col(f"_b{c}")) for c in "xyz"), F.lit(0.0))
    half = (F.sin((F.col("_bp") - F.col("_ap")) / 2), F.sin(F.radians(F.col("_blon") - F.col("_alon")) / 2))
    km = F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(_square(half[0]) + F.col("_acos") * F.col("_bcos") * _square(half[1]), F.lit(1.0))))
    near_enough = (d2 < inner * inner) | ((d2 <= edge * edge) & (km <= max_km))
    on = near_enough if allowed is None else near_enough & allowed
    # Estimates do not see how far ``b`` is exploded, so a broadcast is ruled out.
    joined = left.join(right.hint("merge"), ["c0", "c1", "c2", "_s"]).where(on)
    return joined.select(F.col("_a").alias(a_id), F.col("_b").alias(b_id), km.alias("km"), *a_with, *b_with)


def disc_sums(sources: DataFrame, queries: DataFrame, query_id: str, value: str, radius_m: float, cell_m: float) -> DataFrame:
    """Sum of values whose cell centre lies within the radius of the query's cell centre (boundary included).

    Values are summed per cell, then per row of cells as running sums; each query reads two running
    sums for every row its disc cuts, which is 2 r / cell + 1 joined rows instead of one per cell.
    Both tables need ``x`` and ``y`` in metres; NULL values count 0; a query without sources gets 0.
    """
    reach = int(radius_m / cell_m + 1e-9)
    ix, iy = F.floor(F.col("x") / cell_m).cast("long"), F.floor(F.col("y") / cell_m).cast("long")
    cells = sources.groupBy(iy.alias("iy"), ix.alias("ix")).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("v"))
    rows = F.explode(F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(int(math.sqrt(max(0.0, (radius_m / cell_m) ** 2 - dy * dy)) + 1e-9)).cast("long").alias("half")) for dy in range(-reach, reach + 1)]))
    q = queries.select(query_id, ix.alias("qx"), iy.alias("qy"))
    wanted = q.select(query_id, "qx", "qy", rows.alias("_r")).select(query_id, "qx", (F.col("qy") + F.col("_r.dy")).alias("iy"), F.col("_r.half").alias("half"))
    # Cells of a row are read in blocks as wide as the disc, so the join key spreads over both axes.
    width = 2 * reach + 1
    blocks = wanted.withColumn("_b", F.explode(F.sequence(F.floor((F.col("qx") - F.col("half")) / width), F.floor((F.col("qx") + F.col("half")) / width))))
    hit = blocks.join(cells.withColumn("_b", F.floor(F.col("ix") / width)), ["iy", "_b"]).where(F.abs(F.col("ix") - F.col("qx")) <= F.col("half"))
    sums = hit.groupBy(query_id).agg(F.sum("v").alias("disc_sum"))
    return queries.select(query_id).join(sums, query_id, "left").select(query_id, F.coalesce("disc_sum", F.lit(0.0)).alias("disc_sum"))


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str) -> DataFrame:
    """(point, polygon) pairs by ray casting.

    ``edges``: ``polygon_id``, ``x1``, ``y1``, ``x2``, ``y2`` of closed rings (holes as further rings: even-odd rule).  Edges
    are spread over unit bands of y, so a point meets only the edges of its own band.
    """
    band = F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))).alias("band")
    e = edges.select("polygon_id", "x1", "y1", "x2", "y2", band)
    p = points.select(point_id, "x", "y", F.floor("y").alias("band"))
    above = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    cut = F.col("x1") + (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1"))
    hits = p.join(e, "band").where(above & (F.col("x") < cut))
    return hits.groupBy(point_id, "polygon_id").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select(point_id, "polygon_id")


def snap(c: Column, cell: float) -> Column:
    """The centre of the grid cell of a coordinate."""
    return (F.floor(c / cell) + 0.5) * cell


def pixel_area_m2(lat_top: Column, lat_bottom: Column, width_deg: Column) -> Column:
    """Area of a pixel as a spherical zone on the authalic sphere."""
    return F.lit(AUTHALIC_M**2) * F.radians(width_deg) * F.abs(F.sin(F.radians(lat_top)) - F.sin(F.radians(lat_bottom)))


def class_area(pixels: DataFrame, codes: list[int], cell_deg: float) -> DataFrame:
    """Area (ha) and pixels per grid cell and class; ``pixels``: ``lat``, ``lon`` (top left), ``size_deg``, ``code``."""
    area = pixel_area_m2(F.col("lat"), F.col("lat") - F.col("size_deg"), F.col("size_deg")) / 10000
    kept = pixels.where(F.col("code").isin(codes))
    cell = F.concat_ws("_", F.floor(F.col("lat") / cell_deg).cast("string"), F.floor(F.col("lon") / cell_deg).cast("string"))
    return kept.groupBy(cell.alias("cell"), "code").agg(F.sum(area).alias("area_ha"), F.count("*").alias("pixels"))


def od_matrix(origins: DataFrame, destinations: DataFrame, o_id: str, d_id: str, fetch: Callable[[list[tuple], list[tuple]], list[list[float | None]]], table_size: int) -> DataFrame:
    """Distances from every origin to every destination by a table service, in requests of at most ``table_size`` points.

    Both sides are numbered and cut into blocks; a request is one (origin block, destination block) and requests
    run in parallel.  ``fetch`` takes (lat, lon) lists and gives rows of kilometres, None where there is no way.
    A full matrix is what is asked for, so every block meets every other; both tables are candidate lists.  Only the two row counts reach the driver.
    """
    half = max(1, table_size // 2)
    n_o, n_d = origins.count(), destinations.count()

    def blocks(df: DataFrame, key: str, tag: str, rows: int) -> DataFrame:
        ranked = spread_rank(df.select(F.col(key).alias("k"), "lat", "lon"), [], F.xxhash64("k"), buckets_for(rows))
        placed = ranked.select("k", "lat", "lon", F.floor(F.col("rank") / half).alias("b"))
        return placed.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("k", "lat", "lon"))).alias(tag)).select(F.col("b").alias(f"{tag}b"), tag)

    o, d = blocks(origins, o_id, "o", n_o), blocks(destinations, d_id, "d", n_d)
    # Ranks are without gaps, and so are the numbers of the blocks.
    d_blocks = -(-n_d // half)
    pairs = o.withColumn("db", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(d_blocks - 1).cast("long")) if d_blocks else F.array().cast("array<bigint>"))).join(d, "db")
    kinds = dict(origins.dtypes)[o_id], dict(destinations.dtypes)[d_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a, z in zip(b["o"], b["d"], strict=True):
                km = fetch([(x["lat"], x["lon"]) for x in a], [(x["lat"], x["lon"]) for x in z])
                yield pd.DataFrame([(x["k"], y["k"], km[i][j]) for i, x in enumerate(a) for j, y in enumerate(z)], columns=[o_id, d_id, "km"])

    return pairs.repartition(max(1, d_blocks), "ob", "db").select("o", "d").mapInPandas(run, f"{o_id} {kinds[0]}, {d_id} {kinds[1]}, km double")


def polyconic_xy(lat: Column, lon: Column, lon0: float) -> tuple[Column, Column]:
    """Plane coordinates, in Earth radii, in the spherical polyconic projection about a central meridian."""
    p, dl = F.radians(lat), F.radians(lon - lon0)
    e = dl * F.sin(p)
    cot = F.cos(p) / F.nullif(F.sin(p), F.lit(0.0))
    return F.coalesce(cot * F.sin(e), dl), F.coalesce(p + cot * (1 - F.cos(e)), p)


def polyconic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lon0: float) -> Column:
    """Plane distance in the spherical polyconic projection about a central meridian."""
    return plane_km(polyconic_xy(lat1, lon1, lon0), polyconic_xy(lat2, lon2, lon0))


def plane_km(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Distance of projected points."""
    return F.lit(EARTH_KM) * F.sqrt(_square(b[0] - a[0]) + _square(b[1] - a[1]))


def fallback_road_km(great_circle: Column, detour_factor: float) -> Column:
    """A road distance where no route is known: the great circle times a stated factor of at least 1 (ValueError otherwise)."""
    if not detour_factor >= 1:
        raise ValueError("the detour factor must be at least 1")
    return great_circle * F.lit(float(detour_factor))


def with_place(cells: DataFrame, key: str, via: DataFrame, own: str, name: str) -> DataFrame:
    """Adds the place of every cell as ``name``: its own field, else the place listed for the cell id in ``via`` (``key``, ``place``; of several the smallest)."""
    listed = via.groupBy(key).agg(F.min("place").alias("_via"))
    return cells.join(listed, key, "left").withColumn(name, F.coalesce(F.col(own), F.col("_via"))).drop("_via")
