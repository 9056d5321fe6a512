"""Implausible readings per source: robust seasonal-trend residuals, constant runs, range checks."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sucrogas.operators.snapshots import latest

# Bits of ``reasons``.
NEGATIVE, ABOVE_CAPACITY, CONSTANT_RUN, OUT_OF_SCALE, PERCENT_RANGE, PERCENT_MISMATCH = 1, 2, 4, 8, 16, 32


class Limits(NamedTuple):
    """What counts as implausible.

    ``spread_up`` and ``spread_down`` are the least standard deviations (log 10) of a source's normal behaviour upwards and
    downwards: use may well fall to a tenth for a month, but does not double.  ``factor_near`` is against the neighbouring readings, so
    that a shifted season is no spike.
    """

    alpha: float = 0.05
    spread_up: float = 0.09
    spread_down: float = 0.44
    factor_near: float = 1.8
    run_months: int = 4
    percent_points: float = 10.0
    season: int = 12


#: Readings beyond these factors of the source's level take no part in fitting season and trend.
FIT_UP, FIT_DOWN = 2.0, 30.0
#: Most cells (series x months) that are decomposed at once.
CELLS = 400_000


def student_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Quantile of Student's t by the expansion about the normal quantile (error below 1 % from df 5)."""
    z = NormalDist().inv_cdf(p)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return z + g1 / df + g2 / df**2 + g3 / df**3


def esd_limit(n: np.ndarray, i: np.ndarray, alpha: float) -> np.ndarray:
    """Critical value of the i-th step (from 1) of the generalised extreme studentised deviate test."""
    left = np.maximum(n - i + 1, 3.0)
    t = np.array([student_quantile(1 - alpha / (2 * m), np.array(max(m - 2, 1.0))) for m in np.unique(left)])[np.searchsorted(np.unique(left), left)]
    return (left - 1) * t / np.sqrt((left - 2 + t**2) * left)


def extreme(residual: np.ndarray, limits: Limits) -> np.ndarray:
    """Outliers of each row of residuals by the generalised extreme studentised deviate test.

    Deviations are taken from the median and studentised by a robust spread on their side (1.4826 x the median absolute deviation, at
    least ``spread_up`` / ``spread_down``).  The deviations are ordered; the i-th is compared with the i-th critical value, and all up to
    the last one beyond its critical value are outliers (at most half of the row).  NaN are no readings.
    """
    centre = _nanmedian(residual, 1)[:, None]
    off = residual - centre
    mad = 1.4826 * _nanmedian(np.abs(off), 1)[:, None]
    deviation = np.where(np.isnan(off), -np.inf, np.abs(off) / np.where(off > 0, np.maximum(mad, limits.spread_up), np.maximum(mad, limits.spread_down)))
    order = np.argsort(-deviation, axis=1, kind="stable")
    ranked = np.take_along_axis(deviation, order, 1)
    n = np.sum(~np.isnan(residual), axis=1)[:, None]
    i = np.broadcast_to(np.arange(1, residual.shape[1] + 1), residual.shape)
    beyond = (ranked > esd_limit(np.broadcast_to(n, i.shape).astype(float), i.astype(float), limits.alpha)) & (i <= np.maximum(n // 2, 1)) & (n >= 3)
    last = np.where(beyond.any(axis=1), residual.shape[1] - np.argmax(beyond[:, ::-1], axis=1), 0)[:, None]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, i, 1)
    return rank <= last


def _nanmedian(a: np.ndarray, axis: int) -> np.ndarray:
    """Median without NaN and without the warning for empty slices."""
    s = np.sort(a, axis=axis)
    n = np.sum(~np.isnan(a), axis=axis, keepdims=True)
    lo = np.take_along_axis(s, np.maximum((n - 1) // 2, 0), axis)
    hi = np.take_along_axis(s, np.minimum(n // 2, a.shape[axis] - 1), axis)
    return np.squeeze(np.where(n > 0, (lo + hi) / 2, np.nan), axis)


def _running(a: np.ndarray, half: int) -> np.ndarray:
    """Centred running median over 2 * half + 1 columns."""
    pad = np.pad(a, ((0, 0), (half, half)), constant_values=np.nan)
    return _nanmedian(sliding_window_view(pad, 2 * half + 1, axis=1), 2)


def decompose(y: np.ndarray, phase: np.ndarray, season: int) -> np.ndarray:
    """Expected values by robust seasonal-trend decomposition of many series at once.

    ``y`` is series x time with NaN for gaps, ``phase`` the season position per cell.  The season
    is the median per position and its two neighbours over all years of the series less its
    yearly running median; the trend is a running median of what is left.  Medians make single
    outliers and runs shorter than half a window harmless.
    """
    level = _running(y, season // 2)
    off = y - level
    seasonal = np.full((y.shape[0], season), np.nan)
    for p in range(season):
        near = (phase == p) | (phase == (p + 1) % season) | (phase == (p - 1) % season)
        own = phase == p
        pooled = _nanmedian(np.where(near, off, np.nan), 1)
        exact = _nanmedian(np.where(own, off, np.nan), 1)
        enough = np.sum(own & ~np.isnan(off), axis=1) >= 3
        seasonal[:, p] = np.where(enough, exact, pooled)
    s = np.take_along_axis(np.nan_to_num(seasonal), phase, 1)
    trend = _running(y - s, 4)
    trend = np.where(np.isnan(trend), level, trend)
    return s + trend


def _neighbour_peak(y: np.ndarray, usable: np.ndarray, reach: int) -> np.ndarray:
    """The largest of the nearest ``reach`` usable values on either side of each cell; NaN where there are none."""
    peak = np.full(y.shape, -np.inf)
    for step in (1, -1):
        held = np.full((y.shape[0], reach), -np.inf)
        columns = range(y.shape[1]) if step == 1 else range(y.shape[1] - 1, -1, -1)
        for t in columns:
            peak[:, t] = np.maximum(peak[:, t], held.max(axis=1))
            use = usable[:, t]
            held[use] = np.concatenate([held[use, 1:], y[use, t : t + 1]], axis=1)
    return np.where(np.isinf(peak), np.nan, peak)


def constant_runs(volume: np.ndarray, months: int) -> np.ndarray:
    """Cells of runs of equal non-zero values over at least ``months`` consecutive columns."""
    equal = (volume[:, 1:] == volume[:, :-1]) & (volume[:, 1:] != 0)
    run = np.zeros(volume.shape, dtype=np.int32)
    for t in range(1, volume.shape[1]):
        run[:, t] = np.where(equal[:, t - 1], run[:, t - 1] + 1, 0)
    for t in range(volume.shape[1] - 2, -1, -1):
        run[:, t] = np.where(equal[:, t], np.maximum(run[:, t], run[:, t + 1]), run[:, t])
    return run >= months - 1


def find_implausible(time: np.ndarray, volume: np.ndarray, percent: np.ndarray, capacity: np.ndarray, scale: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Reason bits and log-10 residuals for series x month matrices (NaN: not stated or no reading).

    ``capacity`` is what the row states, ``scale`` what the series is levelled by.
    """
    with np.errstate(invalid="ignore", divide="ignore"):
        own = 100 * volume / np.where(capacity > 0, capacity, np.nan)
        reasons = np.where(volume < 0, NEGATIVE, 0) | np.where(volume > capacity, ABOVE_CAPACITY, 0) | np.where((percent < 0) | (percent > 100), PERCENT_RANGE, 0)
        reasons |= np.where(np.abs(percent - own) > limits.percent_points, PERCENT_MISMATCH, 0)
        constant = constant_runs(volume, limits.run_months)
        reasons |= np.where(constant, CONSTANT_RUN, 0)

        # Use moves with the capacity, so changes of capacity leave the series level.
        middle = _nanmedian(scale, 1)[:, None]
        scale = np.where(np.isnan(scale), middle, scale)
        scale = np.where(np.isnan(scale) | (scale <= 0), 1.0, scale)
        y = np.log10(np.where(volume > 0, volume, np.nan) / scale)
        fit = np.where((y > 0) & ~np.isnan(middle), np.nan, y)
        low, high, near = np.log10(FIT_DOWN), np.log10(FIT_UP), np.log10(limits.factor_near)
        # Runs in another unit may hold most of a short series: the level is taken from its upper half
        # where the series falls apart into two.
        typical = _nanmedian(fit, 1)
        peak = np.where(np.isnan(fit), -np.inf, fit).max(axis=1, initial=-np.inf)
        upper = _nanmedian(np.where(fit > peak[:, None] - low, fit, np.nan), 1)
        typical = np.where(peak - typical > low, upper, typical)[:, None]
        fit = np.where(np.abs(fit - typical) < low, fit, np.nan)
        for _ in range(2):
            expected = decompose(fit, time % limits.season, limits.season)
            expected = np.where(np.isnan(expected), typical, expected)
            residual = y - expected
            fit = np.where((residual < high) & (residual > -low), y, np.nan)
        beyond = extreme(residual, limits)
        down = beyond & (residual < 0)
        usable = ~np.isnan(y) & ~constant & ~down & (y <= 0)
        neighbours = _neighbour_peak(y, usable, 2)
        up = beyond & (residual > 0) & ~(y - neighbours <= near)
        reasons |= np.where(up | down, OUT_OF_SCALE, 0)
    return reasons.astype(np.int32), residual


def implausible_readings(
    df: DataFrame, source: str, date: str, version: str, volume: str, percent: str, capacity: str, second_capacity: str, limits: Limits = Limits()
) -> DataFrame:
    """Source-months whose valid reading cannot be right, with the reasons.

    Of the rows of one source and date the latest ``version`` is valid.  A reading is flagged if it
    is negative or above the capacity, part of a run of equal non-zero values in at least
    ``run_months`` consecutive months, out of scale with the source's own seasonal-trend
    expectation (an outlier of the generalised ESD test of its residuals, and if upwards also off its neighbours), or if the
    percentage is outside 0..100 or off the row's own volume and capacity.  Zeros are never out of
    scale.  A NULL capacity is estimated from the second capacity for scaling only; a NULL volume
    or percentage fails no check.  NULL sources or dates are ignored; an empty table gives none.

    A source is read as one array of months (its length is the calendar's, not the data's); series of similar length
    are decomposed together as a matrix of bounded size, in which long gaps are closed.  Returns source, date, ``reasons`` (bits), ``residual`` (log 10).
    """
    valid = latest(df.select(source, date, version, volume, percent, capacity, second_capacity), [source, date], version, [volume, percent, capacity, second_capacity])
    month = (F.year(date) * 12 + F.month(date) - 1).alias("t")
    one = F.struct(month, *[F.col(c).cast("double").alias(n) for c, n in ((volume, "v"), (percent, "p"), (capacity, "c"), (second_capacity, "d"))])
    series = valid.groupBy(source).agg(F.collect_list(one).alias("_s"))
    flat = series.select(F.col(source).alias("source"), *[F.col("_s")[n].alias(n) for n in "tvpcd"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from _flag(b, limits)

    found = flat.mapInPandas(run, "source string, t int, reasons int, residual double")
    return found.select(F.col("source").alias(source), F.make_date(F.floor(F.col("t") / 12).cast("int"), F.col("t") % 12 + 1, F.lit(1)).alias(date), "reasons", "residual")


def closed_up(t: np.ndarray, season: int) -> np.ndarray:
    """Columns for sorted times: from the season's phase of the first on, gaps of more than two seasons shortened by whole ones.

    Running windows are shorter than a season, so readings on both sides of such a gap never meet and a wrong year costs no memory.
    """
    if not len(t):
        return t
    gap = np.diff(t)
    gap = np.where(gap > 2 * season, season + gap % season, gap)
    return np.concatenate([[t[0] % season], t[0] % season + np.cumsum(gap)]).astype(np.int64)


def _flag(b: pd.DataFrame, limits: Limits) -> Iterator[pd.DataFrame]:
    """Flags of a batch of series, in groups of similar length of at most ``CELLS`` cells (one series at least)."""
    series = []
    for n, t in enumerate(b.t):
        t = np.asarray(t, dtype=np.int64)
        order = np.argsort(t)
        series.append((n, order, t[order], closed_up(t[order], limits.season)))
    series.sort(key=lambda x: x[3][-1])
    first = 0
    while first < len(series):
        last = first + 1
        while last < len(series) and (last + 1 - first) * (series[last][3][-1] + 1) <= CELLS:
            last += 1
        yield _flag_group(b, series[first:last], limits)
        first = last


def _flag_group(b: pd.DataFrame, series: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], limits: Limits) -> pd.DataFrame:
    width = int(series[-1][3][-1]) + 1
    row = np.repeat(np.arange(len(series)), [len(s[3]) for s in series])
    column = np.concatenate([s[3] for s in series])
    when = np.zeros((len(series), width), dtype=np.int32)
    when[row, column] = np.concatenate([s[2] for s in series])

    def grid(name: str) -> np.ndarray:
        g = np.full((len(series), width), np.nan)
        g[row, column] = np.concatenate([np.asarray(b[name].iloc[n], dtype=float)[order] for n, order, _, _ in series])
        return g

    volume, percent, capacity, second = (grid(n) for n in "vpcd")
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = _nanmedian(capacity / np.where(second > 0, second, np.nan), 1)[:, None]
    scale = np.where(np.isnan(capacity), second * ratio, capacity)
    time = np.broadcast_to(np.arange(width), volume.shape)
    reasons, residual = find_implausible(time, volume, percent, capacity, scale, limits)
    r, c = np.nonzero(reasons)
    names = b.source.to_numpy()[[s[0] for s in series]]
    return pd.DataFrame({"source": names[r], "t": when[r, c], "reasons": reasons[r, c], "residual": residual[r, c]})
