from datetime import date, datetime

import numpy as np

from sucrogas.operators import anomalies as A


def months(n, start=2020):
    return [date(start + i // 12, i % 12 + 1, 1) for i in range(n)]


def test_decomposition_follows_season_and_ignores_spikes():
    t = np.arange(72)
    y = np.log10(np.where((t % 12 < 3) | (t % 12 == 11), 0.1, 0.4))[None, :]
    spiked = y.copy()
    spiked[0, 30] += 1
    expected = A.decompose(spiked, (t % 12)[None, :], 12)
    assert np.nanmax(np.abs(expected - y)) < 0.05


def test_esd_limit_is_that_of_the_tables():
    assert abs(float(A.esd_limit(np.array([54.0]), np.array([1.0]), 0.05)[0]) - 3.159) < 0.01  # published value for n = 54


def test_reasons(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i, d in enumerate(months(60)):
        v = round(1000 * (0.25 if d.month in (12, 1, 2, 3) else 1.0) * float(rng.uniform(0.93, 1.07)), 1)
        rows.append(["p", d, datetime(2025, 1, 1), v, round(100 * v / 4000), 4000.0, 2000.0])
    rows[20][3:5] = [rows[20][3] * 3, round(100 * rows[20][3] * 3 / 4000)]
    rows[21][3:5] = [1.1, 0]
    rows[30][3] = -5.0
    rows[31][3:5] = [4100.0, 102]
    for i in range(40, 44):
        rows[i][3:5] = [900.0, 22]
    rows[50][4] = 70
    rows[51][3:5] = [0.0, 0]
    rows[52][3] = None
    rows[53][4] = None
    rows[54][5] = None
    stale = [["p", rows[5][1], datetime(2024, 1, 1), -1.0, 0, 4000.0, 2000.0], rows[6], [None, rows[7][1], datetime(2025, 1, 1), -1.0, 0, 1.0, 1.0]]
    df = spark.createDataFrame([(*r, "clash") for r in rows + stale], "plant string, date date, loaded timestamp, v double, p int, c double, c2 double, reasons string")
    got = {(r.date, r.reasons) for r in A.implausible_readings(df, "plant", "date", "loaded", "v", "p", "c", "c2").collect()}
    by = {d: n for d, n in got}
    m = [r[1] for r in rows]
    assert set(by) == {m[20], m[21], m[30], m[31], *m[40:44], m[50]}
    assert by[m[20]] & A.OUT_OF_SCALE and by[m[21]] & A.OUT_OF_SCALE and by[m[30]] & A.NEGATIVE and by[m[31]] & A.ABOVE_CAPACITY and by[m[41]] & A.CONSTANT_RUN and by[m[50]] == A.PERCENT_MISMATCH
    assert A.implausible_readings(df.limit(0), "plant", "date", "loaded", "v", "p", "c", "c2").collect() == []


def test_short_and_empty_series(spark):
    rows = [("a", date(2024, 1, 1), datetime(2024, 2, 1), 5.0, 1, None, None), ("b", date(2024, 1, 1), datetime(2024, 2, 1), None, None, None, None)]
    df = spark.createDataFrame(rows, "plant string, date date, loaded timestamp, v double, p int, c double, c2 double")
    assert A.implausible_readings(df, "plant", "date", "loaded", "v", "p", "c", "c2").collect() == []


def test_gap_breaks_a_run():
    v = np.array([[5.0, 5, 5, np.nan, 5, 5, 5], [5, 5, 5, 5, 1, 2, 3]])
    assert A.constant_runs(v, 4).tolist() == [[False] * 7, [True] * 4 + [False] * 3]


def one_by_one(x, limits):
    """The test as it is published, on one row: take out the most extreme, remember the last step beyond its limit."""
    centre = np.median(x)
    mad = 1.4826 * np.median(np.abs(x - centre))
    left, out, last = list(range(len(x))), [], 0
    for i in range(1, len(x) // 2 + 1):
        r = [abs(x[j] - centre) / max(mad, limits.spread_up if x[j] > centre else limits.spread_down) for j in left]
        worst = int(np.argmax(r))
        if r[worst] > A.esd_limit(np.array([float(len(x))]), np.array([float(i)]), limits.alpha)[0]:
            last = i
        out.append(left.pop(worst))
    return set(out[:last])


def test_extreme_is_the_generalised_test():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x = rng.normal(0, 0.1, 40)
        x[rng.choice(40, 6, replace=False)] += rng.choice([0.4, 0.9, -2.0], 6)
        limits = A.Limits(spread_up=0.05, spread_down=0.2)
        assert set(np.flatnonzero(A.extreme(x[None, :], limits)[0])) == one_by_one(x, limits)
    assert not A.extreme(np.full((2, 5), np.nan), A.Limits()).any() and not A.extreme(np.zeros((1, 1)), A.Limits()).any()


def test_the_extreme_deviates_decide(spark):
    """Without the test, or with another level of it, other months come out."""
    rng = np.random.default_rng(3)
    rows = [(f"p{k}", d, datetime(2026, 1, 1), 1000 * float(rng.lognormal(0, 0.25)) * (3.5 if rng.random() < 0.03 else 1), None, 9000.0, 4000.0) for k in range(30) for d in months(60)]
    df = spark.createDataFrame(rows, "plant string, date date, loaded timestamp, v double, p int, c double, c2 double")
    found = lambda limits: {(r.plant, r.date) for r in A.implausible_readings(df, "plant", "date", "loaded", "v", "p", "c", "c2", limits).collect()}
    normal, strict, loose = found(A.Limits()), found(A.Limits(alpha=1e-9)), found(A.Limits(spread_up=0.0, spread_down=0.0))
    assert strict < normal and normal < loose | normal and normal != loose


def test_a_wrong_year_costs_nothing(spark):
    rows = [("p", d, datetime(2026, 1, 1), 100.0 + i % 7, 1, 9000.0, 4000.0) for i, d in enumerate(months(48))]
    rows += [("p", date(1, 1, 1), datetime(2026, 1, 1), 100.0, 1, 9000.0, 4000.0), ("p", date(9999, 12, 1), datetime(2026, 1, 1), -4.0, 1, 9000.0, 4000.0)]
    df = spark.createDataFrame(rows, "plant string, date date, loaded timestamp, v double, p int, c double, c2 double")
    got = [(str(r.date), r.reasons & A.NEGATIVE) for r in A.implausible_readings(df, "plant", "date", "loaded", "v", "p", "c", "c2").collect()]
    assert got == [("9999-12-01", A.NEGATIVE)]
    t = np.array([2, 3, 40, 119988])
    c = A.closed_up(t, 12)
    assert c[-1] < 80 and ((c - t) % 12 == 0).all() and (np.diff(c) > 0).all()
