"""Residues to cost over mills and crop years, on the driver's star schema.

Binding: a mill is a supplier, its cane of a crop year the ordered quantity shipped in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.operators import economics, process, supply
from sucrogas.session import small_table, table

COEFFICIENTS = {"ethanol_l_per_t": 81.0, "vinasse_l_per_l": 12.0, "cake_kg_per_t": 37.0, "straw_kg_per_t": 140.0, "straw_recoverable": 0.5, "straw_ts": 0.85}
TO_AD = {"vinasse": 1.0, "cake": 1.0, "straw": 0.2}
SUBSTRATES = [
    # substrate, basis, density, ts, vs, cod, removal, ch4_yield, bmp, rate_k, so4, k
    ("vinasse", "cod", 1.0, 0.016, 0.5625, 30.0, 0.7, 0.3, None, None, 2.0, 2.5),
    ("filter_cake", "vs", 1.0, 0.28, 0.74, None, None, None, 220.0, None, None, None),
    ("straw", "vs", 0.2, 0.85, 0.9, None, None, None, 230.0, 0.05, None, None),
]
SUBSTRATE_SCHEMA = "substrate string, basis string, density double, ts double, vs double, cod double, removal double, ch4_yield double, bmp double, rate_k double, so4 double, k double"
OLR_MAX, HRT_MIN, TS_MAX, COD_SO4_MIN, K_MAX, FULLSCALE, RECOVERY, X_CH4 = 3.0, 30.0, 0.12, 10.0, 3.0, 0.85, 0.99, 0.6
KEYS = ["mill_id", "crop_year"]


def mill_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cane of every mill and crop year."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    return li.groupBy(F.col("l_suppkey").alias("mill_id"), supply.crop_year(F.col("l_shipdate")).alias("crop_year")).agg(F.sum("l_quantity").alias("cane_t"))


def mill_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mill_years(spark, sf_dir)


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.monthly_residues(mill_years(spark, sf_dir), COEFFICIENTS, TO_AD)


def monthly_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residues(spark, sf_dir)
    return r.select(*KEYS, F.date_format("month", "yyyy-MM").alias("month"), *[F.round(c, 6).alias(c) for c in ("cane_t", "ethanol_m3", "vinasse_m3", "vinasse_to_ad_m3", "cake_t", "cake_to_ad_t", "straw_dm_t", "straw_to_ad_t")])


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.to_feed(residues(spark, sf_dir), KEYS, 1.0)


def feed_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(spark, sf_dir).select(*KEYS, F.date_format("month", "yyyy-MM").alias("month"), "substrate", F.round("fresh_t", 6).alias("fresh_t"))


def substrates(spark: SparkSession) -> DataFrame:
    return small_table(spark, SUBSTRATES, SUBSTRATE_SCHEMA)


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process.monthly_loads(feed(spark, sf_dir), substrates(spark), KEYS)


def plant_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads(spark, sf_dir).select(
        *KEYS, F.date_format("month", "yyyy-MM").alias("month"), "days", *[F.round(c, 6).alias(c) for c in ("fresh_t", "flow_m3_d", "vs_load_kg_d", "feed_ts", "feed_cod_so4", "feed_k")]
    )


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process.with_digester(loads(spark, sf_dir), KEYS, OLR_MAX, HRT_MIN)


def digester_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized(spark, sf_dir).groupBy(*KEYS).agg(F.round(F.max("digester_m3"), 6).alias("digester_m3"))


def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = process.with_gas(sized(spark, sf_dir), x_ch4=X_CH4, bmp_fullscale=FULLSCALE).withColumn("nameplate", F.col("digester_m3") * 0.8)
    return process.mass_balance(months, nameplate="nameplate", recovery=RECOVERY)


BALANCE_COLUMNS = ("olr", "hrt_d", "ch4_nm3", "biogas_nm3", "potential_nm3", "biomethane_nm3", "curtailed_nm3", "biomethane_nm3_d", "capacity_factor")


def mass_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(spark, sf_dir).select(*KEYS, F.date_format("month", "yyyy-MM").alias("month"), *[F.round(c, 5).alias(c) for c in BALANCE_COLUMNS])


def feasibility_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = process.feasibility(balance(spark, sf_dir), olr_max=OLR_MAX, hrt_min=HRT_MIN, ts_max=TS_MAX, cod_so4_min=COD_SO4_MIN, k_max=K_MAX)
    return b.select(*KEYS, F.date_format("month", "yyyy-MM").alias("month"), "olr_ok", "hrt_ok", "ts_ok", "cod_so4_ok", "k_ok", "tan_ok", "feasible")


def s1_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = supply.storage(residues(spark, sf_dir), KEYS, 0.4, [8, 9, 10, 11], {12: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}, 0.03)
    return s.select(*KEYS, F.date_format("month", "yyyy-MM").alias("month"), *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("fed_t", "stored_t", "released_t", "lost_t", "stock_t")])


def storage_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = supply.storage(residues(spark, sf_dir), KEYS, 0.4, [8, 9, 10, 11], {12: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}, 0.03)
    return s.groupBy(*KEYS).agg(*[F.round(F.sum(c), 5).alias(c) for c in ("stored_t", "released_t", "lost_t")], F.round(F.max_by("stock_t", "month"), 5).alias("end_stock_t"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance(spark, sf_dir).groupBy(*KEYS).agg(F.sum("biomethane_nm3").alias("annual_nm3"), F.max("biomethane_nm3_d").alias("peak_nm3_d"))


def annuity_by_mill(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annual(spark, sf_dir)
    investment = economics.power_law(F.col("peak_nm3_d"), F.lit(3735.0), F.lit(50000.0), F.lit(0.65))
    unit = economics.annuity_cost(investment, F.col("annual_nm3"), F.lit(0.1), F.lit(20), F.lit(0.0), F.lit(0.15))
    return a.select(*KEYS, F.round(investment, 3).alias("investment"), F.round(unit, 6).alias("unit_cost"), F.round(economics.crf(F.lit(0.1), F.lit(20)), 9).alias("crf"), F.round(economics.crf(F.lit(0.0), F.lit(20)), 9).alias("crf_zero"))


_CANE = """cane AS (
  SELECT l_suppkey AS mill_id, year(l_shipdate) - CASE WHEN month(l_shipdate) < 4 THEN 1 ELSE 0 END AS crop_year, sum(l_quantity) AS cane_t
  FROM lineitem GROUP BY 1, 2)"""
_RES = (
    _CANE
    + """, mon AS (SELECT unnest(range(0, 12)) AS pos), res0 AS (
  SELECT mill_id, crop_year, pos, make_date(crop_year + CASE WHEN pos >= 9 THEN 1 ELSE 0 END, (pos + 3) % 12 + 1, 1) AS month,
         CASE WHEN pos < 8 THEN 0.125e0 ELSE 0e0 END AS s, cane.cane_t AS cane FROM cane, mon),
res AS (SELECT mill_id, crop_year, pos, month, cane * s AS cane_t, cane * 81e0 * s / 1000 AS ethanol_m3, cane * 81e0 * s / 1000 * 12e0 AS vinasse_m3,
  cane * 81e0 * s / 1000 * 12e0 AS vinasse_to_ad_m3, cane * s * 37e0 / 1000 AS cake_t, cane * s * 37e0 / 1000 AS cake_to_ad_t,
  cane * s * 140e0 * 0.5e0 / 1000 AS straw_dm_t, cane * s * 140e0 * 0.5e0 / 1000 * 0.2e0 / 0.85e0 AS straw_to_ad_t FROM res0)"""
)
_SUB = "sub(substrate, basis, density, ts, vs, cod, removal, ch4_yield, bmp, rate_k, so4, k) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL::DOUBLE" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in SUBSTRATES
) + ")"
_FEED = _RES + f""", {_SUB}, feed AS (
  SELECT mill_id, crop_year, month, 'vinasse' AS substrate, vinasse_to_ad_m3 * 1e0 AS fresh_t FROM res
  UNION ALL SELECT mill_id, crop_year, month, 'filter_cake', cake_to_ad_t FROM res
  UNION ALL SELECT mill_id, crop_year, month, 'straw', straw_to_ad_t FROM res)"""
_LOADS = _FEED + """, agg AS (
  SELECT mill_id, crop_year, month, day(last_day(month)) AS days, sum(fresh_t) AS fresh_t, sum(fresh_t / density) AS v, sum(fresh_t * ts * vs) AS vs, sum(fresh_t * ts) AS tst,
    bool_and(CASE WHEN fresh_t > 0 THEN cod IS NOT NULL AND so4 IS NOT NULL ELSE true END) AS cs_known, bool_and(CASE WHEN fresh_t > 0 THEN k IS NOT NULL ELSE true END) AS k_known,
    sum(fresh_t / density * coalesce(cod, 0)) AS cod, sum(fresh_t / density * coalesce(so4, 0)) AS so4, sum(fresh_t / density * coalesce(k, 0)) AS kk
  FROM feed JOIN sub USING (substrate) GROUP BY 1, 2, 3),
loads AS (SELECT mill_id, crop_year, month, days, fresh_t, v / days AS flow_m3_d, vs * 1000 / days AS vs_load_kg_d, coalesce(tst / nullif(fresh_t, 0), 0) AS feed_ts,
  CASE WHEN cs_known AND so4 > 0 THEN cod / so4 END AS feed_cod_so4, CASE WHEN k_known AND v > 0 THEN kk / v END AS feed_k FROM agg)"""
_VOL = _LOADS + """, vol AS (SELECT mill_id, crop_year, max(greatest(vs_load_kg_d / 3e0, flow_m3_d * 30e0)) AS digester_m3 FROM loads GROUP BY 1, 2)"""
_BAL = _VOL + """, base AS (
  SELECT loads.*, digester_m3, digester_m3 * 0.8e0 AS cap, digester_m3 / nullif(flow_m3_d, 0) AS hrt_d, vs_load_kg_d / nullif(digester_m3, 0) AS olr FROM loads JOIN vol USING (mill_id, crop_year)),
gas AS (SELECT f.mill_id, f.crop_year, f.month, sum(CASE WHEN f.fresh_t <= 0 THEN 0 WHEN basis = 'cod' THEN f.fresh_t / density * s.cod * removal * ch4_yield
    ELSE f.fresh_t * ts * vs * bmp * 0.85e0 * CASE WHEN rate_k IS NULL OR hrt_d IS NULL THEN 1 ELSE 1 - exp(-rate_k * hrt_d) END END) AS ch4
  FROM feed f JOIN base b USING (mill_id, crop_year, month) JOIN sub s USING (substrate) GROUP BY 1, 2, 3),
bal AS (SELECT base.*, ch4 AS ch4_nm3, ch4 / 0.6e0 AS biogas_nm3, ch4 * 0.99e0 AS potential_nm3, least(ch4 * 0.99e0, cap * days) AS biomethane_nm3 FROM base JOIN gas USING (mill_id, crop_year, month))"""
_M = "strftime(month, '%Y-%m') AS month"
_STORE = _RES + """, st AS (
  WITH RECURSIVE r AS (
    SELECT mill_id, crop_year, 0 AS pos, cake_to_ad_t AS fed_t, 0e0 AS stored_t, 0e0 AS released_t, 0e0 AS lost_t, 0e0 AS stock_t FROM res WHERE pos = 0
    UNION ALL
    SELECT n.mill_id, n.crop_year, n.pos, n.cake_to_ad_t - n.into_t + n.rel, n.into_t, n.rel, n.lost, n.st - n.rel FROM (
      SELECT m.*, (r.stock_t - r.stock_t * 0.03e0 + m.into0) AS st, r.stock_t * 0.03e0 AS lost, m.into0 AS into_t,
        (r.stock_t - r.stock_t * 0.03e0 + m.into0) * m.draw AS rel
      FROM r JOIN (SELECT *, CASE WHEN month(month) IN (8, 9, 10, 11) THEN cake_to_ad_t * 0.4e0 ELSE 0e0 END AS into0,
          CASE month(month) WHEN 12 THEN 0.25e0 WHEN 1 THEN 1 / 3e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 1e0 ELSE 0e0 END AS draw FROM res) m
        ON m.mill_id = r.mill_id AND m.crop_year = r.crop_year AND m.pos = r.pos + 1) n)
  SELECT r.*, res.month FROM r JOIN res USING (mill_id, crop_year, pos))"""
_R = lambda cols, n=6: ", ".join(f"round({c}, {n}) AS {c}" for c in cols)

QUERIES = {
    "mill_year_panel": mill_year_panel, "monthly_residues": monthly_residues, "feed_long": feed_long, "plant_loads": plant_loads, "digester_volume": digester_volume,
    "mass_balance": mass_balance, "feasibility_flags": feasibility_flags, "s1_storage": s1_storage, "storage_balance": storage_balance, "annuity_by_mill": annuity_by_mill,
}
SQL = {
    "mill_year_panel": f"WITH {_CANE} SELECT * FROM cane",
    "monthly_residues": f"WITH {_RES} SELECT mill_id, crop_year, {_M}, {_R(['cane_t', 'ethanol_m3', 'vinasse_m3', 'vinasse_to_ad_m3', 'cake_t', 'cake_to_ad_t', 'straw_dm_t', 'straw_to_ad_t'])} FROM res",
    "feed_long": f"WITH {_FEED} SELECT mill_id, crop_year, {_M}, substrate, round(fresh_t, 6) AS fresh_t FROM feed",
    "plant_loads": f"WITH {_LOADS} SELECT mill_id, crop_year, {_M}, days, {_R(['fresh_t', 'flow_m3_d', 'vs_load_kg_d', 'feed_ts', 'feed_cod_so4', 'feed_k'])} FROM loads",
    "digester_volume": f"WITH {_VOL} SELECT mill_id, crop_year, round(digester_m3, 6) AS digester_m3 FROM vol",
    "mass_balance": f"""WITH {_BAL} SELECT mill_id, crop_year, {_M}, {_R(['olr', 'hrt_d', 'ch4_nm3', 'biogas_nm3', 'potential_nm3', 'biomethane_nm3'], 5)},
        round(potential_nm3 - biomethane_nm3, 5) AS curtailed_nm3, round(biomethane_nm3 / days, 5) AS biomethane_nm3_d, round(biomethane_nm3 / nullif(cap * days, 0), 5) AS capacity_factor FROM bal""",
    "feasibility_flags": f"""WITH {_BAL}, f AS (SELECT *, olr <= 3e0 * (1 + 1e-9) AS olr_ok, coalesce(hrt_d >= 30e0 * (1 - 1e-9), true) AS hrt_ok, feed_ts <= 0.12e0 AS ts_ok,
        feed_cod_so4 >= 10 AS cod_so4_ok, feed_k <= 3 AS k_ok, NULL::BOOLEAN AS tan_ok FROM bal)
        SELECT mill_id, crop_year, {_M}, olr_ok, hrt_ok, ts_ok, cod_so4_ok, k_ok, tan_ok,
        coalesce(olr_ok, true) AND hrt_ok AND coalesce(ts_ok, true) AND coalesce(cod_so4_ok, true) AND coalesce(k_ok, true) AS feasible FROM f""",
    "s1_storage": f"WITH {_STORE} SELECT mill_id, crop_year, {_M}, {', '.join(f'round({c} + 1e-10, 6) AS {c}' for c in ('fed_t', 'stored_t', 'released_t', 'lost_t', 'stock_t'))} FROM st",
    "storage_balance": f"""WITH {_STORE} SELECT mill_id, crop_year, round(sum(stored_t), 5) AS stored_t, round(sum(released_t), 5) AS released_t, round(sum(lost_t), 5) AS lost_t,
        round(arg_max(stock_t, month), 5) AS end_stock_t FROM st GROUP BY 1, 2""",
    "annuity_by_mill": f"""WITH {_BAL}, a AS (SELECT mill_id, crop_year, sum(biomethane_nm3) AS annual, max(biomethane_nm3 / days) AS peak FROM bal GROUP BY 1, 2),
        c AS (SELECT *, 0.1e0 * pow(1.1e0, 20) / (pow(1.1e0, 20) - 1) AS crf, 3735e0 * 50000e0 * pow(peak / 50000e0, 0.65e0) AS inv FROM a)
        SELECT mill_id, crop_year, round(inv, 3) AS investment, CASE WHEN annual > 0 THEN round(inv * crf / annual + 0.15e0, 6) END AS unit_cost, round(crf, 9) AS crf, 0.05e0 AS crf_zero FROM c""",
}
