"""Calibration, event, concentration and registry queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sucrogas.operators import calibrate, supply
from sucrogas.operators.snapshots import latest
from sucrogas.session import table

MONTHLY = "anp_monthly_sp_plants_from_pilar2b"
_LATEST = f"""l AS (SELECT plant_id, date, operator, municipality, cap_biometano_m3d AS capm, cap_biogas_m3d AS capg, vol_biogas_m3d AS vol, util_pct AS util FROM {MONTHLY}
  WHERE plant_id IS NOT NULL AND date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY plant_id, date ORDER BY loaded_at DESC NULLS LAST, cap_biometano_m3d DESC NULLS LAST, cap_biogas_m3d DESC NULLS LAST, vol_biogas_m3d DESC NULLS LAST, util_pct DESC NULLS LAST, operator DESC NULLS LAST, municipality DESC NULLS LAST) = 1)"""


def plant_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid row of every plant and month."""

    m = table(spark, sf_dir, MONTHLY)
    cols = ["cap_biometano_m3d", "cap_biogas_m3d", "vol_biogas_m3d", "util_pct", "operator", "municipality"]
    v = latest(m, ["plant_id", "date"], "loaded_at", cols)
    return v.select("plant_id", "date", "operator", "municipality", F.col("cap_biometano_m3d").alias("capm"), F.col("cap_biogas_m3d").alias("capg"), F.col("vol_biogas_m3d").alias("vol"), F.col("util_pct").alias("util"))


def valid_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plant_months(spark, sf_dir).select("plant_id", "date", "capg", "vol", "util")


def thousand_scale_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.thousand_scale(plant_months(spark, sf_dir), "vol", "capg").select("plant_id", "date", "vol", "capg")


def state_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied biomethane per month, as published and with thousand-scale months of one municipality rescaled."""
    p = plant_months(spark, sf_dir)
    implied = F.col("vol") * F.try_divide(F.col("capm"), F.col("capg")) * F.dayofmonth(F.last_day("date"))
    small = (F.col("vol") > 0) & (F.col("vol") < 0.01 * F.col("capg")) & (F.col("municipality") == "SAPEBUCU DO BREJO")
    g = p.groupBy("date").agg(F.coalesce(F.sum(implied), F.lit(0.0)).alias("published"), F.coalesce(F.sum(F.when(small, implied * 1000).otherwise(implied)), F.lit(0.0)).alias("rescaled"), F.coalesce(F.sum(F.col("capm") * F.dayofmonth(F.last_day("date"))), F.lit(0.0)).alias("reported"))
    return g.select("date", F.round("published", 2).alias("published"), F.round("rescaled", 2).alias("rescaled"), F.round(F.try_divide(F.col("published"), F.col("reported")), 6).alias("ratio_published"), F.round(F.try_divide(F.col("rescaled"), F.col("reported")), 6).alias("ratio_rescaled"))


def ratio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = calibrate.ratio_summary(plant_months(spark, sf_dir).select(F.try_divide(F.col("vol"), F.col("capg")).alias("use_ratio"), F.try_divide(F.col("capm"), F.col("capg")).alias("yield_ratio")), ["use_ratio", "yield_ratio"])
    return r.select("ratio", "n", *[F.round(c, 6).alias(c) for c in ("median", "p10", "p90", "mean_abs_log")])


def observed_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the capacity as a simple simulation against the observed volumes."""
    p = plant_months(spark, sf_dir)
    sim = p.select("plant_id", F.col("date").alias("month"), (F.col("capg") * 0.5).alias("sim"))
    obs = p.where("vol IS NOT NULL").select("plant_id", F.col("date").alias("month"), F.col("vol").alias("obs"), F.col("util").cast("double").alias("util"))
    c = calibrate.compare_with_observed(sim, obs, ["plant_id"], 1.0)
    return c.select("plant_id", "months", "compared", *[F.round(x, 4).alias(x) for x in ("mae", "bias", "volume_ratio")])


def plant_period_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop years as reported periods; the reported value is a fixed share of the capacity."""
    p = plant_months(spark, sf_dir)
    monthly = p.where("vol IS NOT NULL").select("plant_id", F.col("date").alias("month"), F.col("vol").alias("value"))
    y = supply.crop_year(F.col("date"))
    periods = p.groupBy("plant_id", y.alias("period")).agg(F.round(F.sum("capg") * 0.4, 3).alias("reported")).select("plant_id", "period", "reported", F.make_date("period", F.lit(4), F.lit(1)).alias("start"), F.make_date(F.col("period") + 1, F.lit(3), F.lit(1)).alias("end"))
    c = calibrate.period_check(monthly, periods, "plant_id")
    return c.select("plant_id", "period", "reported", F.round("total", 4).alias("total"), "n_months", "complete", F.round("ratio", 6).alias("ratio"))


def operator_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plant_months(spark, sf_dir)
    return p.groupBy("operator", "municipality").agg(F.count("*").alias("n"), F.min("date").alias("first_month"), F.max("date").alias("last_month"))


def nameplate_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capacity in the last month of crop year 2024, else the last of all."""
    p = plant_months(spark, sf_dir).where("capm IS NOT NULL")
    return p.groupBy("plant_id").agg(F.max_by("capm", F.struct((supply.crop_year(F.col("date")) == 2024).alias("a"), "date")).alias("nameplate"))


def reported_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported quantities of customers and years from their orders, in long form."""
    o = table(spark, sf_dir, "orders")
    q = F.element_at(F.array(F.lit("biogas"), F.lit("vinasse"), F.lit("cake"), F.lit("cofeed")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    g = o.groupBy(F.col("o_custkey").alias("plant"), F.year("o_orderdate").alias("period"), q.alias("quantity")).agg(F.max(F.round("o_totalprice", 2)).alias("value"), F.count("*").alias("n"))
    return g


_REP = """rep AS (SELECT o_custkey AS plant, year(o_orderdate) AS period, CASE o_orderkey % 4 WHEN 0 THEN 'biogas' WHEN 1 THEN 'vinasse' WHEN 2 THEN 'cake' ELSE 'cofeed' END AS quantity,
  max(round(o_totalprice, 2)) AS value, count(*) AS n FROM orders GROUP BY 1, 2, 3),
 wide AS (SELECT plant, period, max(CASE WHEN quantity = 'biogas' THEN value END) AS biogas, max(CASE WHEN quantity = 'vinasse' THEN value END) AS vinasse,
  max(CASE WHEN quantity = 'cake' THEN value END) AS cake, max(CASE WHEN quantity = 'cofeed' THEN value END) AS cofeed FROM rep GROUP BY 1, 2),
 f2g AS (SELECT plant, period, x AS x_ch4, biogas, vinasse, cake, cofeed, (vinasse * 6.3e0 + cake * 0.5e0) / x AS modelled FROM wide, (SELECT unnest([0.5e0, 0.6e0]) AS x) WHERE biogas IS NOT NULL)"""
_PARAMS = [("yield", "vinasse", 0.3, 0.25, 0.34), ("bmp", "cake", 220.0, 185.0, 260.0)]


def feed_to_gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = calibrate.feed_to_gas(reported_long(spark, sf_dir), ["plant", "period"], 6.3, 0.5, [0.5, 0.6])
    return t.select("plant", "period", "x_ch4", *[F.round(c, 4).alias(c) for c in ("biogas", "modelled", "explained", "gas_per_cofeed")])


def closure_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = calibrate.feed_to_gas(reported_long(spark, sf_dir), ["plant", "period"], 6.3, 0.5, [0.5, 0.6])
    c = calibrate.closure_values(t, ["plant", "period"], _PARAMS, {"vinasse": 6.3, "cake": 0.5})
    return c.select("plant", "period", "x_ch4", "param", F.round("closure", 6).alias("closure"), "in_range")


def reported_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plant"), F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("quantity"), F.round("o_totalprice", 2).alias("value"))
    return calibrate.single_value(o, ["plant", "period", "quantity"], "value")


_EV = "ev AS (SELECT user_id, event_type, ts, value / 500 AS ndvi FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "ts", (F.col("value") / 500).alias("ndvi"))


def harvest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = supply.harvest_events(_events(spark, sf_dir), "user_id", "ts", "ndvi", 0.6, 0.3, 6, 3)
    return h.select("user_id", "date_high", "date_low", "harvest_date", "uncertainty_days", F.round("index_before", 9).alias("index_before"), F.round("index_after", 9).alias("index_after"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg((F.col("user_id") % 7).alias("grp"), (F.col("user_id") % 40 + 1).cast("double").alias("area"))


def harvested_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = supply.harvest_events(_events(spark, sf_dir), "user_id", "ts", "ndvi", 0.6, 0.3, 6, 3)
    m = supply.harvested_area(ev, _units(spark, sf_dir), "user_id", "grp", "area")
    return supply.season_shares(m, "grp", "harvested_ha", 4).select("grp", "month", "harvested_ha", "n_units", "season", F.round("share", 9).alias("share"))


def activity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = supply.harvest_events(_events(spark, sf_dir), "user_id", "ts", "ndvi", 0.6, 0.3, 6, 3)
    return supply.activity_flags(ev, _units(spark, sf_dir), "user_id", "grp", [2022, 2023], 4, 5)


_HARV = _EV + """, pr AS (SELECT user_id, ts, ndvi, lag(ts) OVER w AS t0, lag(ndvi) OVER w AS v0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, ndvi)),
 ca AS (SELECT *, floor((epoch_us(ts) - epoch_us(t0)) / 86400000000e0) AS gap, epoch_us(t0) + ((epoch_us(ts) - epoch_us(t0)) // 2) AS mid FROM pr WHERE v0 >= 0.6 AND ndvi <= 0.3),
 cb AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mid, t0, ts) AS n FROM ca WHERE gap <= 6),
 acc AS (WITH RECURSIVE r AS (
   SELECT user_id, n, mid AS last, true AS ok FROM cb WHERE n = 1
   UNION ALL
   SELECT c.user_id, c.n, CASE WHEN floor((c.mid - r.last) / 86400000000e0) >= 3 THEN c.mid ELSE r.last END, floor((c.mid - r.last) / 86400000000e0) >= 3 FROM r JOIN cb c ON c.user_id = r.user_id AND c.n = r.n + 1)
  SELECT cb.user_id, t0::DATE AS date_high, ts::DATE AS date_low, make_timestamp(mid)::DATE AS harvest_date, gap / 2e0 AS uncertainty_days, v0, ndvi FROM cb JOIN r USING (user_id, n) WHERE ok)"""
_UNITS = "un AS (SELECT DISTINCT user_id, user_id % 7 AS grp, (user_id % 40 + 1)::DOUBLE AS area FROM events)"


def reactor_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    log = e.select(
        F.col("event_type").alias("reactor_id"), F.col("ts").cast("date").alias("date"), (F.col("value") / 10).alias("feed_g"), F.lit(5.0).alias("volume_l"), (F.col("event_id") % 5 + 1).cast("double").alias("effluent_l"), F.col("value").alias("gas_nl"),
        (50 + F.col("user_id") % 20).cast("double").alias("ch4_pct"), (F.col("event_id") % 900 + 100).cast("double").alias("fos"), (F.col("user_id") % 700 + 1000).cast("double").alias("tac"), F.when(F.col("event_id") % 97 == 0, "synthetic row").alias("notes"),
    )
    w = calibrate.weekly_reactor(log, 0.35)
    return w.select("reactor_id", "week_end", "days", *[F.round(c, 6).alias(c) for c in ("olr", "hrt_d", "specific_yield", "fos_tac")], "ok_fos_tac")


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("u", F.col("user_id") % 50)
    return e.select("event_type", "u", (F.day("ts")).cast("double").alias("day"), F.col("value").alias("gas"), (F.col("user_id") % 9 + 1).cast("double").alias("inoculum_g"), (F.col("user_id") % 13 + 1).cast("double").alias("substrate_g"), (F.col("event_id") % 4 == 0).alias("blank"), "event_id")


def blank_corrected_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _curves(spark, sf_dir)
    y = calibrate.blank_corrected(c.where("NOT blank"), c.where("blank"), ["event_type"])
    return y.select("event_id", F.round("specific_yield", 6).alias("specific_yield"))


def replicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = calibrate.replicate_validity(_curves(spark, sf_dir).select("event_type", "u", "day", F.col("gas").alias("y")), ["event_type", "u"], 0.3, 0.05)
    return v.select("event_type", "u", "final_day", *[F.round(c, 6).alias(c) for c in ("final_mean", "rsd", "end_rate")], "ok_rsd", "ok_end")


def curve_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-order and Gompertz fits of cumulative curves."""
    e = table(spark, sf_dir, "events")
    daily = e.groupBy("event_type", (F.col("user_id") % 20).alias("u"), F.day("ts").cast("double").alias("day")).agg(F.sum("value").alias("v"))

    c = daily.withColumn("y", F.sum("v").over(Window.partitionBy("event_type", "u").orderBy("day")))
    return calibrate.fit_curves(c, ["event_type", "u"])


def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))), 2).alias("v"))
    return supply.cumulative_share(n, "c_nationkey", "v").select("c_nationkey", "v", "rank", F.round("cum_share", 9).alias("cum_share"))


def count_for_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.sum(F.greatest("c_acctbal", F.lit(0.0))), 2).alias("v"))
    return supply.count_for_share(supply.cumulative_share(n, "c_nationkey", "v"), [0.5, 0.8, 0.9])


_SPECIES = [("AUTOMOBILE", 14.0, 1.0, 0.08, 0.8, 300.0), ("BUILDING", 46.0, 1.0, 0.12, 0.8, 200.0), ("FURNITURE", 32.0, 1.0, 0.2, None, 200.0), ("MACHINERY", None, 1.0, 0.25, 0.7, 250.0)]


def _species(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SPECIES, "variable string, rate double, density double, ts double, vs double, bmp double")


def manure_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("ibge_code"), F.col("c_mktsegment").alias("variable")).agg(F.count("*").cast("double").alias("value")).withColumn("year", F.lit(2024))
    m = supply.manure_potential(h, _species(spark), 0.5)
    return m.select("ibge_code", "year", "variable", *[F.round(c, 5).alias(c) for c in ("fresh_t", "ch4_nm3", "ch4_collectable_nm3")])


def missing_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply.missing_coefficients(_species(spark))


_SP = "sp(variable, rate, density, ts, vs, bmp) AS (VALUES " + ", ".join("(" + ", ".join("NULL::DOUBLE" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in _SPECIES) + ")"
QUERIES = {f.__name__: f for f in (
    valid_readings, thousand_scale_months, state_check, ratio_summary, observed_comparison, plant_period_check, operator_municipality, nameplate_in_year, feed_to_gas, closure_values, reported_conflicts,
    harvest_events, harvested_area, activity_flags, reactor_weeks, blank_corrected_yield, replicate_stats, curve_fits, cumulative_share, count_for_share, manure_potential, missing_coefficients,
)}
_NAT = "n AS (SELECT c_nationkey, round(sum(greatest(c_acctbal, 0e0)), 2) AS v FROM customer GROUP BY 1), cs AS (SELECT c_nationkey, v, row_number() OVER (ORDER BY v DESC, c_nationkey) AS rank, sum(v) OVER (ORDER BY v DESC, c_nationkey ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum_share FROM n)"
_IMPL = "vol * (capm / nullif(capg, 0)) * day(last_day(date))"
SQL = {
    "valid_readings": f"WITH {_LATEST} SELECT plant_id, date, capg, vol, util FROM l",
    "thousand_scale_months": f"WITH {_LATEST} SELECT plant_id, date, vol, capg FROM l WHERE vol > 0 AND vol < 0.01e0 * capg",
    "state_check": f"""WITH {_LATEST}, g AS (SELECT date, coalesce(sum({_IMPL}), 0) AS a, coalesce(sum({_IMPL} * CASE WHEN vol > 0 AND vol < 0.01e0 * capg AND municipality = 'SAPEBUCU DO BREJO' THEN 1000 ELSE 1 END), 0) AS b,
        coalesce(sum(capm * day(last_day(date))), 0) AS r FROM l GROUP BY 1)
        SELECT date, round(a, 2) AS published, round(b, 2) AS rescaled, round(a / nullif(r, 0), 6) AS ratio_published, round(b / nullif(r, 0), 6) AS ratio_rescaled FROM g""",
    "ratio_summary": f"""WITH {_LATEST}, x AS (SELECT 'use_ratio' AS ratio, vol / nullif(capg, 0) AS x FROM l UNION ALL SELECT 'yield_ratio', capm / nullif(capg, 0) FROM l)
        SELECT ratio, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.9), 6) AS p90, round(avg(abs(ln(x))), 6) AS mean_abs_log FROM x WHERE x > 0 GROUP BY 1""",
    "observed_comparison": f"""WITH {_LATEST}, j AS (SELECT plant_id, capg * 0.5e0 AS sim, vol AS obs, vol IS NOT NULL AND coalesce(util, 0) > 1 AS u FROM l)
        SELECT plant_id, count(*) AS months, sum(u::INT)::BIGINT AS compared, round(avg(CASE WHEN u THEN abs(sim - obs) END), 4) AS mae, round(avg(CASE WHEN u THEN sim - obs END), 4) AS bias,
        round(sum(CASE WHEN u THEN sim END) / nullif(sum(CASE WHEN u THEN obs END), 0), 4) AS volume_ratio FROM j GROUP BY 1""",
    "plant_period_check": f"""WITH {_LATEST}, y AS (SELECT *, year(date) - (month(date) < 4)::INT AS period FROM l), p AS (SELECT plant_id, period, round(sum(capg) * 0.4e0, 3) AS reported FROM y GROUP BY 1, 2)
        SELECT p.plant_id, p.period, reported, round(sum(vol), 4) AS total, count(DISTINCT CASE WHEN vol IS NOT NULL THEN date END) AS n_months, count(DISTINCT CASE WHEN vol IS NOT NULL THEN date END) = 12 AS complete,
        round(sum(vol) / nullif(reported, 0), 6) AS ratio FROM p LEFT JOIN l ON l.plant_id = p.plant_id AND l.date BETWEEN make_date(period, 4, 1) AND make_date(period + 1, 3, 1) GROUP BY 1, 2, 3""",
    "operator_municipality": f"WITH {_LATEST} SELECT operator, municipality, count(*) AS n, min(date) AS first_month, max(date) AS last_month FROM l GROUP BY 1, 2",
    "nameplate_in_year": f"WITH {_LATEST} SELECT plant_id, arg_max(capm, (year(date) - (month(date) < 4)::INT = 2024)::INT * 1000000 + year(date) * 100 + month(date)) AS nameplate FROM l WHERE capm IS NOT NULL GROUP BY 1",
    "feed_to_gas": f"""WITH {_REP} SELECT plant, period, x_ch4, round(biogas, 4) AS biogas, round(modelled, 4) AS modelled, round(modelled / nullif(biogas, 0), 4) AS explained,
        CASE WHEN cofeed > 0 THEN round((biogas - modelled) / cofeed, 4) END AS gas_per_cofeed FROM f2g""",
    "closure_values": f"""WITH {_REP}, c AS (SELECT plant, period, x_ch4, 'yield' AS param, CASE WHEN vinasse * 6.3e0 > 0 THEN 0.3e0 * (biogas * x_ch4 - cake * 0.5e0) / (vinasse * 6.3e0) END AS s, 0.25e0 AS lo, 0.34e0 AS hi FROM f2g WHERE modelled IS NOT NULL
        UNION ALL SELECT plant, period, x_ch4, 'bmp', CASE WHEN cake * 0.5e0 > 0 THEN 220e0 * (biogas * x_ch4 - vinasse * 6.3e0) / (cake * 0.5e0) END, 185e0, 260e0 FROM f2g WHERE modelled IS NOT NULL)
        SELECT plant, period, x_ch4, param, round(s, 6) AS closure, s BETWEEN lo AND hi AS in_range FROM c""",
    "reported_conflicts": """SELECT o_custkey AS plant, year(o_orderdate) AS period, o_orderpriority AS quantity, CASE WHEN count(DISTINCT round(o_totalprice, 2)) <= 1 THEN max(round(o_totalprice, 2)) END AS value,
        count(DISTINCT round(o_totalprice, 2)) > 1 AS conflict FROM orders GROUP BY 1, 2, 3""",
    "harvest_events": f"WITH {_HARV} SELECT user_id, date_high, date_low, harvest_date, uncertainty_days, round(v0, 9) AS index_before, round(ndvi, 9) AS index_after FROM acc",
    "harvested_area": f"""WITH {_HARV}, {_UNITS}, m AS (SELECT grp, date_trunc('month', harvest_date)::DATE AS month, sum(area) AS harvested_ha, count(DISTINCT acc.user_id) AS n_units FROM acc JOIN un USING (user_id) GROUP BY 1, 2)
        SELECT grp, month, harvested_ha, n_units, year(month) - (month(month) < 4)::INT AS season, round(harvested_ha / sum(harvested_ha) OVER (PARTITION BY grp, year(month) - (month(month) < 4)::INT), 9) AS share FROM m""",
    "activity_flags": f"""WITH {_HARV}, {_UNITS}, n AS (SELECT grp, year(harvest_date) - (month(harvest_date) < 4)::INT AS season, count(DISTINCT acc.user_id) AS n FROM acc JOIN un USING (user_id) GROUP BY 1, 2),
        g AS (SELECT DISTINCT grp, s AS season FROM un, (SELECT unnest([2022, 2023]) AS s)) SELECT grp, season, coalesce(n, 0) AS n_units, coalesce(n, 0) >= 5 AS active FROM g LEFT JOIN n USING (grp, season)""",
    "reactor_weeks": """WITH l AS (SELECT event_type AS reactor_id, (date_trunc('week', ts) + INTERVAL 6 DAY)::DATE AS week_end, value / 10 AS feed, (event_id % 5 + 1)::DOUBLE AS eff, value * (50 + user_id % 20) / 100 AS ch4, (event_id % 900 + 100)::DOUBLE AS fos, (user_id % 700 + 1000)::DOUBLE AS tac
        FROM events WHERE event_id % 97 <> 0), g AS (SELECT reactor_id, week_end, count(*) AS days, avg(feed) AS feed, avg(eff) AS eff, avg(ch4) AS ch4, avg(fos) AS fos, avg(tac) AS tac FROM l GROUP BY 1, 2)
        SELECT reactor_id, week_end, days, round(feed / 5e0, 6) AS olr, round(5e0 / eff, 6) AS hrt_d, round(ch4 * 1000 / nullif(feed, 0), 6) AS specific_yield, round(fos / tac, 6) AS fos_tac, fos / tac <= 0.35e0 AS ok_fos_tac FROM g""",
    "blank_corrected_yield": """WITH c AS (SELECT event_id, event_type, day(ts) AS d, value AS gas, (user_id % 9 + 1)::DOUBLE AS ino, (user_id % 13 + 1)::DOUBLE AS sub, event_id % 4 = 0 AS blank FROM events),
        b AS (SELECT event_type, d, avg(gas / ino) AS bl FROM c WHERE blank GROUP BY 1, 2) SELECT event_id, round((gas - bl * ino) / sub, 6) AS specific_yield FROM c LEFT JOIN b USING (event_type, d) WHERE NOT blank""",
    "replicate_stats": """WITH d AS (SELECT event_type, user_id % 50 AS u, day(ts)::DOUBLE AS day, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM events GROUP BY 1, 2, 3),
        l AS (SELECT *, lag(m) OVER w AS m0, lag(day) OVER w AS d0, row_number() OVER (PARTITION BY event_type, u ORDER BY day DESC) AS r FROM d WINDOW w AS (PARTITION BY event_type, u ORDER BY day)),
        s AS (SELECT *, CASE WHEN n > 1 THEN sd / nullif(m, 0) END AS rsd, (m - m0) / nullif(day - d0, 0) / nullif(m, 0) AS er FROM l WHERE r = 1)
        SELECT event_type, u, day AS final_day, round(m, 6) AS final_mean, round(rsd, 6) AS rsd, round(er, 6) AS end_rate, coalesce(rsd <= 0.3, false) AS ok_rsd, coalesce(er <= 0.05, false) AS ok_end FROM s""",
    "cumulative_share": f"WITH {_NAT} SELECT c_nationkey, v, rank, round(cum_share, 9) AS cum_share FROM cs",
    "count_for_share": f"WITH {_NAT} SELECT min(CASE WHEN cum_share >= 0.5 - 1e-12 THEN rank END) AS n_50, min(CASE WHEN cum_share >= 0.8 - 1e-12 THEN rank END) AS n_80, min(CASE WHEN cum_share >= 0.9 - 1e-12 THEN rank END) AS n_90 FROM cs",
    "manure_potential": f"""WITH {_SP}, h AS (SELECT c_nationkey AS ibge_code, 2024 AS year, c_mktsegment AS variable, count(*)::DOUBLE AS value FROM customer GROUP BY 1, 3), m AS (SELECT h.*, value * rate * 365 / 1000 * density AS f, ts, vs, bmp FROM h JOIN sp USING (variable)
        WHERE rate IS NOT NULL AND density IS NOT NULL AND ts IS NOT NULL AND vs IS NOT NULL AND bmp IS NOT NULL)
        SELECT ibge_code, year, variable, round(f, 5) AS fresh_t, round(f * ts * vs * bmp, 5) AS ch4_nm3, round(f * ts * vs * bmp * 0.5e0, 5) AS ch4_collectable_nm3 FROM m""",
    "missing_coefficients": f"WITH {_SP} SELECT variable, coefficient FROM (SELECT variable, unnest(['rate', 'density', 'ts', 'vs', 'bmp']) AS coefficient, unnest([rate, density, ts, vs, bmp]) AS v FROM sp) WHERE v IS NULL",
}
