"""Queries of the general training-data problems, with their SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.functions import cnpj
from sucrogas.operators.anomalies import OUT_OF_SCALE, implausible_readings
from sucrogas.operators.history import delivered_history
from sucrogas.operators.snapshots import snapshot_changes
from sucrogas.operators.units import capacities_in_common_units, readings_in_common_units
from sucrogas.session import table

MONTHLY = "anp_monthly_sp_plants_from_pilar2b"
SNAPSHOTS = "anp_biomethane_plants_latest_from_pilar2b"
PROJECTS = "projects_capex_proposed_r07"
PARAMETERS = "parameters"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants added, removed and changed between consecutive snapshots."""
    changes = snapshot_changes(table(spark, sf_dir, SNAPSHOTS), "snapshot_date", cnpj.normalize(F.col("cnpj")), "cap_biometano_m3d", "delivered_at", 0.01)
    return changes.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("cnpj"), "change")


P1_SQL = f"""
WITH keyed AS (
  SELECT snapshot_date, cap_biometano_m3d AS cap, delivered_at,
         lpad(regexp_replace(regexp_replace(trim(cnpj), '\\.0+$', ''), '[^0-9]', '', 'g'), 14, '0') AS k
  FROM {SNAPSHOTS} WHERE cnpj IS NOT NULL AND regexp_matches(cnpj, '[0-9]')
), valid AS (
  SELECT snapshot_date, k, cap FROM keyed
  QUALIFY row_number() OVER (PARTITION BY snapshot_date, k ORDER BY delivered_at DESC, cap DESC NULLS LAST) = 1
), cal AS (
  SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS n FROM (SELECT DISTINCT snapshot_date FROM {SNAPSHOTS})
), v AS (SELECT n, k, cap FROM valid JOIN cal USING (snapshot_date)),
events AS (
  SELECT b.n AS n, b.k AS k, 'added' AS change FROM v b LEFT JOIN v a ON a.k = b.k AND a.n = b.n - 1 WHERE a.k IS NULL AND b.n > 1
  UNION ALL
  SELECT a.n + 1, a.k, 'removed' FROM v a LEFT JOIN v b ON a.k = b.k AND a.n = b.n - 1 WHERE b.k IS NULL
  UNION ALL
  SELECT b.n, b.k, 'changed' FROM v b JOIN v a ON a.k = b.k AND a.n = b.n - 1 WHERE abs(a.cap - b.cap) > 0.01
)
SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, k AS cnpj, change FROM events JOIN cal USING (n)
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project capacities and parameter readings in common units."""
    caps = capacities_in_common_units(table(spark, sf_dir, PROJECTS), "id", "capacity_value", "capacity_unit", ["capacity_basis", "notes"])
    reads = readings_in_common_units(table(spark, sf_dir, PARAMETERS), "id", "central", "unit", "parameter", ["notes", "conditions", "quote"])
    both = caps.select(F.lit(PROJECTS).alias("source_table"), "*").unionByName(reads.select(F.lit(PARAMETERS).alias("source_table"), "*"))
    return both.select("source_table", "record_id", "common_unit", "value_milli").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plant-months with an implausible volume or percentage."""
    found = implausible_readings(
        table(spark, sf_dir, MONTHLY), "plant_id", "date", "loaded_at", "vol_biogas_m3d", "util_pct", "cap_biogas_m3d", "cap_biometano_m3d"
    )
    return found.select("plant_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each plant's capacity and operator with their periods."""
    v = delivered_history(table(spark, sf_dir, MONTHLY), "plant_id", "date", "loaded_at", "cap_biometano_m3d", "operator", 0.01)
    return v.select("plant_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plant-months of ``p5_found`` that a range, percentage or run check flags, with those reasons."""
    found = implausible_readings(
        table(spark, sf_dir, MONTHLY), "plant_id", "date", "loaded_at", "vol_biogas_m3d", "util_pct", "cap_biogas_m3d", "cap_biometano_m3d"
    )
    checks = F.col("reasons").bitwiseAND(F.lit(~OUT_OF_SCALE))
    return found.where(checks != 0).select("plant_id", F.date_format("date", "yyyy-MM-dd").alias("date"), checks.alias("reasons"))


def p6_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of each plant's capacity alone, merged delivery by delivery."""
    m = table(spark, sf_dir, MONTHLY).withColumn("_none", F.lit(None).cast("string"))
    v = delivered_history(m, "plant_id", "date", "loaded_at", "cap_biometano_m3d", "_none", 0.01)
    return v.select("plant_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "capacity")


P5_SQL = f"""
WITH l AS (
  SELECT plant_id, date, cap_biogas_m3d AS c, vol_biogas_m3d AS v, util_pct::DOUBLE AS p FROM {MONTHLY} WHERE plant_id IS NOT NULL AND date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY plant_id, date ORDER BY loaded_at DESC NULLS LAST, vol_biogas_m3d DESC NULLS LAST, util_pct DESC NULLS LAST, cap_biogas_m3d DESC NULLS LAST) = 1
), n AS (SELECT *, year(date) * 12 + month(date) AS t FROM l),
g AS (SELECT *, CASE WHEN v <> 0 AND v = lag(v) OVER w AND t = lag(t) OVER w + 1 THEN 0 ELSE 1 END AS s FROM n WINDOW w AS (PARTITION BY plant_id ORDER BY t)),
i AS (SELECT *, sum(s) OVER (PARTITION BY plant_id ORDER BY t) AS k FROM g),
r AS (SELECT *, count(*) OVER (PARTITION BY plant_id, k) AS len, 100 * v / CASE WHEN c > 0 THEN c END AS own FROM i),
f AS (SELECT plant_id, date, CASE WHEN v < 0 THEN 1 ELSE 0 END + CASE WHEN v > c THEN 2 ELSE 0 END + CASE WHEN len >= 4 AND v <> 0 THEN 4 ELSE 0 END
  + CASE WHEN p < 0 OR p > 100 THEN 16 ELSE 0 END + CASE WHEN abs(p - own) > 10 THEN 32 ELSE 0 END AS reasons FROM r)
SELECT plant_id, strftime(date, '%Y-%m-%d') AS date, reasons FROM f WHERE reasons > 0
"""
P6_SQL = f"""
WITH l AS (
  SELECT plant_id, date, cap_biometano_m3d AS c FROM {MONTHLY} WHERE plant_id IS NOT NULL AND date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY plant_id, date ORDER BY loaded_at DESC NULLS LAST, cap_biometano_m3d DESC NULLS LAST) = 1
), b AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY plant_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY plant_id ORDER BY date) AS n FROM l),
s AS (SELECT *, CASE WHEN n = 1 OR abs(c - before) > 0.01 THEN 1 ELSE 0 END AS st FROM b),
v AS (SELECT *, sum(st) OVER (PARTITION BY plant_id ORDER BY date) AS k, coalesce(c, before) AS x FROM s),
g AS (SELECT plant_id, k, min(date) AS d, coalesce(arg_min(c, date) FILTER (WHERE c IS NOT NULL), arg_min(before, date) FILTER (WHERE st = 1)) AS capacity FROM v GROUP BY 1, 2)
SELECT plant_id, strftime(d, '%Y-%m-%d') AS valid_from, coalesce(strftime(lead(d) OVER (PARTITION BY plant_id ORDER BY d) - INTERVAL 1 DAY, '%Y-%m-%d'), '9999-12-31') AS valid_to, capacity FROM g
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p5_checks": p5_checks, "p6_found": p6_found, "p6_capacity": p6_capacity}
SQL = {"p1_found": P1_SQL, "p5_checks": P5_SQL, "p6_capacity": P6_SQL}
