"""Readers of registry files and small exchange files, and the staged table sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sucrogas.sources.files import content_hash
from sucrogas.sources.storage import Folder

try:
    import yaml
except ImportError:  # only the source list needs it
    yaml = None

PARAMETER_COLUMNS = ["id", "module", "parameter", "central", "low", "high", "unit", "source", "confidence", "notes", "page", "quote"]


def typed_twins(raw: DataFrame, numbers: tuple[str, ...] = ("central", "low", "high")) -> DataFrame:
    """Every text column trimmed (NULL as ""), and of those in ``numbers`` the text as ``raw_<name>`` beside the value, NULL where it is no plain number."""
    clean = raw.select(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in raw.columns])
    return clean.select(*[F.col(c) for c in clean.columns if c not in numbers], *[x for c in numbers for x in (F.col(c).alias(f"raw_{c}"), F.col(c).try_cast("double").alias(c))])


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """A parameter file with typed twins; columns beyond the known ones are dropped, missing ones are an error."""
    raw = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    missing = [c for c in PARAMETER_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return typed_twins(raw.select(*PARAMETER_COLUMNS))


def parameter(params: DataFrame, id_: str) -> dict:
    """One parameter; KeyError if it is not there."""
    row = params.where(F.col("id") == id_).limit(1).collect()
    if not row:
        raise KeyError(f"parameter {id_} is not in the table: add it with its source")
    return row[0].asDict()


def without_thousands(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numbers written with commas between thousands ("1,234.5") as values; texts that are none give NULL."""
    return df.withColumns({c: F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double") for c in columns if c in df.columns})


def read_projects(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A project file: all text, the listed columns as numbers."""
    return without_thousands(spark.read.options(header=True, multiLine=True, escape='"').csv(path), numbers)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """The list under ``sources`` of a YAML file: one row per entry, every value as text (lists joined by ";")."""
    if yaml is None:
        raise RuntimeError("reading YAML needs the yaml package")
    head, _, name = path.rpartition("/")
    doc = yaml.safe_load(Folder(spark, head or ".").read_text(name))
    entries = doc.get("sources") if isinstance(doc, dict) else None
    if not isinstance(entries, list) or not all(isinstance(e, dict) for e in entries):
        raise ValueError("the file needs a list of mappings under sources")
    keys = sorted({k for e in entries for k in e})
    text = lambda v: None if v is None else ";".join(map(str, v)) if isinstance(v, list) else str(v)
    return spark.createDataFrame([tuple(text(e.get(k)) for k in keys) for e in entries], ", ".join(f"`{k}` string" for k in keys)) if entries else spark.createDataFrame([], "id string")


def points(raw: DataFrame, lat: str, lon: str) -> DataFrame:
    """Rows with coordinates in degrees as ``lat`` and ``lon``; NULL where one is no number or out of range."""
    la, lo = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    ok = la.between(-90, 90) & lo.between(-180, 180)
    return raw.select(*[F.col(c) for c in raw.columns if c not in (lat, lon)], F.when(ok, la).alias("lat"), F.when(ok, lo).alias("lon"))


def extra_candidates(raw: DataFrame) -> DataFrame:
    """Further candidate sites (``id``, ``lat``, ``lon``, optionally ``kind``, ``name``, ``code``); refused as a whole if anything is wrong.

    Missing columns, coordinates that are no degrees, missing and repeated ids are all named in one ValueError.
    """
    missing = [c for c in ("id", "lat", "lon") if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    p = points(raw.withColumn("id", F.nullif(F.trim("id"), F.lit(""))), "lat", "lon")
    bad, unnamed, n, distinct = p.agg(F.sum((F.col("lat").isNull()).cast("int")), F.sum(F.col("id").isNull().cast("int")), F.count("id"), F.count_distinct("id")).first()
    problems = [f"{k} {t}" for k, t in ((bad or 0, "rows without coordinates in degrees"), (unnamed or 0, "rows without id"), (n - distinct, "repeated ids")) if k]
    if problems:
        raise ValueError("; ".join(problems))
    optional = lambda c, default: (F.coalesce(F.col(c), F.lit(default)) if c in raw.columns else F.lit(default)).alias(c)
    return p.select("id", optional("kind", "extra"), optional("name", ""), optional("code", ""), "lat", "lon")


def criteria(raw: DataFrame, key: str, excluded: str = "excluded") -> DataFrame:
    """Criteria of an exchange file in long form: key, ``criterion`` (columns that begin with "n_", without it), ``value`` (NULL for blank), ``excluded`` ("1" or "true")."""
    names = [c for c in raw.columns if c.startswith("n_")]
    out = F.lower(F.trim(F.col(excluded).cast("string"))).isin("1", "true") if excluded in raw.columns else F.lit(False)
    cells = F.array(*[F.struct(F.lit(c[2:]).alias("criterion"), F.col(c).try_cast("double").alias("value")) for c in names])
    return raw.select(key, F.coalesce(out, F.lit(False)).alias("excluded"), F.explode(cells).alias("_c")).select(key, "excluded", "_c.*") if names else raw.select(key, F.lit(False).alias("excluded"), F.lit("").alias("criterion"), F.lit(0.0).alias("value")).limit(0)


def plant_series(df: DataFrame, plant: str, key: str, date: str, columns: list[str]) -> DataFrame:
    """The months of one plant in order as ``month`` (yyyy-MM) with the listed columns; KeyError if it has none."""
    one = df.where(F.col(key) == plant)
    if one.isEmpty():
        raise KeyError(f"no rows of {plant}")
    return one.select(F.date_format(date, "yyyy-MM").alias("month"), *columns).orderBy("month")


def write_small(df: DataFrame, path: str, form: str) -> None:
    """One file of a small result as csv, json or parquet; an existing one is replaced."""
    if form not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown form {form}")
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def staged_load(spark: SparkSession, root: str, loads: dict[str, Callable[[], DataFrame]]) -> list[dict]:
    """Loads tables one by one: each is written beside its place, counted and hashed, then put there by renaming; readers never see half a table.

    A load that fails leaves the old table as it is and does not stop the others.  Returns the log (also appended to ``<root>/_load_log``):
    ``name``, ``ok``, ``rows``, ``hash``, ``error``.
    """
    log = []
    for name, make in loads.items():
        stage = Folder(spark, f"{root}/_stage_{name}_{uuid.uuid4().hex[:8]}")
        old = Folder(spark, f"{root}/{name}")
        try:
            make().write.parquet(stage.path)
            rows, digest = content_hash(spark.read.parquet(stage.path))
            aside = Folder(spark, f"{root}/_old_{name}_{uuid.uuid4().hex[:8]}")
            if old.exists():
                old.rename(aside.path)
            stage.rename(old.path)
            aside.delete()
            log.append({"name": name, "ok": True, "rows": rows, "hash": digest, "error": None})
        except Exception as e:  # noqa: BLE001 - any failure of one table is logged, the others go on
            stage.delete()
            log.append({"name": name, "ok": False, "rows": None, "hash": None, "error": str(e).splitlines()[0][:300] if str(e) else type(e).__name__})
    if log:
        frame = spark.createDataFrame([tuple(x.values()) for x in log], "name string, ok boolean, rows long, hash string, error string")
        frame.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/_load_log")
    return log
