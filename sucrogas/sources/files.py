"""Readers and sinks: typed and all-text CSV, table specifications, incremental loads, verified bundles."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sucrogas.functions.text import br_number
from sucrogas.sources.storage import Folder

IDENTIFIER = re.compile(r"(^|_)(id|code|cnpj|ibge|cep|cod|codigo)($|_)", re.I)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, **options: str) -> DataFrame:
    """A CSV with a header and a declared schema; malformed rows fail the read."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", **options).csv(path)


def read_text_csv(spark: SparkSession, path: str | list[str], names: list[str], sep: str = ",") -> DataFrame:
    """A CSV read as text with columns renamed by position; another number of columns is an error, a byte-order mark is dropped."""
    raw = spark.read.options(header=True, sep=sep, multiLine=True, encoding="UTF-8").csv(path)
    if len(raw.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {len(raw.columns)}")
    return raw.toDF(*names).select(*[F.trim(F.regexp_replace(c, "^﻿", "")).alias(c) for c in names])


def decimal_comma_columns(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Text columns whose every value is a number with a decimal comma become DOUBLE.

    Identifiers (by name, in ``keep``, or with leading zeros) stay text.  One aggregate pass decides for all columns.
    """
    candidates = [c for c, t in df.dtypes if t == "string" and c not in keep and not IDENTIFIER.search(c)]
    if not candidates:
        return df
    tests = []
    for c in candidates:
        n = br_number(F.col(c))
        filled = F.length(F.trim(c)) > 0
        whole, part = F.split_part(F.trim(c), F.lit(","), F.lit(1)), F.split_part(F.trim(c), F.lit(","), F.lit(2))
        # A code is padded: its whole part is longer than the number it stands for.
        padded = F.length(F.regexp_replace(whole, r"\D", "")) > F.length(F.abs(F.regexp_replace(whole, r"\D", "").try_cast("decimal(38,0)")).cast("string"))
        tests += [
            F.bool_and(F.when(filled, n["value"].isNotNull() & ~n["percent"] & ((part != "") | ~F.contains(F.trim(c), F.lit(".")) | n["ambiguous"]))).alias(f"n_{c}"),
            F.bool_or(filled & padded).alias(f"z_{c}"), F.bool_or(filled & (part != "")).alias(f"c_{c}"),
        ]
    seen = df.agg(*tests).first()
    turn = {c for c in candidates if seen[f"n_{c}"] and not seen[f"z_{c}"] and seen[f"c_{c}"]}
    return df.select(*[br_number(F.col(c))["value"].alias(c) if c in turn else F.col(c) for c in df.columns])


@dataclass(frozen=True)
class TableSpec:
    """One table made of several files."""

    name: str
    paths: tuple[str, ...]
    source_id: str
    drop: tuple[str, ...] = ()
    integers: tuple[str, ...] = ()
    from_name: dict[str, str] = field(default_factory=dict)
    private: bool = False


def plan_specs(specs: list[TableSpec], registered: set[str], denied: list[str] = ()) -> list[TableSpec]:
    """Specs with a set of inputs only once; two specs of one name, unregistered sources and denied paths are errors, all listed."""
    errors, seen, out = [], {}, []
    for s in specs:
        key = tuple(sorted(s.paths))
        if s.source_id not in registered:
            errors.append(f"{s.name}: source {s.source_id} is not registered")
        errors += [f"{s.name}: path {p} is denied" for p in s.paths if any(d in p for d in denied)]
        if key in seen:
            continue
        if any(o.name == s.name for o in out):
            errors.append(f"{s.name}: name is taken")
        seen[key] = s
        out.append(s)
    if errors:
        raise ValueError("; ".join(errors))
    return out


def read_spec(spark: SparkSession, spec: TableSpec, sep: str = ",") -> DataFrame:
    """All files of a spec as one table with ``_source_file`` and columns taken from the file name by pattern."""
    df = spark.read.options(header=True, sep=sep).csv(list(spec.paths))
    file = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    df = df.withColumn("_source_file", file)
    for c, pattern in spec.from_name.items():
        df = df.withColumn(c, F.regexp_extract("_source_file", pattern, 1))
    df = df.drop(*spec.drop)
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in spec.integers})


def needs_load(ledger: DataFrame, current: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Tables to load: the hash of their inputs is new or changed, the table is missing, or all are forced.

    ``ledger`` and ``current``: ``name``, ``input_hash``; ``existing``: ``name``.
    """
    j = current.alias("c").join(ledger.alias("l"), "name", "left").join(existing.select("name", F.lit(True).alias("_there")), "name", "left")
    changed = ~F.col("c.input_hash").eqNullSafe(F.col("l.input_hash"))
    return j.where(F.lit(force) | changed | F.col("_there").isNull()).select("name", F.col("c.input_hash").alias("input_hash"))


def file_inventory(spark: SparkSession, path: str, private: list[str] = ()) -> DataFrame:
    """Files below a folder grouped by stem (a shapefile's parts are one data set): parts, bytes, hash of the contents' hashes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    stem = F.regexp_replace(F.col("path"), r"\.[^./]+$", "")
    each = files.select(stem.alias("stem"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", F.sha2("content", 256).alias("sha"))
    hidden = F.lit(False)
    for p in private:
        hidden = hidden | F.col("stem").contains(p)
    listed = F.array_sort(F.collect_list(F.struct("file", "sha")))
    return each.groupBy("stem").agg(F.count("*").alias("parts"), F.sum("length").alias("bytes"), F.sha2(F.to_json(listed), 256).alias("tree_hash")).withColumn("private", hidden)


def canonical_hash(value: object) -> str:
    """First 16 hex digits of the SHA-256 of canonical JSON (sorted keys, NaN as null)."""

    def clean(x: object) -> object:
        if isinstance(x, float) and x != x:
            return None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list | tuple) else x

    return hashlib.sha256(json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Rows and an order-independent hash of a table, computed where the data are."""
    cols = sorted(df.columns)
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
    n, total = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return n, str(total or 0)


def write_bundle(tables: dict[str, DataFrame], keys: dict[str, list[str]], out_dir: str, version: str) -> dict:
    """Tables as Parquet with a manifest, published by one rename.

    All gates are checked before anything is written and all failures are reported together: version form, known
    keys, no duplicate or NULL keys.  ``out_dir`` must not exist.
    """
    errors = [] if re.fullmatch(r"\d+\.\d+\.\d+", version) else [f"version {version} is no x.y.z"]
    for name, df in tables.items():
        k = keys.get(name)
        if not k or any(c not in df.columns for c in k):
            errors.append(f"{name}: key columns are missing")
            continue
        if not df.where(" OR ".join(f"{c} IS NULL" for c in k)).isEmpty():
            errors.append(f"{name}: NULL in key")
        if not df.groupBy(*k).count().where("count > 1").isEmpty():
            errors.append(f"{name}: duplicate keys")
    spark = next(iter(tables.values())).sparkSession if tables else None
    target = Folder(spark, out_dir) if spark else None
    if target and target.exists():
        errors.append(f"{out_dir} exists")
    if not tables:
        errors.append("no tables")
    if errors:
        raise ValueError("; ".join(errors))
    part = Folder(spark, f"{out_dir}.{uuid.uuid4().hex[:8]}.part")
    manifest = {"version": version, "tables": {}}
    try:
        for name, df in tables.items():
            df.write.parquet(part.child(f"{name}.parquet"))
            back = spark.read.parquet(part.child(f"{name}.parquet"))
            rows, digest = content_hash(back)
            manifest["tables"][name] = {"rows": rows, "hash": digest, "columns": dict(back.dtypes), "key": keys[name]}
        manifest["bundle_id"] = canonical_hash(manifest)
        part.write_text("manifest.json", json.dumps(manifest, sort_keys=True, indent=1))
        part.rename(out_dir)
    finally:
        part.delete()
    return manifest


def verify_bundle(spark: SparkSession, bundle_dir: str) -> list[str]:
    """What does not fit the manifest: missing or unlisted tables, other columns, row counts or contents."""
    folder = Folder(spark, bundle_dir)
    try:
        manifest = json.loads(folder.read_text("manifest.json"))
    except Exception as e:  # noqa: BLE001 - whatever keeps it from being read
        return [f"manifest.json: {str(e).splitlines()[0][:200]}"]
    listed = set(manifest["tables"])
    there = {x[: -len(".parquet")] for x in folder.names() if x.endswith(".parquet")}
    problems = [f"{n}: missing" for n in sorted(listed - there)] + [f"{n}: not listed" for n in sorted(there - listed)]
    for n in sorted(listed & there):
        df = spark.read.parquet(folder.child(f"{n}.parquet"))
        want = manifest["tables"][n]
        if dict(df.dtypes) != want["columns"]:
            problems.append(f"{n}: other columns")
            continue
        rows, digest = content_hash(df)
        if rows != want["rows"]:
            problems.append(f"{n}: {rows} rows, expected {want['rows']}")
        elif digest != want["hash"]:
            problems.append(f"{n}: other contents")
    return problems
