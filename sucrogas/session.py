"""Session helpers: builder defaults, checkpoint folder, table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "sucrogas", master: str | None = None) -> SparkSession.Builder:
    """A session builder with the settings every operator is written for."""
    b = SparkSession.builder.appName(app).config(map=DEFAULTS)
    return b.master(master) if master else b


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the folder named in ``spark.checkpoint.dir``, which the executors of a cluster share.

    Only a session that runs in one process (master ``local``) may leave the setting out and gets a temporary folder; anywhere
    else a missing setting is an error, as a machine-local folder would lose what another executor wrote.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sucrogas-ckpt-"))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows as an expression of the plan, so that its size is known and it is sent along with a join."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    cells = lambda row: F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)])
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.explode(F.array(*[cells(r) for r in rows])).alias("_r")).select("_r.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
