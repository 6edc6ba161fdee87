"""Session settings and table access shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(cpus: int | str = "*", app: str = "tallyloom", **extra: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = SETTINGS | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | extra
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the runtime options the operators rely on; all of them may change in a running session."""
    for key in ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """Reads one parquet table; timestamps without zone become instants in UTC.

    Only columns that are used later are read: the casts are projections and prune like plain columns.
    """
    df = prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster, or one of our own where none is set and all runs on one machine."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    target = named or os.path.join(tempfile.gettempdir(), f"tallyloom-checkpoints-{os.getuid()}")
    spark.sparkContext.setCheckpointDir(target)
    return target


def materialise(df: DataFrame) -> DataFrame:
    """Computes a result once and cuts its lineage by files every executor can read again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
