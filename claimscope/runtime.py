"""What operators share about the running session: tables, the shared folder, lineage cuts."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(app: str = "claimscope", cores: str | None = None) -> SparkSession:
    """A session for local work; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table. Zone-less timestamps mean UTC: they become instants, whatever the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, as_instant(df[f.name], spark))
    return df


def as_instant(c, spark: SparkSession):
    """The instant of a zone-less timestamp read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") == "UTC":
        return c.cast("timestamp")
    return F.convert_timezone(F.lit("UTC"), F.lit(spark.conf.get("spark.sql.session.timeZone")), c).cast("timestamp")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, where it is unset (local tests), one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        at = tempfile.mkdtemp(prefix="claimscope-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    return path


def release() -> None:
    """Lets go of what finished phases hold: shuffle files go once the driver has collected their last reference."""
    gc.collect()
    if (sc := SparkContext._active_spark_context) is not None:
        sc._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in the shared folder; survives the loss of any executor."""
    shared_dir(df.sparkSession)
    release()
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As cut, but as a compressed table; for rows that are wide or read in part. It is removed when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    release()
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone, and with it the means to delete
        pass
