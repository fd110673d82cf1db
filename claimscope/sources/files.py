"""Reading and writing the engine's files: posts, labels, audits, archives and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POST_SCHEMA = "uri string, cid string, text string, createdAt string, authorDid string, replyParentUri string, replyRootUri string, externalLinks array<string>, embeds array<string>, facets array<string>"


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of JSON lines; blank and broken lines drop out."""
    return spark.read.schema(POST_SCHEMA).json(path).where("uri IS NOT NULL")


def did_documents(raw: DataFrame) -> DataFrame:
    """(did, status, handle, pds_host) from fetched identity documents (did, http_status, body)."""
    doc = F.from_json("body", "alsoKnownAs array<string>, service array<struct<id:string, type:string, serviceEndpoint:string>>")
    pds = F.get(F.filter(F.col("d.service"), lambda s: (s["type"] == "AtprotoPersonalDataServer") | s["id"].endswith("#atproto_pds")), F.lit(0))["serviceEndpoint"]
    name = F.get(F.filter(F.col("d.alsoKnownAs"), lambda a: a.startswith("at://")), F.lit(0))
    readable = (F.col("http_status") == 200) & F.try_parse_json("body").isNotNull()
    status = F.when(F.col("http_status") == 404, "not_found").when(readable, "ok").otherwise("error")
    return raw.withColumn("d", doc).select(
        "did", status.alias("status"), F.regexp_replace(name, "^at://", "").alias("handle"), F.lower(F.regexp_extract(pds, r"^https?://([^/:?#]+)", 1)).alias("pds_host")
    )


def genesis_time(raw: DataFrame) -> DataFrame:
    """(did, created) from fetched operation logs (did, body): the time of the first operation."""
    ops = F.from_json("body", "array<struct<createdAt:string>>")
    return raw.select("did", F.try_to_timestamp(F.get(ops, F.lit(0))["createdAt"]).alias("created"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A report's (value) lines as one ordered text file; reports are bounded by their own limits."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def append_audit(labels: DataFrame, path: str, mode: str) -> None:
    """Labels appended to the audit of their emit mode: emit goes out, anything else is held back under its own name."""
    labels.withColumn("emit_mode", F.lit(mode)).write.mode("append").partitionBy("emit_mode").json(path)


def snapshot(df: DataFrame, path: str) -> int:
    """Replaces a Parquet table: written whole beside the earlier versions, then a pointer is switched in one rename; its rows.

    Readers (read_snapshot) follow the pointer, so they see the old version or the new one and never neither. A crash leaves at most an
    unnamed version. The version before stays for those that read it now; older ones go.
    """
    spark = df.sparkSession
    fs, at = _file_system(spark, path)
    before = _version(fs, at)
    version = (before or 0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version}")
    n = spark.read.schema(df.schema).parquet(f"{path}/v{version}").count()
    fs.create(at(f"{path}/current={version}.new"), True).close()
    fs.rename(at(f"{path}/current={version}.new"), at(f"{path}/current={version}"))
    for v in range(max(1, version - 2), version):
        fs.delete(at(f"{path}/current={v}"), False)
    if version > 2:
        fs.delete(at(f"{path}/v{version - 2}"), True)
    return n


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that snapshot wrote last, or None."""
    fs, at = _file_system(spark, path)
    version = _version(fs, at)
    return None if version is None else spark.read.parquet(f"{path}/v{version}")


def _file_system(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda p: make(p) if p.startswith(path) else make(f"{path}/{p}")


def _version(fs, at) -> int | None:
    """The highest pointer: where a crash left two, the later one."""
    found = fs.globStatus(at("current=*[0-9]"))
    return max((int(f.getPath().getName().partition("=")[2]) for f in found or []), default=None)


def overwrite_hours(rollup: DataFrame, path: str) -> None:
    """Replaces only the hours that a rollup holds; other hours of the table stay as they are."""
    day = F.to_date(F.timestamp_seconds("hour_epoch"))
    rollup.withColumn("day", day).withColumn("hour", F.col("hour_epoch")).repartition("hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hour").parquet(path)
