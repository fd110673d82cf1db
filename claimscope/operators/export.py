"""The export of facts: incremental map of posts, hourly figures, bounds and identities, as one snapshot.

A cycle reads only claims past the last one exported; the map keeps the later claim of each post, so a run after a failure
repeats nothing and loses nothing. The hours of the overlap are recomputed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import cluster
from claimscope.sources import files


def merged_map(known: DataFrame | None, claims: DataFrame, last_seq: int, as_of: str, days: int = 30) -> DataFrame:
    """(post_uri, fp, ts, seq): the map after the claims past last_seq; the later claim of a post wins, old ones are pruned."""
    new = cluster.uri_map(claims.where(F.col("seq") > last_seq))
    both = new if known is None else known.unionByName(new)
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return both.groupBy("post_uri").agg(F.max(F.struct("seq", "fp", "ts")).alias("m")).select("post_uri", "m.fp", "m.ts", "m.seq").where(F.col("ts").isNull() | (F.col("ts") >= limit))


def identity_facts(actors: DataFrame) -> DataFrame:
    """The few columns of an account that readers of the export need."""
    return actors.select("did", "handle", "pds_host", "resolver_status", "resolver_last_success_at", "is_active", "identity_source")


def export_cycle(spark: SparkSession, claims: DataFrame, actors: DataFrame, folder: str, as_of: str, overlap_hours: int = 72, days: int = 30) -> dict:
    """One cycle into a folder of snapshots; returns what it did."""
    known = files.read_snapshot(spark, f"{folder}/uri_fingerprint")
    last = known.agg(F.max("seq")).first()[0] if known is not None else None
    meta = files.read_snapshot(spark, f"{folder}/meta")
    if meta is not None:
        last = meta.first().last_seq
    last = -1 if last is None else last
    seen = claims.agg(F.max("seq")).first()[0]
    files.snapshot(merged_map(known, claims, last, as_of, days), f"{folder}/uri_fingerprint")
    mapped = files.read_snapshot(spark, f"{folder}/uri_fingerprint")
    files.overwrite_hours(cluster.hourly_rollup(claims, as_of, overlap_hours), f"{folder}/fingerprint_hourly")
    done = {
        "posts": mapped.count(), "bounds": files.snapshot(cluster.bounds(mapped.where("fp IS NOT NULL")), f"{folder}/fingerprint_bounds"),
        "identities": files.snapshot(identity_facts(actors), f"{folder}/actor_identity_facts"), "last_seq": last if seen is None else max(last, seen),
    }
    files.snapshot(spark.createDataFrame([(done["last_seq"], as_of)], "last_seq long, as_of string"), f"{folder}/meta")
    return done


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the export: the hourly figures are kept by hour, the others as snapshots."""
    return spark.read.parquet(f"{folder}/{name}") if name == "fingerprint_hourly" else files.read_snapshot(spark, f"{folder}/{name}")
