"""The cluster report: one series, everything that is derived from it, and the detections of a run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.claim_text import DEFAULT, FingerprintConfig
from claimscope.operators import cluster, detect
from claimscope.runtime import stored


@dataclass(frozen=True)
class ReportConfig:
    """hours: of the report; history: how many times as far back labels are read; min_volume, warmup: below them sensors are silent."""

    top: int = 20
    hours: int = 24
    bin_hours: int = 1
    history: int = 7
    min_volume: int = 50
    warmup: int = 5
    sensors: bool = True
    disabled: frozenset[str] = field(default_factory=frozenset)
    fingerprints: FingerprintConfig = DEFAULT


def kind_shares(claims: DataFrame) -> DataFrame:
    """(fp_kind, posts, pct, canary): the share of each kind; canary if unknown kinds are more than 5 percent."""
    n = cluster.kind_histogram(claims).drop("fps")
    total = n.agg(F.sum("posts").alias("total"))
    pct = n.crossJoin(total).withColumn("pct", F.round(100.0 * F.col("posts") / F.col("total").cast("double"), 2)).drop("total")  # a handful of kinds and one row
    return pct.withColumn("canary", (F.col("fp_kind") == "unknown") & (F.col("pct") > 5))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """(median): the upper of the middle values, from counts of the values; null of an empty table."""
    q = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{column}`)")
    return rows.agg((-q).alias("median"))


def sensor_rows(series: DataFrame, config: ReportConfig) -> DataFrame:
    """Detections of the sensors at the series' last bin; of a series too small or too short, a note that they were skipped."""
    size = series.agg(F.coalesce(F.sum("posts"), F.lit(0)).alias("posts"), F.countDistinct("bin").alias("bins"), F.max("bin").alias("last")).first()
    spark = series.sparkSession
    kinds = "detector_id string, subject_type string, subject_value string, type string, score double, severity string"
    active = [s for s in ("concentration_shift", "author_velocity") if config.sensors and s not in config.disabled]
    if not active:
        return spark.createDataFrame([], kinds)
    if size.posts < config.min_volume or size.bins < config.warmup:
        return spark.createDataFrame([(s, "global", "", "sensor_skipped", 0.0, "info") for s in active], kinds)
    out = spark.createDataFrame([], kinds)
    if "concentration_shift" in active:
        c = detect.concentration(series).where((F.col("bin") == size.last) & F.col("severity").isNotNull())
        out = out.unionByName(c.select(F.lit("concentration_shift").alias("detector_id"), F.lit("global").alias("subject_type"), F.lit("").alias("subject_value"), F.lit("concentration_spike").alias("type"), F.col("herfindahl").alias("score"), "severity"))
    if "author_velocity" in active:
        v = detect.author_velocity(series).where((F.col("bin") == size.last) & F.col("severity").isNotNull())
        kind = F.when(F.col("change") > 0, "author_spread").otherwise("amplification")
        out = out.unionByName(v.select(F.lit("author_velocity").alias("detector_id"), F.lit("fingerprint").alias("subject_type"), F.col("fp").alias("subject_value"), kind.alias("type"), F.abs("change").alias("score"), "severity"))
    return out


def cluster_report(claims: DataFrame, decisions: DataFrame, as_of: str, config: ReportConfig = ReportConfig()) -> dict:
    """The report of the hours before as_of, as plain data: at most ``top`` clusters and 100 detections reach the driver.

    Clusters led by one author are listed apart, as automation.
    """
    end = F.lit(as_of).cast("timestamp")
    recent = claims.where((F.col("ts") >= end - F.make_interval(hours=F.lit(config.hours))) & (F.col("ts") < end))
    series = stored(cluster.timeseries(recent, config.bin_hours))
    scored = cluster.bursts(series)
    lives, kinds = cluster.half_lives(series), cluster.dominant_kinds(recent).select("fp", "fp_kind")
    best = cluster.ranked_bursts(scored, config.top).join(lives.select("fp", "half_life_bins"), "fp", "left").join(kinds, "fp", "left")
    rows = [r.asDict() | {"automation": r.authors <= 1 and r.total_posts >= 10} for r in best.orderBy("rank").collect()]
    back = decisions.where((F.col("ts") >= end - F.make_interval(hours=F.lit(config.hours * config.history))) & (F.col("ts") < end))
    shifts = cluster.regime_shifts(cluster.label_vectors(back, config.bin_hours)).where(F.col("bin") >= end - F.make_interval(hours=F.lit(config.hours)))
    found = detect.burst_detections(scored).unionByName(detect.regime_detections(shifts)).unionByName(sensor_rows(series, config))
    start = claims.sparkSession.range(1).select((end - F.make_interval(hours=F.lit(config.hours))).cast("string")).first()[0]
    window = {"ts_start": start, "ts_end": as_of, "window": f"{config.hours}h", "config_hash": config.fingerprints.hash()}
    window["window_fingerprint"] = detect.window_name(start, as_of, window["window"], window["config_hash"])
    totals = cluster.window_totals(recent).first()
    return {
        "window": window, "posts": totals.posts, "fingerprints": totals.fps, "kinds": {r.fp_kind: {"fps": r.fps, "posts": r.posts} for r in cluster.kind_histogram(recent).collect()},
        "clusters": [r for r in rows if not r["automation"]], "automation": [r for r in rows if r["automation"]],
        "regime_shifts": [r.asDict() for r in shifts.where("shifted").orderBy("bin").collect()],
        "detections": [detect.envelope(r.asDict(), window) for r in detect.ranked(found).collect()],
    }


def summary(report: dict) -> str:
    """The report in a few lines of text."""
    w = report["window"]
    lines = [f"{w['ts_start']} to {w['ts_end']}: {report['posts']} claims of {report['fingerprints']} fingerprints"]
    lines += [f"  {k}: {v['posts']} claims, {v['fps']} fingerprints" for k, v in sorted(report["kinds"].items(), key=lambda x: (-x[1]["posts"], x[0]))]
    lines += [f"  burst {c['burst_score']:.3f} {c['fp']} ({c['fp_kind']}): {c['total_posts']} posts, synchrony {c['synchrony']:.3f}, half-life {c['half_life_bins'] if c['half_life_bins'] is not None else '-'}" for c in report["clusters"]]
    lines += [f"  {d['severity']} {d['detector_id']} {d['subject']['value']} {d['score']}" for d in report["detections"]]
    return "\n".join(lines)


def mismatches(held: DataFrame, checked: DataFrame) -> DataFrame:
    """(kind, n): how stored creation times (did, created) compare with checked ones; exact, within a second, a day, or further off."""
    both = held.select("did", F.col("created").alias("h")).join(checked.select("did", F.col("created").alias("c")), "did")
    off = F.abs(F.unix_micros("h") - F.unix_micros("c"))
    kind = F.when(F.col("c").isNull(), "not_checked").when(F.col("h").isNull(), "not_held").when(off == 0, "match").when(off < 1_000_000, "subsecond").when(off < 86_400_000_000, "same_day").otherwise("different")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A random sample of n rows that is the same for the same seed and keys. The limit is the sample's."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
