"""Cluster analytics over the claims, each with its SQL.

Claims are claim_history with the fingerprint cleaned and the arrival (observed_at) as their time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions import claim_text as ct
from claimscope.operators import cluster
from claimscope.runtime import table

AS_OF = "2023-11-05 12:00:00"


def claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claim_history").select(
        "seq", F.col("author_did").alias("author"), ct.plain_key(F.col("claim_fingerprint")).alias("fp"),
        F.col("observed_at").alias("ts"), "confidence", "evidence_class", "fp_kind", "evidence_hash", "post_uri", "provenance",
    )


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """Label decisions as the evidence class of the claims: jetstream ones are committed, others expired."""
    return claims(spark, d).select(
        "ts", F.col("evidence_class").alias("label"), "fp_kind", F.when(F.col("provenance") == "jetstream", "committed").otherwise("expired").alias("status")
    )


def fp_timeseries(spark, d):
    return cluster.timeseries(claims(spark, d)).withColumn("bin", F.col("bin").cast("string"))


def evidence_series(spark, d):
    return cluster.evidence_series(claims(spark, d), 6).withColumn("bin", F.col("bin").cast("string"))


def burst_ranking(spark, d):
    return cluster.ranked_bursts(cluster.bursts(cluster.timeseries(claims(spark, d))), 20).withColumn("bin", F.col("bin").cast("string"))


def synchrony_growth(spark, d):
    return cluster.bursts(cluster.timeseries(claims(spark, d), 5)).withColumn("bin", F.col("bin").cast("string"))


def half_life(spark, d):
    return cluster.half_lives(cluster.timeseries(claims(spark, d)))


def variant_entropy(spark, d):
    return cluster.entropies(claims(spark, d).where("fp IS NOT NULL").groupBy("fp", "evidence_class").agg(F.count("*").alias("posts")), ["fp"])


def cluster_kinds(spark, d):
    return cluster.kind_histogram(claims(spark, d))


def dominant_kind(spark, d):
    return cluster.dominant_kinds(claims(spark, d))


def window_totals(spark, d):
    return cluster.window_totals(claims(spark, d).where(F.col("ts").between("2023-11-01", "2023-11-03")))


def automation_flag(spark, d):
    return cluster.single_author_heavy(cluster.bursts(cluster.timeseries(claims(spark, d)))).select("fp", "authors", "total_posts")


def label_vectors(spark, d):
    return cluster.label_vectors(decisions(spark, d)).withColumn("bin", F.col("bin").cast("string"))


def regime_shift(spark, d):
    return cluster.regime_shifts(cluster.label_vectors(decisions(spark, d))).withColumn("bin", F.col("bin").cast("string"))


def herfindahl(spark, d):
    return cluster.herfindahl(claims(spark, d).where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("posts")))


def author_ratio(spark, d):
    return cluster.author_ratios(cluster.timeseries(claims(spark, d)))


def hourly_rollup(spark, d):
    return cluster.hourly_rollup(claims(spark, d), AS_OF)


def uri_map(spark, d):
    return cluster.uri_map(claims(spark, d)).withColumn("ts", F.col("ts").cast("string"))


def fp_bounds(spark, d):
    return cluster.bounds(cluster.uri_map(claims(spark, d)))


QUERIES = {f.__name__: f for f in (
    burst_ranking, fp_timeseries, evidence_series, synchrony_growth, half_life, variant_entropy, cluster_kinds, dominant_kind, window_totals,
    automation_flag, label_vectors, regime_shift, herfindahl, author_ratio, hourly_rollup, uri_map, fp_bounds,
)}

CLAIMS = """claims AS (SELECT seq, author_did AS author, lower(regexp_replace(claim_fingerprint, '[^\\p{L}\\p{N}]', '', 'g')) AS fp, observed_at AS ts,
  confidence, evidence_class, fp_kind, evidence_hash, post_uri, provenance FROM claim_history)"""


def _series(hours: int) -> str:
    return f"""WITH {CLAIMS}, s AS (
      SELECT fp, date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / {hours}.0) * {hours} AS INTEGER)) AS bin, count(*) AS posts, count(DISTINCT author) AS authors,
             (CAST(sum(CAST(round(confidence * 1e9) AS BIGINT)) AS BIGINT) * 2 + count(confidence) * 100000) // nullif(count(confidence) * 200000, 0) / 10000.0 AS avg_confidence
      FROM claims WHERE ts IS NOT NULL AND fp IS NOT NULL GROUP BY 1, 2)"""


def _bursts(hours: int) -> str:
    return (
        _series(hours)
        + """, w AS (
      SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY fp) AS n_bins, sum(posts) OVER (PARTITION BY fp) AS total_posts,
             CAST(count(*) OVER b AS DOUBLE) AS n, CAST(sum(posts) OVER b AS DOUBLE) AS s, CAST(sum(posts * posts) OVER b AS DOUBLE) AS ss, CAST(sum(authors) OVER b AS DOUBLE) AS sa
      FROM s WINDOW o AS (PARTITION BY fp ORDER BY bin), b AS (PARTITION BY fp ORDER BY bin ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
    bursts AS (
      SELECT fp, CAST(bin AS VARCHAR) AS bin, posts, authors, n_bins,
             round((posts - s / n) / CASE WHEN (n * ss - s * s) / (n * n) > 0 THEN sqrt((n * ss - s * s) / (n * n)) ELSE 1.0 END, 3) AS burst_score,
             round(CAST(authors AS DOUBLE) / posts, 3) AS synchrony,
             round(CASE WHEN sa / n > 0 THEN (authors - sa / n) / (sa / n) ELSE 0.0 END, 3) AS author_growth, CAST(total_posts AS BIGINT) AS total_posts
      FROM w WHERE i = n_bins AND n_bins >= 2)"""
    )


_MAP = "m AS (SELECT post_uri, arg_max(fp, seq) AS fp, arg_max(ts, seq) AS ts, max(seq) AS seq FROM (SELECT post_uri, seq, fp, coalesce(ts, TIMESTAMP '0001-01-01') AS ts FROM claims) WHERE post_uri IS NOT NULL GROUP BY post_uri)"
_VECTORS = """v AS (SELECT date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / {h}.0) * {h} AS INTEGER)) AS bin, evidence_class AS label, count(*) AS n
  FROM claims WHERE provenance = 'jetstream' AND ts IS NOT NULL GROUP BY 1, 2)"""
SHIFTS = _VECTORS.format(h=1) + """,
    b AS (SELECT bin, row_number() OVER (ORDER BY bin) AS i FROM (SELECT DISTINCT bin FROM v)),
    g AS (SELECT b.bin, b.i, l.label, coalesce(v.n, 0) AS n FROM b CROSS JOIN (SELECT DISTINCT label FROM v) l LEFT JOIN v ON v.bin = b.bin AND v.label = l.label),
    h AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY i ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING), 0) AS base FROM g),
    p AS (SELECT bin, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY bin) AS p, CAST(base AS DOUBLE) / nullif(sum(base) OVER (PARTITION BY bin), 0) AS q FROM h),
    j AS (SELECT bin, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 4) AS jsd
          FROM p WHERE q IS NOT NULL GROUP BY bin)"""

ORACLE = {
    "fp_timeseries": _series(1) + " SELECT fp, CAST(bin AS VARCHAR) AS bin, posts, authors, avg_confidence FROM s",
    "evidence_series": f"WITH {CLAIMS} SELECT fp, CAST(date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6.0) * 6 AS INTEGER)) AS VARCHAR) AS bin, evidence_class, count(*) AS posts FROM claims WHERE ts IS NOT NULL GROUP BY ALL",
    "burst_ranking": _bursts(1) + " SELECT *, row_number() OVER (ORDER BY burst_score DESC, fp) AS rank FROM bursts QUALIFY rank <= 20",
    "synchrony_growth": _bursts(5) + " SELECT * FROM bursts",
    "half_life": _series(1)
    + """, i AS (SELECT fp, posts, row_number() OVER (PARTITION BY fp ORDER BY bin) AS i, max(posts) OVER (PARTITION BY fp) AS peak FROM s),
    a AS (SELECT fp, min(i) AS pk FROM i WHERE posts = peak GROUP BY fp)
    SELECT fp, count(*) AS n_bins, max(peak) AS peak_posts, CAST(min(i - pk) FILTER (i > pk AND posts * 2 <= peak AND peak >= 2) AS INTEGER) AS half_life_bins
    FROM i JOIN a USING (fp) GROUP BY fp""",
    "variant_entropy": f"""WITH {CLAIMS}, c AS (SELECT fp, evidence_class, count(*) AS n FROM claims WHERE fp IS NOT NULL GROUP BY ALL),
    t AS (SELECT fp, sum(n) AS t FROM c GROUP BY fp)
    SELECT fp, round(-sum(n / t * log2(n / t)), 6) + 0.0 AS entropy FROM c JOIN t USING (fp) GROUP BY fp""",
    "cluster_kinds": f"WITH {CLAIMS} SELECT coalesce(fp_kind, 'unknown') AS fp_kind, count(DISTINCT fp) AS fps, count(*) AS posts FROM claims GROUP BY 1",
    "dominant_kind": f"""WITH {CLAIMS}, n AS (SELECT fp, coalesce(fp_kind, 'unknown') AS fp_kind, count(*) AS posts FROM claims WHERE fp IS NOT NULL GROUP BY 1, 2)
    SELECT fp, fp_kind, posts FROM n QUALIFY row_number() OVER (PARTITION BY fp ORDER BY posts DESC, fp_kind DESC) = 1""",
    "window_totals": f"WITH {CLAIMS} SELECT count(*) AS posts, count(DISTINCT fp) AS fps FROM claims WHERE ts BETWEEN TIMESTAMP '2023-11-01' AND TIMESTAMP '2023-11-03'",
    "automation_flag": _bursts(1) + " SELECT fp, authors, total_posts FROM bursts WHERE authors <= 1 AND total_posts >= 10",
    "label_vectors": f"WITH {CLAIMS}, {_VECTORS.format(h=1)} SELECT CAST(bin AS VARCHAR) AS bin, label, n FROM v",
    "regime_shift": f"WITH {CLAIMS}, {SHIFTS} SELECT CAST(bin AS VARCHAR) AS bin, jsd, jsd >= 0.3 AS shifted FROM j",
    "herfindahl": f"""WITH {CLAIMS}, c AS (SELECT fp, CAST(count(*) AS DOUBLE) AS n FROM claims WHERE fp IS NOT NULL GROUP BY fp)
    SELECT round(sum(n * n) / (sum(n) * sum(n)), 9) AS herfindahl, CAST(sum(n) AS BIGINT) AS total, count(*) AS parts FROM c""",
    "author_ratio": _series(1) + " SELECT fp, CAST(sum(posts) AS BIGINT) AS posts, CAST(sum(authors) AS BIGINT) AS author_bins, round(CAST(sum(authors) AS DOUBLE) / sum(posts), 6) AS ratio FROM s GROUP BY fp ORDER BY posts DESC, fp LIMIT 20",
    "hourly_rollup": f"""WITH {CLAIMS} SELECT fp AS fingerprint, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_epoch, count(*) AS event_count, count(DISTINCT author) AS unique_authors
    FROM claims WHERE ts >= TIMESTAMP '2023-11-02 12:00:00' AND ts < TIMESTAMP '{AS_OF}' GROUP BY 1, 2""",
    "uri_map": f"WITH {CLAIMS}, {_MAP} SELECT post_uri, fp, CAST(nullif(ts, TIMESTAMP '0001-01-01') AS VARCHAR) AS ts, seq FROM m",
    "fp_bounds": f"WITH {CLAIMS}, {_MAP} SELECT fp, CAST(floor(epoch(min(nullif(ts, TIMESTAMP '0001-01-01')))) AS BIGINT) AS first_seen_epoch, CAST(floor(epoch(max(nullif(ts, TIMESTAMP '0001-01-01')))) AS BIGINT) AS last_seen_epoch, count(*) AS total_claims FROM m GROUP BY fp",
}
