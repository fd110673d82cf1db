"""Detections, sensors and stream health over the claims and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from claimscope.operators import cluster, detect
from claimscope.operators.timestamps import instant_micros
from claimscope.plans.cluster_queries import SHIFTS, _bursts, _series, claims, decisions
from claimscope.runtime import table


def _detections(spark, d):
    bursts = detect.burst_detections(cluster.bursts(cluster.timeseries(claims(spark, d))))
    return bursts.unionByName(detect.regime_detections(cluster.regime_shifts(cluster.label_vectors(decisions(spark, d)))))


def burst_severities(spark, d):
    return detect.burst_detections(cluster.bursts(cluster.timeseries(claims(spark, d)))).groupBy("severity").agg(F.count("*").alias("n"))


def severity_topk(spark, d):
    return detect.ranked(_detections(spark, d)).select("detector_id", "subject_value", "severity", "score")


def sensor_summary(spark, d):
    return detect.severity_table(_detections(spark, d))


def concentration(spark, d):
    return detect.concentration(cluster.timeseries(claims(spark, d))).withColumn("bin", F.col("bin").cast("string"))


def author_velocity(spark, d):
    return detect.author_velocity(cluster.timeseries(claims(spark, d), 6)).withColumn("bin", F.col("bin").cast("string"))


def cooled_detections(spark, d):
    """The bursts of every hour as detections of one window each, let through or held back."""
    s = cluster.timeseries(claims(spark, d), 6)
    hours = F.dense_rank().over(Window.orderBy("bin")).cast("long")  # bins are few
    windows = s.select("bin").distinct().select("bin", hours.alias("window_no"))
    rows = s.where("posts >= 3").join(windows, "bin").select(F.col("fp").alias("det_id"), "window_no", F.log2(F.col("posts").cast("double")).alias("score"), F.when(F.col("posts") >= 8, "high").otherwise("low").alias("severity"))
    return detect.cooled(rows).groupBy("emitted").agg(F.count("*").alias("n"))


def health_windows(spark, d):
    """Arrivals of each hour as windows of one stream, with the lag of arrivals behind their posts' own time; repeats count as dropped.

    The backlog is a level, the running sum of the differences of hourly counts: the count of the hour.
    """
    e = table(spark, d, "post_events").where("ctime IS NOT NULL").withColumn("hour", F.date_trunc("hour", "ctime"))
    zones = table(spark, d, "posts").where("uri IS NOT NULL").groupBy(F.col("uri").alias("event_uri")).agg(F.min(F.struct("seq", "client_zone")).alias("p"))
    own = instant_micros(F.get_json_object("raw", "$.createdAt"), F.col("p.client_zone"))
    late = e.join(zones, "event_uri", "left").select(F.col("hour").alias("window"), F.col("ctime").alias("at"), F.col("event_no").alias("no"), ((F.unix_micros("ctime") - own) / 1e6).alias("lag_s"))
    lag = detect.stream_lag(late).withColumnRenamed("window", "hour")
    per = e.groupBy("hour").agg(F.count("*").alias("n"), F.countDistinct("event_uri").alias("uris")).join(lag, "hour")
    order = Window.orderBy("hour")  # one row an hour
    return per.select(
        F.lit("post_events").alias("stream"), F.row_number().over(order).cast("long").alias("window_no"), F.col("uris").alias("events_in"), F.lit(3600.0).alias("window_secs"),
        F.col("n").alias("backlog"), (F.col("n") - F.col("uris")).alias("dropped"), "lag_s",
    )


def stream_health(spark, d):
    return detect.health(health_windows(spark, d)).select("window_no", "state", "reasons", "gated", "event", F.round("coverage", 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (burst_severities, severity_topk, sensor_summary, concentration, author_velocity, cooled_detections, stream_health)}

_SEVERE = "CASE WHEN burst_score >= 5 THEN 'high' WHEN burst_score >= 3 THEN 'med' WHEN burst_score >= 2 THEN 'low' ELSE 'info' END"
_DETECTIONS = (
    _bursts(1) + f", {SHIFTS}, "
    f"""det AS (SELECT 'burst' AS detector_id, 'fingerprint' AS subject_type, fp AS subject_value, burst_score AS score, {_SEVERE} AS severity FROM bursts WHERE burst_score >= 1
      UNION ALL SELECT 'regime_shift', 'global', CAST(bin AS VARCHAR), jsd, CASE WHEN jsd >= 0.7 THEN 'high' WHEN jsd >= 0.5 THEN 'med' ELSE 'low' END FROM j WHERE jsd >= 0.3),
    rk AS (SELECT *, list_position(['info', 'low', 'med', 'high', 'critical'], severity) AS sr FROM det)"""
)
#: The moving average of the rows (k, i, x) in order of i.
_EWMA = """ew AS (SELECT k, i, x, x AS base FROM vals WHERE i = 1 UNION ALL
  SELECT v.k, v.i, v.x, CASE WHEN e.base = 0 THEN v.x ELSE 2 / 25.0::DOUBLE * v.x + (1 - 2 / 25.0::DOUBLE) * e.base END FROM ew e JOIN vals v ON v.k = e.k AND v.i = e.i + 1)"""

ORACLE = {
    "severity_topk": _DETECTIONS + """, own AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY detector_id ORDER BY sr DESC, score DESC, subject_type, subject_value) <= 20)
      SELECT detector_id, subject_value, severity, score FROM own ORDER BY sr DESC, score DESC, detector_id, subject_type, subject_value LIMIT 100""",
    "sensor_summary": _DETECTIONS + " SELECT detector_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in detect.SEVERITIES) + " FROM det GROUP BY detector_id",
    "concentration": _series(1).replace("WITH", "WITH RECURSIVE", 1) + f""", h AS (SELECT bin, sum(CAST(posts AS DOUBLE) * posts) / (CAST(sum(posts) AS DOUBLE) * CAST(sum(posts) AS DOUBLE)) AS x FROM s GROUP BY bin),
      vals AS (SELECT 1 AS k, bin, x, row_number() OVER (ORDER BY bin) AS i FROM h), {_EWMA}
      SELECT CAST(bin AS VARCHAR) AS bin, round(x, 6) AS herfindahl, round(base, 6) AS baseline, round((x - base) / base, 4) AS increase,
        CASE WHEN (x - base) / base > 0.5 OR x > 0.3 THEN CASE WHEN x > 0.6 THEN 'high' WHEN x > 0.4 THEN 'med' WHEN x > 0.3 THEN 'low' ELSE 'info' END END AS severity FROM ew JOIN vals USING (k, i, x)""",
    "author_velocity": _series(6).replace("WITH", "WITH RECURSIVE", 1) + f""", top AS (SELECT fp FROM s GROUP BY fp ORDER BY sum(posts) DESC, fp LIMIT 20),
      vals AS (SELECT fp AS k, bin, CAST(authors AS DOUBLE) / posts AS x, row_number() OVER (PARTITION BY fp ORDER BY bin) AS i FROM s WHERE fp IN (SELECT fp FROM top)), {_EWMA},
      b AS (SELECT k, i, x, lag(base) OVER (PARTITION BY k ORDER BY i) AS base FROM ew), c AS (SELECT *, (x - base) / base AS c FROM b)
      SELECT k AS fp, CAST(bin AS VARCHAR) AS bin, round(c.x, 6) AS ratio, round(base, 6) AS baseline, round(c, 4) AS change,
        CASE WHEN c > 2 THEN 'high' WHEN c > 1 THEN 'med' WHEN c > 0.5 THEN 'low' WHEN c < -0.8 THEN 'high' WHEN c < -0.6 THEN 'med' WHEN c < -0.4 THEN 'low' END AS severity FROM c JOIN vals USING (k, i)""",
    "cooled_detections": _series(6).replace("WITH", "WITH RECURSIVE", 1) + """, w AS (SELECT bin, row_number() OVER (ORDER BY bin) AS no FROM (SELECT DISTINCT bin FROM s)),
      r AS (SELECT fp, no, log2(CAST(posts AS DOUBLE)) AS score, CASE WHEN posts >= 8 THEN 3 ELSE 1 END AS sr, row_number() OVER (PARTITION BY fp ORDER BY no) AS i FROM s JOIN w USING (bin) WHERE posts >= 3),
      f AS (SELECT fp, i, true AS emitted, no AS ln, score AS ls, sr AS lr FROM r WHERE i = 1 UNION ALL
        SELECT r.fp, r.i, go, CASE WHEN go THEN r.no ELSE ln END, CASE WHEN go THEN r.score ELSE ls END, CASE WHEN go THEN r.sr ELSE lr END
        FROM (SELECT r.*, f.ln, f.ls, f.lr, r.no - f.ln >= 5 OR r.sr > f.lr OR r.score - f.ls >= 0.5 AS go FROM f JOIN r ON r.fp = f.fp AND r.i = f.i + 1) r)
      SELECT emitted, count(*) AS n FROM f GROUP BY emitted""",
    "burst_severities": _bursts(1) + " SELECT CASE WHEN burst_score >= 5 THEN 'high' WHEN burst_score >= 3 THEN 'med' WHEN burst_score >= 2 THEN 'low' ELSE 'info' END AS severity, count(*) AS n FROM bursts WHERE burst_score >= 1 GROUP BY 1",
}
