"""Queries of the general data operators: timestamps, change feed, late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.operators import changefeed, timestamps
from claimscope.plans import sql
from claimscope.runtime import table
from claimscope.streaming import late_events


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.rewritten(table(spark, d, "posts"), table(spark, d, "claim_history"), table(spark, d, "actor_identity"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_state(table(spark, d, "identity_deltas"))


def p3_actor_differences(spark: SparkSession, d: str) -> DataFrame:
    """What the stored actor_identity has otherwise than the feed says."""
    right = changefeed.current_state(table(spark, d, "identity_deltas"))
    held = table(spark, d, "actor_identity").select("did", F.coalesce("handle", F.lit("")).alias("held_handle"), F.col("is_active").cast("int").alias("held_active"))
    return right.join(held, "did").where("handle <> held_handle OR is_active <> held_active").select("did", "handle", "is_active", "held_handle", "held_active")


def _hourly(spark: SparkSession, d: str) -> late_events.HourlyCounts:
    """The stream of post_events, eight files a batch."""
    return late_events.HourlyCounts(spark, late_events.event_instants(table(spark, d, "posts"))).run(f"{d}/post_events.parquet", files_per_batch=8)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.differences(_hourly(spark, d).current(), table(spark, d, "fingerprint_hourly"))


def p5_late_report(spark: SparkSession, d: str) -> DataFrame:
    """How many deliveries came after the cut-off, of how many events, by whole days after it."""
    late = _hourly(spark, d).late()
    days = F.floor(F.col("late_us") / (24 * late_events.HOUR)).alias("days_late")
    return late.groupBy(days).agg(F.count("*").alias("deliveries"), F.countDistinct("event_uri").alias("events"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_actor_differences": p3_actor_differences, "p5_found": p5_found, "p5_late_report": p5_late_report}

_STATE = """
WITH d AS (
  SELECT did, time_us, coalesce(seq, -9223372036854775808) AS seq, min_by(event_kind, row_no) AS kind, bool_or(has_handle) AS hh,
         min_by(coalesce(handle, chr(0)), row_no) AS handle, bool_or(has_active) AS ha, min_by(coalesce(active, false), row_no) AS active
  FROM identity_deltas WHERE did IS NOT NULL AND time_us IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY did ORDER BY time_us, seq) AS i FROM d),
t AS (SELECT did, max(i) AS last, coalesce(max(i) FILTER (kind = 'tombstone'), 0) AS gone,
      max(i) FILTER (hh AND kind <> 'tombstone') AS h, max(i) FILTER (ha AND kind <> 'tombstone') AS a FROM n GROUP BY did),
state AS (
  SELECT t.did, CASE WHEN t.h > t.gone THEN replace(nh.handle, chr(0), '') ELSE '' END AS handle,
         CASE WHEN t.a > t.gone THEN CAST(na.active AS INTEGER) ELSE 1 END AS is_active
  FROM t LEFT JOIN n nh ON nh.did = t.did AND nh.i = t.h LEFT JOIN n na ON na.did = t.did AND na.i = t.a
  WHERE t.last > t.gone)
"""

_REWRITTEN = " UNION ALL ".join(
    f"SELECT '{t}' AS record_table, CAST({key} AS VARCHAR) AS record_key, us AS time_us FROM {n} WHERE us IS NOT NULL AND NOT regexp_matches({text}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}\\.\\d{{6}}Z$')"
    for t, n, key, text in (("posts", "ip", "seq", "created_at"), ("claim_history", "ic", "seq", "created_at"), ("actor_identity", "ia", "did", "resolver_last_success_at"))
)
_COUNTED = f"""WITH {sql.instants("ip", "posts", "created_at", "client_zone")},
 e AS (SELECT uri, arg_min(coalesce(us, -9000000000000000000), seq) AS us FROM ip WHERE uri IS NOT NULL GROUP BY uri),
 d AS (SELECT v.*, e.us, epoch_us(v.ctime) - e.us - 259200000000 AS over_us FROM post_events v JOIN e ON e.uri = v.event_uri WHERE v.ctime IS NOT NULL AND e.us > -9000000000000000000)"""

ORACLE = {
    "p2_found": f"""WITH {sql.instants("ip", "posts", "created_at", "client_zone")}, {sql.instants("ic", "claim_history", "created_at")}, {sql.instants("ia", "actor_identity", "resolver_last_success_at")} {_REWRITTEN}""",
    "p5_found": _COUNTED
    + """, f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY event_uri ORDER BY ctime, event_no) = 1),
      r AS (SELECT claim_fingerprint AS fingerprint, CAST(floor(us / 3600000000.0) * 3600 AS BIGINT) AS hour_epoch, count(*) AS n, count(DISTINCT author) AS a FROM f WHERE over_us <= 0 AND claim_fingerprint IS NOT NULL GROUP BY 1, 2)
      SELECT coalesce(r.fingerprint, h.fingerprint) AS fingerprint, coalesce(r.hour_epoch, h.hour_epoch) AS hour_epoch
      FROM r FULL JOIN fingerprint_hourly h ON r.fingerprint = h.fingerprint AND r.hour_epoch = h.hour_epoch WHERE n IS DISTINCT FROM event_count OR a IS DISTINCT FROM unique_authors""",
    "p5_late_report": _COUNTED + " SELECT CAST(floor(over_us / 86400000000.0) AS BIGINT) AS days_late, count(*) AS deliveries, count(DISTINCT event_uri) AS events FROM d WHERE over_us > 0 GROUP BY 1",
    "p3_found": _STATE + "SELECT did, handle, is_active FROM state",
    "p3_actor_differences": _STATE
    + """SELECT s.did, s.handle, s.is_active, coalesce(b.handle, '') AS held_handle, CAST(b.is_active AS INTEGER) AS held_active
    FROM state s JOIN actor_identity b USING (did)
    WHERE s.handle <> coalesce(b.handle, '') OR s.is_active <> CAST(b.is_active AS INTEGER)""",
}
