"""How well fingerprints and tables hold together: majorities, churn, verdicts, retention, receipts of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much of each small change may flip a fingerprint, and the most collisions and churn.
DRIFT_MOST = {"whitespace": 0.05, "punctuation": 0.05, "casefold": 0.05, "url_param": 0.1, "emoji": 0.1, "small_edit": 0.5}
COLLISIONS_MOST, CHURN_MOST = 0.0, 0.1


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(groups, members, in_majority, share): how many members of the groups have their group's most frequent value."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n")).groupBy(group).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    out = n.agg(F.count("*").alias("groups"), F.sum("n").alias("members"), F.sum("most").alias("in_majority"))
    return out.withColumn("share", F.round(F.col("in_majority") / F.col("members"), 6))


def churn(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(anchors, changed, churn): of the keys on both sides, those whose value is another one."""
    met = before.select(key, F.col(value).alias("b")).join(after.select(key, F.col(value).alias("a")), key)
    out = met.agg(F.count("*").alias("anchors"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
    return out.withColumn("churn", F.round(F.col("changed") / F.col("anchors"), 6))


def verdict(measured: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(measure, value, most, ok) of measured (measure, value); a measure without limit isn't judged."""
    most = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("measure")]
    return measured.select("measure", "value", most.alias("most"), F.coalesce(F.col("value") <= most, F.lit(False)).alias("ok")).where("most IS NOT NULL")


def stability_limits() -> dict[str, float]:
    return {"collision_rate": COLLISIONS_MOST, "churn": CHURN_MOST} | {f"drift_{k}": v for k, v in DRIFT_MOST.items()}


def exclusions(rows: DataFrame, **reasons: Column) -> DataFrame:
    """(rows, kept, and a column for each reason): one pass; a row may be left out for several reasons."""
    out = F.lit(False)
    for r in reasons.values():
        out = out | F.coalesce(r, F.lit(False))
    return rows.agg(F.count("*").alias("rows"), F.count_if(~out).alias("kept"), *(F.count_if(F.coalesce(r, F.lit(False))).alias(n) for n, r in reasons.items()))


def retained(rows: DataFrame, at: Column, as_of: str, days: int, raw: str | None = None, raw_hours: int = 24) -> DataFrame:
    """The rows that are kept, those without a time too; a raw column is emptied when it is older than its hours."""
    now = F.lit(as_of).cast("timestamp")
    kept = rows.where(at.isNull() | (at >= now - F.make_interval(days=F.lit(days))))
    return kept if raw is None else kept.withColumn(raw, F.when(at >= now - F.make_interval(hours=F.lit(raw_hours)), F.col(raw)))


def newest(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """A page of the newest rows; its length is between 1 and 500."""
    return rows.orderBy(*order).limit(max(1, min(500, limit)))


def threads(posts: DataFrame) -> DataFrame:
    """(root, uri): the posts of each thread: the root itself, what names it as its root, or as its parent; each once.

    Three equal joins instead of one on either of three conditions.
    """
    ways = F.array_distinct(F.array_compact(F.array("uri", "reply_root_uri", "reply_parent_uri")))
    return posts.select("uri", F.explode(ways).alias("root")).distinct()


def per_minute(events: DataFrame, at: str = "ctime") -> DataFrame:
    """(minute, events, uris): what arrived in each minute, and how many different events that were."""
    return events.where(F.col(at).isNotNull()).groupBy(F.date_trunc("minute", at).alias("minute")).agg(F.count("*").alias("events"), F.countDistinct("event_uri").alias("uris"))


def receipts(log: DataFrame) -> DataFrame:
    """(run_id, started, finished, note): the runs of a log of entries (run_id, kind, at, note); the last note that isn't null holds."""
    when = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("at")))
    return log.groupBy("run_id").agg(
        when("start", F.min).alias("started"), when("finish", F.max).alias("finished"), F.max_by("note", F.when(F.col("note").isNotNull(), F.col("at"))).alias("note")
    )
