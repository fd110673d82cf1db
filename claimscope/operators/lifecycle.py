"""Growth, retention, expiry, queues and versions of stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators import ordered
from claimscope.runtime import stored


def claim_stats(claims: DataFrame, as_of: str) -> DataFrame:
    """(rows, first_seen, last_seen, garbage, last_day): one pass. Times before 2020 or after next January are garbage."""
    now = F.lit(as_of).cast("timestamp")
    bad = (F.col("ts") < F.lit("2020-01-01").cast("timestamp")) | (F.col("ts") > F.make_timestamp(F.year(now) + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return claims.agg(
        F.count("*").alias("rows"), F.min("ts").cast("string").alias("first_seen"), F.max("ts").cast("string").alias("last_seen"),
        F.count_if(bad).alias("garbage"), F.count_if((F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") < now)).alias("last_day"),
    )


def retention_split(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows with their day and whether they are kept; rows without a time are kept."""
    limit = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
    return rows.withColumn("day", F.to_date("ts")).withColumn("kept", F.col("ts").isNull() | (F.col("ts") >= limit))


def archive(rows: DataFrame, path: str, as_of: str, days: int) -> tuple[DataFrame, int]:
    """Writes what is past its days as gzip JSON by day, verifies the count, and returns (what stays, rows archived)."""
    split = stored(retention_split(rows, as_of, days))
    old = split.where("NOT kept").drop("kept")
    old.write.mode("overwrite").partitionBy("day").option("compression", "gzip").json(path)  # as many files a day as tasks hold it
    want = old.count()
    done = rows.sparkSession.read.json(path).count() if want else 0
    if done != want:
        raise OSError(f"archived {done} of {want} rows at {path}; nothing was removed")
    return split.where("kept").drop("kept", "day"), want


def expired(labels: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Labels with expired_at set where they are active and past their days."""
    now = F.lit(as_of).cast("timestamp")
    past = F.col("expired_at").isNull() & (F.col("ctime") <= now - F.make_interval(days=F.lit(days)))
    return labels.withColumn("expired_at", F.when(past, now).otherwise(F.col("expired_at")))


def queue(requests: DataFrame, key: list[str], refresh: bool = False) -> DataFrame:
    """One entry a key: the first request, or with refresh the last."""
    return requests.groupBy(*key).agg((F.max if refresh else F.min)("scheduled_at").alias("scheduled_at"))


def dequeued(entries: DataFrame, key: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(the oldest entries, the rest). The limit is the batch's."""
    taken = entries.orderBy("scheduled_at", *key).limit(limit)
    return taken, entries.join(taken.select(*key), key, "left_anti")


def trimmed_queue(entries: DataFrame, key: list[str], high: int = 11_000, low: int = 10_000) -> DataFrame:
    """The newest ``low`` entries once there are more than ``high``, else all."""
    newest = entries.orderBy(F.desc("scheduled_at"), *key).limit(low)
    if entries.limit(high + 1).count() <= high:
        return entries
    return newest


def versions(deliveries: DataFrame, key: str, at: Column, order: list[str], content: Column, hot: int = ordered.HOT) -> DataFrame:
    """Deliveries with what each does to its key: inserted, updated (content differs from the one before) or unchanged.

    ``at`` is the time, in whole numbers, that the order begins with.
    """
    hashed = deliveries.withColumn("content_hash", F.sha2(content, 256))
    met = ordered.previous(hashed, [key], at, order, F.col("content_hash"), "_before", hot)
    outcome = F.when(F.col("_before").isNull(), "inserted").when(F.col("_before.value").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated")
    return met.withColumn("outcome", outcome).drop("_before")


def second_authors(claims: DataFrame, ttl_seconds: int = 3600, hot: int = ordered.HOT) -> DataFrame:
    """(fp, seq, passes): whether another author has made the claim within the time before, the batch form of the gate.

    It is enough to look at the last claim by another author: the last of all if its author differs, else the last before
    that author's run began.
    """
    at = F.unix_micros("ts")
    rows = ordered.previous(claims.select("fp", "seq", "ts", "author"), ["fp"], at, ["ts", "seq"], F.struct("author", "ts"), "_before", hot)
    other = F.when(~F.col("_before.value.author").eqNullSafe(F.col("author")), F.struct("ts", "seq", F.col("_before.value.ts").alias("other")))
    # of claims of one time a later one may have seen another author; it doesn't count for those before it
    rows = rows.withColumn("_turn", other)
    met = ordered.previous_turn(rows, ["fp"], at, ["ts", "seq"], "_turn", "_last", hot)
    passes = F.unix_micros("ts") - F.unix_micros("_last.other") <= ttl_seconds * 1_000_000
    return met.select("fp", "seq", F.coalesce(passes, F.lit(False)).alias("passes"))


def collisions(fingerprints: DataFrame) -> DataFrame:
    """(inputs, fps, collision_rate, largest, p95) of distinct (text, fp): buckets of texts by fingerprint, p95 by nearest rank."""
    sizes = fingerprints.distinct().groupBy("fp").agg(F.count("*").alias("n"))
    out = sizes.agg(F.sum("n").alias("inputs"), F.count("*").alias("fps"), F.max("n").alias("largest"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n)").cast("long").alias("p95"))
    return out.select("inputs", "fps", F.round(1.0 - F.col("fps").cast("double") / F.col("inputs"), 6).alias("collision_rate"), "largest", "p95")


def budget_counts(decisions: DataFrame, budgets: DataFrame, since: str) -> DataFrame:
    """(rule_id, n, budget, exceeded) of decisions since a time; a rule without budget is never exceeded."""
    n = decisions.where(F.col("ts") >= F.lit(since).cast("timestamp")).groupBy("rule_id").agg(F.count("*").alias("n"))
    return n.join(budgets, "rule_id", "left").withColumn("exceeded", F.coalesce(F.col("n") > F.col("budget"), F.lit(False)))


def top_labels(events: DataFrame, since: str, top: int) -> DataFrame:
    """(target, n): the most labelled targets since a time; ties by name. The limit is the report's."""
    return events.where((F.col("ts") >= F.lit(since).cast("timestamp")) & F.col("target").isNotNull()).groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(top)
