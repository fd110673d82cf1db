"""Identity resolution, vintage, seeds and the strata of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions import claim_text as ct
from claimscope.operators import ordered

# The dates that part account vintages, a quarter of 91 days apart.
FIRST_BOUNDARY, LAST_BOUNDARY, QUARTER = "2023-04-24", "2026-04-20", 91
# Freshness classes by age in hours, from the first that an age is below.
AGES = ((24, "<24h"), (48, "24-48h"), (168, "2-7d"))


def boundaries(shift_days: int = 0) -> Column:
    """The vintage boundaries as an array of dates."""
    shifted = [F.date_add(F.lit(d).cast("date"), shift_days) for d in (FIRST_BOUNDARY, LAST_BOUNDARY)]
    return F.sequence(shifted[0], shifted[1], F.expr(f"INTERVAL {QUARTER} DAYS"))


def vintage_index(created: Column, shift_days: int = 0) -> Column:
    """The number of boundaries at or before a day; -1 of null. A width bucket, so no range join."""
    day = F.to_date(created)
    return F.when(day.isNull(), F.lit(-1)).otherwise(F.size(F.filter(boundaries(shift_days), lambda b: b <= day)))


def vintage_label(index: Column) -> Column:
    b = F.transform(boundaries(), lambda d: d.cast("string"))
    n = F.size(b)
    return (
        F.when(index < 0, "v_unknown")
        .when(index == 0, F.concat(F.lit("v0_pre_"), F.get(b, F.lit(0))))
        .when(index < n, F.concat(F.lit("v"), index.cast("string"), F.lit("_"), F.get(b, index - 1), F.lit("_to_"), F.get(b, index)))
        .otherwise(F.concat(F.lit("v"), index.cast("string"), F.lit("_post_"), F.get(b, n - 1)))
    )


def age_class(success_us: Column, as_of_us: Column) -> Column:
    """How long ago the last success was; never if it isn't known, and the last class for ages below 0."""
    hours = (as_of_us - success_us) / F.lit(3_600_000_000)
    c = F.when(success_us.isNull(), "never").when(hours < 0, ">7d")
    for limit, name in AGES:
        c = c.when(hours < limit, name)
    return c.otherwise(">7d")


def resolver_batch(actors: DataFrame, as_of_us: int, limit: int = 20) -> DataFrame:
    """The next accounts to resolve: never resolved first, then by first sight. The limit is the batch's.

    ok again after 24 hours, error after 5 minutes, not_found after 7 days since ``attempt_us``.
    """
    wait = {"ok": 86_400, "error": 300, "not_found": 604_800}
    due = F.col("resolver_status").isNull()
    for status, seconds in wait.items():
        due = due | ((F.col("resolver_status") == status) & (F.col("attempt_us") < as_of_us - seconds * 1_000_000))
    order = [F.when(F.col("resolver_status").isNull(), 0).otherwise(1), F.col("first_seen_at"), F.col("did")]
    return actors.where(due).orderBy(*order).limit(limit)


def reduced(deltas: DataFrame, hot: int = ordered.HOT) -> DataFrame:
    """(did, handle, is_active, first_seen_at, last_seen_at, last_time_us, events): deltas reduced field by field in order of arrival.

    A delta sets handle and activity only if it is not older than any before it, and only those that it has; first and last sight
    don't depend on order. An account is active unless it is said not to be; a null activity means not. Deltas without time set nothing.
    """
    rows = deltas.where("did IS NOT NULL").select("did", F.col("row_no").cast("long").alias("no"), F.col("time_us").cast("long").alias("t"), "has_handle", "handle", "has_active", "active", "observed_at")
    rows = ordered.latest(rows, ["did"], F.col("no"), F.col("t"), "before", True, hot)
    current = F.col("t").isNotNull() & (F.col("before").isNull() | (F.col("t") >= F.col("before")))
    last = lambda has, value: F.max(F.when(current & F.col(has), F.struct("no", F.col(value).alias("v"))))
    out = rows.groupBy("did").agg(
        last("has_handle", "handle").alias("h"), last("has_active", "active").alias("a"), F.min("observed_at").alias("first_seen_at"),
        F.max("observed_at").alias("last_seen_at"), F.max("t").alias("last_time_us"), F.count("*").alias("events"),
    )
    active = F.when(F.col("a").isNull(), F.lit(True)).otherwise(F.coalesce("a.v", F.lit(False)))
    return out.select("did", F.col("h.v").alias("handle"), active.alias("is_active"), "first_seen_at", "last_seen_at", "last_time_us", "events")


def relabelled(accounts: DataFrame, both_as: str = "labelwatch_seed") -> DataFrame:
    """Accounts (source, ...) with those of both sources counted as one of them."""
    return accounts.withColumn("source", F.when(F.col("source") == "both", both_as).otherwise(F.col("source")))


def admissible_families(effects: dict[str, DataFrame], shifts: list[str], least_buckets: int = 2, least_shifts: int = 3) -> DataFrame:
    """(family, buckets, shifts, fresh, with_both, holds) of families that clear the floor in enough buckets of the base effects.

    effects: family_effects by name: base, each of the shifts, fresh and both. A family holds if it also clears in enough of the
    shifts, and if fresh accounts and those of both sources keep the direction of its largest effect.
    """
    def clear(df: DataFrame) -> DataFrame:
        largest = F.max_by("delta_pp", F.abs("delta_pp"))
        return df.where("clears").groupBy("family").agg(F.count("*").alias("buckets"), F.signum(largest).alias("way"))

    base = clear(effects["base"]).where(F.col("buckets") >= least_buckets)
    shifted = None
    for s in shifts:
        part = clear(effects[s]).where(F.col("buckets") >= least_buckets).select("family")
        shifted = part if shifted is None else shifted.unionByName(part)
    shifted = shifted.groupBy("family").agg(F.count("*").alias("shifts"))
    ways = {n: effects[n].groupBy("family").agg(F.signum(F.max_by("delta_pp", F.abs("delta_pp"))).alias(n)) for n in ("fresh", "both")}
    out = base.join(shifted, "family", "left")
    for n, w in ways.items():
        out = out.join(w, "family", "left").withColumn(n, F.coalesce(F.col(n) == F.col("way"), F.lit(False)))
    out = out.select("family", "buckets", F.coalesce("shifts", F.lit(0)).alias("shifts"), "fresh", F.col("both").alias("with_both"))
    return out.withColumn("holds", (F.col("shifts") >= least_shifts) & F.col("fresh") & F.col("with_both"))


def written_back(actors: DataFrame, resolved: DataFrame) -> DataFrame:
    """Accounts after resolutions (did, status, handle, pds_host, at_us): inserted if unknown, else changed field by field."""
    r = resolved.groupBy("did").agg(F.max(F.struct("at_us", "status", "handle", "pds_host")).alias("r"))
    return actors.join(r, "did", "full").select(
        "did", F.coalesce(F.col("handle"), F.col("r.handle")).alias("handle"), F.coalesce(F.col("r.pds_host"), F.col("pds_host")).alias("pds_host"),
        F.coalesce(F.col("r.status"), F.col("resolver_status")).alias("resolver_status"),
        F.when(F.col("r.status") == "ok", F.col("r.at_us")).otherwise(F.col("success_us")).alias("success_us"), F.coalesce("identity_source", F.lit("live")).alias("identity_source"),
    )


def seeded(actors: DataFrame, targets: DataFrame) -> DataFrame:
    """(did, identity_source, outcome) of seed targets: inserted, upgraded from live to both, or skipped."""
    known = actors.select("did", F.col("identity_source").alias("was"))
    return targets.select("did").distinct().join(known, "did", "left").select(
        "did",
        F.when(F.col("was").isNull(), "labelwatch_seed").when(F.col("was") == "live", "both").otherwise(F.col("was")).alias("identity_source"),
        F.when(F.col("was").isNull(), "inserted").when(F.col("was") == "live", "upgraded").otherwise("skipped").alias("outcome"),
    )


def vintages(actors: DataFrame, found: DataFrame, repair: bool = False) -> DataFrame:
    """(did, did_created_at, outcome) of first-created times: written once, and over only as a repair."""
    now = actors.select("did", F.col("did_created_at").alias("held"), F.lit(True).alias("there"))
    outcome = F.when(F.col("there").isNull(), "skipped_missing_row").when(F.col("held").isNull(), "written").otherwise("repaired" if repair else "skipped_existing")
    kept = F.col("created") if repair else F.coalesce("held", "created")
    return found.select("did", "created").join(now, "did", "left").select("did", F.when(F.col("there"), kept).alias("did_created_at"), outcome.alias("outcome"))


def genesis(log: DataFrame) -> DataFrame:
    """(did, created): the time of each account's first operation in the order of the log."""
    return log.where("did IS NOT NULL").groupBy("did").agg(F.min_by("created_at", "seq").alias("created"))


def host_class(host: Column, status: Column, major: tuple[str, ...] = ("bsky.network", "bsky.social")) -> Column:
    """unresolved, major (a host that serves most accounts) or non_major."""
    is_major = F.lit(False)
    for m in major:
        is_major = is_major | (host == m) | F.endswith(host, F.lit("." + m))
    return F.when((status != "ok") | status.isNull() | host.isNull() | (host == ""), "unresolved").when(is_major, "major").otherwise("non_major")


def strata(accounts: DataFrame) -> DataFrame:
    """(source, age, host_class, n) with totals by source, by class and in all, from one pass: totals have nulls."""
    cube = accounts.groupingSets([["source", "age", "host_class"], ["source"], ["host_class"], []], "source", "age", "host_class")
    return cube.agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def stratum_gaps(accounts: DataFrame, seed: str = "labelwatch_seed", live: str = "live") -> DataFrame:
    """(age, seed_pct, live_pct, gap): the share of non-major hosts among resolved accounts, in percent."""
    def share(source: str) -> Column:
        mine = F.col("source") == source
        return 100.0 * F.count_if(mine & (F.col("host_class") == "non_major")) / F.nullif(F.count_if(mine & (F.col("host_class") != "unresolved")), F.lit(0)).cast("double")

    both = accounts.groupBy("age").agg(F.round(share(seed), 2).alias("seed_pct"), F.round(share(live), 2).alias("live_pct"))
    return both.withColumn("gap", F.round(F.col("seed_pct") - F.col("live_pct"), 2))


def top_families(accounts: DataFrame, top: int = 10) -> DataFrame:
    """(source, age, host_class, family, n): the largest host families of each stratum."""
    n = accounts.where("family IS NOT NULL").groupBy("source", "age", "host_class", "family").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("source", "age", "host_class").orderBy(F.desc("n"), "family"))
    return n.withColumn("r", rank).where(F.col("r") <= top).drop("r")


def family_effects(rows: DataFrame, floor: int = 100, floor_pp: float = 5.0, floor_ratio: float = 1.5) -> DataFrame:
    """(bucket, family, seed_n, live_n, seed_pct, live_pct, delta_pp, ratio, clears) of non-major families.

    Rows are (bucket, source, host_class, family). Every bucket meets every family, missing cells being 0; both are few.
    A family is reported in a bucket where either side has ``floor`` accounts.
    """
    n = rows.groupBy("bucket", "source", "host_class", "family").agg(F.count("*").alias("n"))

    def of(source: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("source") == source, F.col("n"))), F.lit(0))

    totals = n.groupBy("bucket").agg(of("labelwatch_seed").alias("seed_total"), of("live").alias("live_total"))
    own = n.where("host_class = 'non_major'").groupBy("bucket", "family").agg(of("labelwatch_seed").alias("seed_n"), of("live").alias("live_n"))
    grid = totals.crossJoin(own.select("family").distinct()).join(own, ["bucket", "family"], "left").na.fill(0, ["seed_n", "live_n"])
    seed, live = ((F.coalesce(100.0 * F.col(f"{s}_n") / F.nullif(F.col(f"{s}_total"), F.lit(0)).cast("double"), F.lit(0.0))) for s in ("seed", "live"))
    rated = grid.where((F.col("seed_n") >= floor) | (F.col("live_n") >= floor)).withColumn("seed_pct", seed).withColumn("live_pct", live)
    ratio = F.when((F.col("live_pct") > 0) & (F.col("seed_pct") > 0), F.col("seed_pct") / F.col("live_pct")).when(F.col("seed_pct") > 0, F.lit(None)).otherwise(F.lit(0.0))
    rated = rated.withColumn("ratio", ratio)
    clears = (
        (F.col("seed_n") >= floor) & (F.col("live_n") >= floor) & (F.abs(F.col("seed_pct") - F.col("live_pct")) >= floor_pp)
        & (F.col("ratio").isNull() | (F.col("ratio") >= floor_ratio) | ((F.col("ratio") > 0) & (F.col("ratio") <= 1 / floor_ratio)))
    )
    return rated.select(
        "bucket", "family", "seed_n", "live_n", F.round("seed_pct", 3).alias("seed_pct"), F.round("live_pct", 3).alias("live_pct"),
        F.round(F.col("seed_pct") - F.col("live_pct"), 3).alias("delta_pp"), F.round("ratio", 3).alias("ratio"), clears.alias("clears"),
    )


def clearing_families(effects: DataFrame, least: int = 2) -> DataFrame:
    return effects.where("clears").groupBy("family").agg(F.count("*").alias("buckets")).where(F.col("buckets") >= least)


def surviving_families(accounts: DataFrame, shifts: tuple[int, ...] = (-14, -7, 0, 7, 14), least: int = 3, floor: int = 100) -> DataFrame:
    """(family, hits): families that clear under at least so many shifts of the boundaries. Accounts are (created, source, host_class, family)."""
    moved = None
    for s in shifts:
        e = clearing_families(family_effects(accounts.withColumn("bucket", vintage_index(F.col("created"), s)), floor)).withColumn("shift", F.lit(s))
        moved = e if moved is None else moved.unionByName(e)
    return moved.groupBy("family").agg(F.count("*").alias("hits")).where(F.col("hits") >= least)


def week_shares(rows: DataFrame, least: int = 200) -> DataFrame:
    """(week, shard, n, total, pct) of (created, shard) by week from Monday; weeks with fewer rows are left out."""
    n = rows.where("created IS NOT NULL").groupBy(F.to_date(F.date_trunc("week", "created")).alias("week"), "shard").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("week"))
    return n.withColumn("total", total).where(F.col("total") >= least).withColumn("pct", F.round(100.0 * F.col("n") / F.col("total").cast("double"), 2))


def interval_changes(shares: DataFrame, days: int = 30, least_pp: float = 20.0) -> DataFrame:
    """(shard, from_week, to_week, from_pct, to_pct): each week against the nearest earlier one within ``days`` that differs so much.

    Weeks where a shard has no rows count as 0 percent. The interval is bounded, so the self-join has a few rows a week.
    """
    weeks = shares.select("week").distinct()
    grid = weeks.crossJoin(shares.select("shard").distinct()).join(shares.select("week", "shard", "pct"), ["week", "shard"], "left").na.fill(0.0, ["pct"])
    a = grid.select("shard", F.col("week").alias("from_week"), F.col("pct").alias("from_pct"))
    b = grid.select("shard", F.col("week").alias("to_week"), F.col("pct").alias("to_pct"))
    near = F.datediff("to_week", "from_week").between(1, days) & (F.abs(F.col("to_pct") - F.col("from_pct")) >= least_pp)
    return b.join(a, "shard").where(near).groupBy("shard", "to_week", "to_pct").agg(F.max(F.struct("from_week", "from_pct")).alias("f")).select("shard", "f.from_week", "to_week", "f.from_pct", "to_pct")


def collapsed_changes(changes: DataFrame, gap_days: int = 60) -> DataFrame:
    """(shard, from_week, to_week, merged, midpoint): changes whose ends are no more than the gap apart are one."""
    order = Window.partitionBy("shard").orderBy("to_week", "from_week")
    new = F.coalesce(F.datediff("to_week", F.lag("to_week").over(order)) > gap_days, F.lit(True))
    runs = changes.withColumn("run", F.sum(new.cast("int")).over(order))
    return runs.groupBy("shard", "run").agg(F.min("from_week").alias("from_week"), F.max("to_week").alias("to_week"), F.count("*").alias("merged")).select(
        "shard", "from_week", "to_week", "merged", F.date_add("from_week", F.floor(F.datediff("to_week", "from_week") / 2).cast("int")).alias("midpoint")
    )


def kept_midpoints(changes: DataFrame, apart: int = 14) -> DataFrame:
    """(boundary): midpoints more than so many days after the last one kept; a fold, as what is kept decides what follows.

    Midpoints are a handful of dates (one a regime), folded in one expression.
    """
    days = changes.agg(F.array_sort(F.collect_set("midpoint")).alias("d"))
    start = F.array().cast("array<date>")
    fold = F.aggregate("d", start, lambda kept, x: F.when((F.size(kept) == 0) | (F.datediff(x, F.element_at(kept, -1)) > apart), F.concat(kept, F.array(x))).otherwise(kept))
    return days.select(F.explode(F.when(F.size("d") > 0, fold).otherwise(start)).alias("boundary"))


def quarterly(first_last: DataFrame) -> DataFrame:
    """(boundary): from (first, last) weeks, steps of 91 days up to the first at or after the last."""
    steps = F.sequence(F.date_add("first", QUARTER), F.date_add("last", QUARTER - 1), F.expr(f"INTERVAL {QUARTER} DAYS"))
    return first_last.where("first < last").select(F.explode(steps).alias("boundary"))
