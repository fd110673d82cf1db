"""Accounts: resolution, vintage, strata, effects; and the life of stored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions import claim_text as ct
from claimscope.operators import identity, lifecycle
from claimscope.operators.timestamps import instant_micros
from claimscope.plans import sql
from claimscope.plans.cluster_queries import AS_OF, CLAIMS, claims
from claimscope.runtime import table

AS_OF_US = 1_699_185_600_000_000  # AS_OF in microseconds
#: Hosts under these domains count as major in the tables' world.
MAJOR = ("north.example", "south.example")


def actors(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with their last success as an instant; an attempt is taken to be a success, or the last sight without one."""
    a = table(spark, d, "actor_identity")
    success = instant_micros(F.col("resolver_last_success_at"))
    return a.withColumn("success_us", success).withColumn("attempt_us", F.coalesce(success, F.unix_micros("last_seen_at")))


def accounts(spark: SparkSession, d: str) -> DataFrame:
    """(source, age, host_class, family, created, shard) of each account, for the strata. Age goes by the last sight."""
    return table(spark, d, "actor_identity").select(
        F.col("identity_source").alias("source"), identity.age_class(F.unix_micros("last_seen_at"), F.lit(AS_OF_US)).alias("age"),
        identity.host_class(F.col("pds_host"), F.col("resolver_status"), MAJOR).alias("host_class"), ct.host_family(F.col("pds_host"), MAJOR).alias("family"),
        F.col("did_created_at").alias("created"), F.col("pds_host").alias("shard"), F.col("did").alias("did"),
    )


def resolver_batch(spark, d):
    return identity.resolver_batch(actors(spark, d), AS_OF_US, 200).select("did", "resolver_status")


def resolver_histogram(spark, d):
    a = table(spark, d, "actor_identity").select(F.coalesce("resolver_status", F.lit("unresolved")).alias("status"))
    return a.rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def vintage_buckets(spark, d):
    i = identity.vintage_index(F.col("did_created_at"))
    return table(spark, d, "actor_identity").select(i.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).withColumn("label", identity.vintage_label(F.col("bucket")))


def vintage_shifts(spark, d):
    a = table(spark, d, "actor_identity")
    shifted = F.explode(F.array(*(F.struct(F.lit(s).alias("shift"), identity.vintage_index(F.col("did_created_at"), s).alias("bucket")) for s in (-14, -7, 0, 7, 14))))
    return a.select(shifted.alias("x")).select("x.*").groupBy("shift", "bucket").agg(F.count("*").alias("n"))


def seed_targets(spark, d):
    """Authors of claims as seed targets."""
    targets = table(spark, d, "claim_history").where("author_did IS NOT NULL").select(F.col("author_did").alias("did"))
    return identity.seeded(table(spark, d, "actor_identity"), targets)


def genesis_ops(spark, d):
    return identity.genesis(table(spark, d, "identity_deltas").select("did", F.col("time_us").alias("created_at"), F.col("row_no").alias("seq")))


def freshness_strata(spark, d):
    return identity.strata(accounts(spark, d)).select("source", "age", "host_class", F.col("level").cast("long").alias("level"), "n")


def stratum_gaps(spark, d):
    return identity.stratum_gaps(accounts(spark, d))


def top_families(spark, d):
    return identity.top_families(accounts(spark, d), 5)


def family_effects(spark, d):
    rows = accounts(spark, d).where("host_class <> 'unresolved' AND created IS NOT NULL").withColumn("bucket", identity.vintage_index(F.col("created")))
    return identity.family_effects(rows, floor=3)


def week_share(spark, d):
    return identity.week_shares(accounts(spark, d).where("shard IS NOT NULL").select("created", "shard"), 5).withColumn("week", F.col("week").cast("string"))


def interval_regime(spark, d):
    shares = identity.week_shares(accounts(spark, d).where("shard IS NOT NULL").select("created", F.col("family").alias("shard")), 5)
    return identity.interval_changes(shares).select("shard", F.col("from_week").cast("string").alias("from_week"), F.col("to_week").cast("string").alias("to_week"), "from_pct", "to_pct")


def regime_runs(spark, d):
    shares = identity.week_shares(accounts(spark, d).where("shard IS NOT NULL").select("created", F.col("family").alias("shard")), 5)
    return identity.collapsed_changes(identity.interval_changes(shares)).select("shard", *(F.col(c).cast("string").alias(c) for c in ("from_week", "to_week", "midpoint")), "merged")


def claim_stats(spark, d):
    return lifecycle.claim_stats(claims(spark, d), AS_OF)


def retention_counts(spark, d):
    split = lifecycle.retention_split(claims(spark, d), AS_OF, 5)
    return split.groupBy(F.col("day").cast("string").alias("day"), "kept").agg(F.count("*").alias("n"))


def recheck_queue(spark, d):
    q = lifecycle.queue(claims(spark, d).where("fp IS NOT NULL AND ts IS NOT NULL").select("fp", F.col("ts").alias("scheduled_at")), ["fp"])
    return lifecycle.dequeued(q, ["fp"], 50)[0].select("fp", F.col("scheduled_at").cast("string").alias("scheduled_at"))


def enqueue_gate(spark, d):
    rows = claims(spark, d).where("ts IS NOT NULL AND fp IS NOT NULL AND author IS NOT NULL")
    return lifecycle.second_authors(rows).groupBy("passes").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    resolver_batch, resolver_histogram, vintage_buckets, vintage_shifts, seed_targets, genesis_ops, freshness_strata, stratum_gaps, top_families, family_effects,
    week_share, interval_regime, regime_runs, claim_stats, retention_counts, recheck_queue, enqueue_gate,
)}

_BOUNDS = "SELECT unnest(generate_series(DATE '2023-04-24', DATE '2026-04-20', INTERVAL 91 DAYS)) AS b"
_INDEX = "CASE WHEN did_created_at IS NULL THEN -1 ELSE (SELECT count(*) FROM (" + _BOUNDS + ") WHERE CAST(b AS DATE) <= CAST(did_created_at AS DATE)) END"
_FAMILY = """CASE WHEN len(p) <= 2 THEN h WHEN array_to_string(p[-2:], '.') IN ('north.example', 'south.example') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END"""
_ACCOUNTS = f"""acc0 AS (SELECT *, regexp_replace(regexp_replace(pds_host, ':.*$', ''), '\\.+$', '') AS h, string_split(regexp_replace(regexp_replace(pds_host, ':.*$', ''), '\\.+$', ''), '.') AS p,
   (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_seen_at)) / 3600000000.0 AS hours FROM actor_identity),
 acc AS (SELECT did, identity_source AS source, CASE WHEN hours IS NULL THEN 'never' WHEN hours < 0 THEN '>7d' WHEN hours < 24 THEN '<24h' WHEN hours < 48 THEN '24-48h' WHEN hours < 168 THEN '2-7d' ELSE '>7d' END AS age,
   CASE WHEN resolver_status IS NULL OR resolver_status <> 'ok' OR pds_host IS NULL OR pds_host = '' THEN 'unresolved'
        WHEN pds_host IN ('north.example', 'south.example') OR pds_host LIKE '%.north.example' OR pds_host LIKE '%.south.example' THEN 'major' ELSE 'non_major' END AS host_class,
   {_FAMILY} AS family, did_created_at AS created, pds_host AS shard FROM acc0)"""


def _weeks(shard: str) -> str:
    return f"""w0 AS (SELECT CAST(date_trunc('week', created) AS DATE) AS week, {shard} AS shard, count(*) AS n FROM acc WHERE created IS NOT NULL AND shard IS NOT NULL GROUP BY 1, 2),
      w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY week) AS BIGINT) AS total FROM w0), ws AS (SELECT week, shard, n, total, round(100.0 * n / CAST(total AS DOUBLE), 2) AS pct FROM w WHERE total >= 5)"""


_INTERVAL = f"""WITH {_ACCOUNTS}, {_weeks('family')},
   g AS (SELECT k.week, s.shard, coalesce(ws.pct, 0.0) AS pct FROM (SELECT DISTINCT week FROM ws) k CROSS JOIN (SELECT DISTINCT shard FROM ws) s LEFT JOIN ws ON ws.week = k.week AND ws.shard IS NOT DISTINCT FROM s.shard),
   ch AS (SELECT b.shard, a.week AS from_week, b.week AS to_week, a.pct AS from_pct, b.pct AS to_pct FROM g b JOIN g a ON a.shard = b.shard AND b.week - a.week BETWEEN 1 AND 30 AND abs(b.pct - a.pct) >= 20
          QUALIFY row_number() OVER (PARTITION BY b.shard, b.week ORDER BY a.week DESC) = 1)"""

ORACLE = {
    "resolver_batch": f"""WITH {sql.instants("ia", "actor_identity", "resolver_last_success_at")}, a AS (SELECT *, coalesce(us, epoch_us(last_seen_at)) AS tried FROM ia)
      SELECT did, resolver_status FROM a WHERE resolver_status IS NULL OR tried < {AS_OF_US} - CASE resolver_status WHEN 'ok' THEN 86400 WHEN 'error' THEN 300 WHEN 'not_found' THEN 604800 END * CAST(1000000 AS BIGINT)
      ORDER BY resolver_status IS NOT NULL, first_seen_at NULLS FIRST, did LIMIT 200""",
    "vintage_buckets": f"""WITH l AS (SELECT list(CAST(CAST(b AS DATE) AS VCHAR) ORDER BY b) AS b FROM ({_BOUNDS})), i AS (SELECT CAST({_INDEX} AS INTEGER) AS bucket FROM actor_identity)
      SELECT bucket, count(*) AS n, any_value(CASE WHEN bucket < 0 THEN 'v_unknown' WHEN bucket = 0 THEN 'v0_pre_' || b[1] WHEN bucket < len(b) THEN 'v' || bucket || '_' || b[bucket] || '_to_' || b[bucket + 1]
        ELSE 'v' || bucket || '_post_' || b[-1] END) AS label FROM i, l GROUP BY bucket""".replace("VCHAR", "VARCHAR"),
    "regime_runs": _INTERVAL
    + """, k AS (SELECT *, coalesce(to_week - lag(to_week) OVER (PARTITION BY shard ORDER BY to_week, from_week) > 60, true) AS fresh FROM ch),
      r AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY shard ORDER BY to_week, from_week) AS run FROM k), m AS (SELECT shard, run, min(from_week) AS f, max(to_week) AS t, count(*) AS merged FROM r GROUP BY ALL)
      SELECT shard, CAST(f AS VARCHAR) AS from_week, CAST(t AS VARCHAR) AS to_week, CAST(f + CAST(floor((t - f) / 2) AS INTEGER) AS VARCHAR) AS midpoint, merged FROM m""",
    "resolver_histogram": "SELECT coalesce(resolver_status, 'unresolved') AS status, count(*) AS n FROM actor_identity GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM actor_identity",
    "vintage_shifts": f"""WITH s AS (SELECT unnest([-14, -7, 0, 7, 14]) AS shift), b AS ({_BOUNDS}), x AS (SELECT did, shift, did_created_at FROM actor_identity, s),
      y AS (SELECT did, shift, did_created_at, count(b) FILTER (CAST(b AS DATE) + shift <= CAST(did_created_at AS DATE)) AS k FROM x, b GROUP BY ALL)
      SELECT shift, CAST(CASE WHEN did_created_at IS NULL THEN -1 ELSE k END AS INTEGER) AS bucket, count(*) AS n FROM y GROUP BY 1, 2""",
    "seed_targets": """SELECT t.did, CASE WHEN a.did IS NULL THEN 'labelwatch_seed' WHEN a.identity_source = 'live' THEN 'both' ELSE a.identity_source END AS identity_source,
      CASE WHEN a.did IS NULL THEN 'inserted' WHEN a.identity_source = 'live' THEN 'upgraded' ELSE 'skipped' END AS outcome
      FROM (SELECT DISTINCT author_did AS did FROM claim_history WHERE author_did IS NOT NULL) t LEFT JOIN actor_identity a USING (did)""",
    "genesis_ops": "SELECT did, arg_min(time_us, row_no) AS created FROM identity_deltas WHERE did IS NOT NULL GROUP BY did",
    "freshness_strata": f"WITH {_ACCOUNTS} SELECT source, age, host_class, CAST(grouping(source, age, host_class) AS BIGINT) AS level, count(*) AS n FROM acc GROUP BY GROUPING SETS ((source, age, host_class), (source), (host_class), ())",
    "stratum_gaps": f"""WITH {_ACCOUNTS}, s AS (SELECT age,
      round(100.0 * count(*) FILTER (source = 'labelwatch_seed' AND host_class = 'non_major') / nullif(count(*) FILTER (source = 'labelwatch_seed' AND host_class <> 'unresolved'), 0), 2) AS seed_pct,
      round(100.0 * count(*) FILTER (source = 'live' AND host_class = 'non_major') / nullif(count(*) FILTER (source = 'live' AND host_class <> 'unresolved'), 0), 2) AS live_pct FROM acc GROUP BY age)
      SELECT age, seed_pct, live_pct, round(seed_pct - live_pct, 2) AS gap FROM s""",
    "top_families": f"""WITH {_ACCOUNTS}, n AS (SELECT source, age, host_class, family, count(*) AS n FROM acc WHERE family IS NOT NULL GROUP BY ALL)
      SELECT source, age, host_class, family, n FROM n QUALIFY row_number() OVER (PARTITION BY source, age, host_class ORDER BY n DESC, family) <= 5""",
    "family_effects": f"""WITH {_ACCOUNTS}, r AS (SELECT *, (SELECT count(*) FROM ({_BOUNDS}) WHERE CAST(b AS DATE) <= CAST(created AS DATE)) AS bucket FROM acc WHERE host_class <> 'unresolved' AND created IS NOT NULL),
      t AS (SELECT bucket, count(*) FILTER (source = 'labelwatch_seed') AS st, count(*) FILTER (source = 'live') AS lt FROM r GROUP BY bucket),
      o AS (SELECT bucket, family, count(*) FILTER (source = 'labelwatch_seed') AS sn, count(*) FILTER (source = 'live') AS ln FROM r WHERE host_class = 'non_major' GROUP BY ALL),
      g AS (SELECT t.bucket, f.family, coalesce(o.sn, 0) AS seed_n, coalesce(o.ln, 0) AS live_n, coalesce(100.0 * coalesce(o.sn, 0) / nullif(st, 0), 0.0) AS sp, coalesce(100.0 * coalesce(o.ln, 0) / nullif(lt, 0), 0.0) AS lp
            FROM t CROSS JOIN (SELECT DISTINCT family FROM o) f LEFT JOIN o ON o.bucket = t.bucket AND o.family = f.family),
      q AS (SELECT *, CASE WHEN lp > 0 AND sp > 0 THEN sp / lp WHEN sp > 0 THEN NULL ELSE 0.0 END AS ra FROM g WHERE seed_n >= 3 OR live_n >= 3)
      SELECT CAST(bucket AS INTEGER) AS bucket, family, seed_n, live_n, round(sp, 3) AS seed_pct, round(lp, 3) AS live_pct, round(sp - lp, 3) AS delta_pp, round(ra, 3) AS ratio,
        seed_n >= 3 AND live_n >= 3 AND abs(sp - lp) >= 5 AND (ra IS NULL OR ra >= 1.5 OR (ra > 0 AND ra <= 1 / 1.5)) AS clears FROM q""",
    "week_share": f"WITH {_ACCOUNTS}, {_weeks('shard')} SELECT CAST(week AS VARCHAR) AS week, shard, n, total, pct FROM ws",
    "interval_regime": _INTERVAL + " SELECT shard, CAST(from_week AS VARCHAR) AS from_week, CAST(to_week AS VARCHAR) AS to_week, from_pct, to_pct FROM ch",
    "claim_stats": f"""WITH {CLAIMS} SELECT count(*) AS rows, regexp_replace(CAST(min(ts) AS VARCHAR), '\\.?0+$', '') AS first_seen, regexp_replace(CAST(max(ts) AS VARCHAR), '\\.?0+$', '') AS last_seen,
      count(*) FILTER (ts < TIMESTAMP '2020-01-01' OR ts > TIMESTAMP '2024-01-01') AS garbage, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND ts < TIMESTAMP '{AS_OF}') AS last_day FROM claims""",
    "retention_counts": f"WITH {CLAIMS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts IS NULL OR ts >= TIMESTAMP '{AS_OF}' - INTERVAL 5 DAYS AS kept, count(*) AS n FROM claims GROUP BY ALL",
    "recheck_queue": f"WITH {CLAIMS}, q AS (SELECT fp, min(ts) AS s FROM claims WHERE fp IS NOT NULL AND ts IS NOT NULL GROUP BY fp) SELECT fp, CAST(s AS VARCHAR) AS scheduled_at FROM q ORDER BY s, fp LIMIT 50",
    "enqueue_gate": f"""WITH {CLAIMS}, c AS (SELECT * FROM claims WHERE ts IS NOT NULL AND author IS NOT NULL),
      g AS (SELECT a.seq, coalesce(bool_or(a.ts - b.ts <= INTERVAL 1 HOUR), false) AS passes FROM c a LEFT JOIN c b ON a.fp = b.fp AND a.author <> b.author AND (b.ts, b.seq) < (a.ts, a.seq) AND b.ts >= a.ts - INTERVAL 1 HOUR GROUP BY a.seq)
      SELECT passes, count(*) AS n FROM g GROUP BY passes""",
}
