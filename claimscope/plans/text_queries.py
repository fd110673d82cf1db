"""Text signals, fingerprints and drift rules over the posts, with SQL where SQL can say it.

Posts are the first stored delivery of each uri; their time is the instant of created_at, else of their first arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions import claim_text as ct
from claimscope.operators import drift, lifecycle
from claimscope.operators.timestamps import instant_micros
from claimscope.plans import sql
from claimscope.plans.cluster_queries import CLAIMS, claims
from claimscope.runtime import stored, table


def posts(spark: SparkSession, d: str, evidence: bool = True) -> DataFrame:
    """Posts for the drift rules, stored as several rules read them.

    Links are those in the text. The evidence beside it, its hash and the fingerprint are those of a post's latest claim; a post
    without one has its text only. Mixed evidence counts as links, embeds and facets: it is two of them at least, and the
    rules ask for one of links and embeds, or of links and facets. Without ``evidence`` the text alone counts.
    """
    p = table(spark, d, "posts").where("uri IS NOT NULL")
    first = p.groupBy("uri").agg(F.min(F.struct("seq", "text", "author_did", "created_at", "client_zone", "reply_root_uri")).alias("p")).select("uri", "p.*")
    held = claims(spark, d).where("post_uri IS NOT NULL").groupBy(F.col("post_uri").alias("uri")).agg(F.max(F.struct("seq", "fp", "evidence_hash", "evidence_class")).alias("c"))
    text = F.coalesce("text", F.lit(""))
    with_ = lambda *kinds: F.coalesce(F.col("c.evidence_class").isin(*kinds, "mixed"), F.lit(False)).cast("int") if evidence else F.lit(0)
    rows = first.join(held, "uri", "left").select(
        "uri", "seq", F.col("author_did").alias("author"), F.coalesce("reply_root_uri", "uri").alias("root"),
        F.timestamp_micros(instant_micros(F.col("created_at"), F.col("client_zone"))).alias("ts"), text.alias("text"),
        F.greatest(F.size(F.regexp_extract_all(text, F.lit(ct.URL), 0)), with_("link")).alias("n_links"), with_("embed").alias("n_embeds"), with_("facet").alias("n_facets"),
        F.coalesce("c.evidence_hash", F.lit("")).alias("evidence_hash"), F.coalesce("c.fp", ct.fingerprint(text)["fp"]).alias("fp"),
    )
    return stored(rows)


def history(spark: SparkSession, d: str, p: DataFrame) -> DataFrame:
    """Claims of stored posts by their own time, with the text of the post and the evidence of the claim."""
    c = table(spark, d, "claim_history").where("post_uri IS NOT NULL AND author_did IS NOT NULL").select(
        F.col("author_did").alias("author"), ct.plain_key(F.col("claim_fingerprint")).alias("fp"),
        F.timestamp_micros(instant_micros(F.col("created_at"))).alias("ts"), F.col("post_uri").alias("uri"), F.coalesce("evidence_hash", F.lit("")).alias("evidence_hash"),
    )
    return stored(c.where("ts IS NOT NULL AND fp IS NOT NULL").join(p.select("uri", "text"), "uri"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts").select("seq", F.coalesce("text", F.lit("")).alias("text"))


def claim_signals(spark, d):
    """Signals of each post; lists joined by |."""
    sig = ct.signals(F.col("text"))
    return texts(spark, d).withColumn("s", sig).select("seq", *(F.array_join(f"s.{c}", "|").alias(c) for c in ("dates", "quantities", "entities", "modal", "spans")))


def extract_dates(spark, d):
    return texts(spark, d).select("seq", F.explode(ct.dates(F.col("text"))).alias("date")).groupBy("date").agg(F.count("*").alias("n"))


def link_domains(spark, d):
    return texts(spark, d).select("seq", F.explode(ct.link_domains(F.col("text"))).alias("domain")).groupBy("domain").agg(F.countDistinct("seq").alias("posts"))


def fingerprints(spark, d):
    return texts(spark, d).select("seq", ct.fingerprint(F.col("text")).alias("f")).select("seq", "f.fp", "f.kind")


def fingerprint_kinds(spark, d):
    return fingerprints(spark, d).groupBy("kind").agg(F.count("*").alias("posts"), F.countDistinct("fp").alias("fps"))


def complexity_gate(spark, d):
    return texts(spark, d).groupBy(ct.complex_enough(F.col("text")).alias("passes")).agg(F.count("*").alias("posts"))


def prepositions(spark, d):
    return texts(spark, d).select(F.explode(ct.preposition_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def assertiveness(spark, d):
    return texts(spark, d).select(F.round(ct.assertiveness(F.col("text")), 6).alias("assertiveness"), ct.attributed(F.col("text")).alias("attributed")).groupBy("assertiveness", "attributed").agg(F.count("*").alias("posts"))


def collision_report(spark, d):
    return lifecycle.collisions(texts(spark, d).select("text", ct.fingerprint(F.col("text"))["fp"].alias("fp")))


def mutation_stability(spark, d):
    """How many fingerprints each kind of small change flips."""
    each = texts(spark, d).select(ct.fingerprint(F.col("text"))["fp"].alias("before"), F.explode(ct.mutated(F.col("text"))).alias("m")).select("before", "m.*")
    return each.groupBy("mutation").agg(F.count("*").alias("posts"), F.count_if(ct.fingerprint(F.col("text"))["fp"] != F.col("before")).alias("flipped"))


def claim_collisions(spark, d):
    """Buckets of claim records by fingerprint, as distinct (post, fingerprint)."""
    return lifecycle.collisions(claims(spark, d).where("post_uri IS NOT NULL AND fp IS NOT NULL").select(F.col("post_uri").alias("text"), "fp"))


def quote_mismatch(spark, d):
    """By the text alone, as its SQL says."""
    return drift.quote_mismatch(posts(spark, d, evidence=False)).select("subject_uri", "label", "score")


def time_inconsistency(spark, d):
    return drift.time_inconsistency(posts(spark, d)).select("subject_uri", "date_mentioned")


def repeat_claim(spark, d):
    return drift.repeated_claims(posts(spark, d)).select("subject_uri", "prior_uri")


def laundering(spark, d):
    p = posts(spark, d)
    return drift.provenance_laundering(p, history(spark, d, p)).select("subject_uri", "prior_uri")


def drift_labels(spark, d):
    p = posts(spark, d)
    return drift.all_rules(p, history(spark, d, p)).groupBy("label").agg(F.count("*").alias("n"))


def asof_prior(spark, d):
    """Each claim with the last earlier one of its author and fingerprint."""
    c = claims(spark, d).where("ts IS NOT NULL AND author IS NOT NULL").select("author", "fp", "ts", "seq")
    met = drift.asof_prior(c, c.withColumnRenamed("seq", "prior_seq"), ["author", "fp"])
    return met.where("prior IS NOT NULL").select("seq", F.col("prior.prior_seq").alias("prior_seq"))


def edges_degree(spark, d):
    """Accounts by the replies that other accounts send them."""
    p = table(spark, d, "posts")
    e = p.select(F.col("author_did").alias("src"), ct.did_of(F.col("reply_parent_uri")).alias("dst")).where("dst IS NOT NULL AND src <> dst")
    return e.groupBy("dst").agg(F.count("*").alias("replies"), F.countDistinct("src").alias("accounts"))


def top_authors(spark, d):
    return table(spark, d, "post_events").where("author IS NOT NULL").groupBy("author").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "author").limit(20)


def unlabeled_antijoin(spark, d):
    """Claims whose post isn't stored."""
    claimed = table(spark, d, "claim_history").where("post_uri IS NOT NULL").select(F.col("post_uri").alias("uri"), "seq")
    return drift.unlabeled(claimed, table(spark, d, "posts").select(F.col("uri").alias("subject_uri")))


def label_reconcile(spark, d):
    """Evidence classes of claims by arrival against replayed ones, as labels that should hold and labels that do."""
    c = claims(spark, d).where("post_uri IS NOT NULL").select(F.col("post_uri").alias("subject"), F.col("evidence_class").alias("label"), "provenance")
    return drift.reconcile(c.where("provenance = 'jetstream'"), c.where("provenance <> 'jetstream'")).groupBy("action").agg(F.count("*").alias("n"))


def event_versions(spark, d):
    """Deliveries of each event by what they change: inserted, updated or unchanged in their record's id."""
    e = table(spark, d, "post_events").where("event_uri IS NOT NULL")
    return lifecycle.versions(e, "event_uri", F.unix_micros("ctime"), ["ctime", "event_no"], F.coalesce(F.get_json_object("raw", "$.cid"), F.lit(""))).groupBy("outcome").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    claim_signals, extract_dates, link_domains, fingerprints, fingerprint_kinds, complexity_gate, prepositions, assertiveness, collision_report, mutation_stability,
    claim_collisions, quote_mismatch, time_inconsistency, repeat_claim, laundering, drift_labels, asof_prior, edges_degree, top_authors, unlabeled_antijoin, label_reconcile, event_versions,
)}

_TEXTS = "t AS (SELECT seq, coalesce(text, '') AS text FROM posts)"
_FIRST = "f AS (SELECT uri, arg_min(coalesce(text, ''), seq) AS text FROM posts WHERE uri IS NOT NULL GROUP BY uri)"

ORACLE = {
    "claim_signals": f"WITH {_TEXTS} SELECT seq, "
    + ", ".join(f"array_to_string({f}, '|') AS {n}" for n, f in (("dates", sql.dates("text")), ("quantities", sql.quantities("text")), ("entities", sql.entities("text")), ("modal", sql.modals("text")), ("spans", sql.spans("text"))))
    + " FROM t",
    "extract_dates": f"WITH {_TEXTS} SELECT date, count(*) AS n FROM (SELECT unnest({sql.dates('text')}) AS date FROM t) GROUP BY date",
    "complexity_gate": f"WITH {_TEXTS} SELECT {sql.complex_enough('text')} AS passes, count(*) AS posts FROM t GROUP BY 1",
    "prepositions": f"WITH {_TEXTS} SELECT token, count(*) AS n FROM (SELECT unnest({sql.prepositions('text')}) AS token FROM t) GROUP BY token",
    "assertiveness": f"WITH {_TEXTS} SELECT round(least(1.0, len({sql.modals('text')}) / 3.0), 6) AS assertiveness, {sql.attributed('text')} AS attributed, count(*) AS posts FROM t GROUP BY ALL",
    "time_inconsistency": f"WITH {sql.POSTS} SELECT uri AS subject_uri, {sql.FIRST_DATE} AS date_mentioned FROM pp WHERE epoch_us(TRY_CAST({sql.FIRST_DATE} AS DATE)) > us",
    "repeat_claim": f"WITH {sql.POSTS}, {sql.REPEATED} SELECT uri AS subject_uri, prior AS prior_uri FROM rr",
    "laundering": f"WITH {sql.POSTS}, {sql.LAUNDERED} SELECT uri AS subject_uri, prior AS prior_uri FROM ll",
    "drift_labels": f"""WITH {sql.POSTS}, {sql.REPEATED}, {sql.LAUNDERED}, {sql.SURER}, x AS (
      SELECT 'provenance_laundering_possible' AS label FROM ll UNION ALL SELECT 'repeat_claim_no_new_evidence' FROM rr
      UNION ALL SELECT 'quote_mismatch' FROM pp WHERE (contains(text, '"') OR contains(lower(text), 'according to')) AND NOT links AND NOT facets
      UNION ALL SELECT 'time_inconsistency' FROM pp WHERE epoch_us(TRY_CAST({sql.FIRST_DATE} AS DATE)) > us
      UNION ALL SELECT 'assertiveness_increase_possible' FROM aa WHERE sure - prior.s >= 0.2 AND hash = prior.h) SELECT label, count(*) AS n FROM x GROUP BY label""",
    "link_domains": rf"""WITH {_TEXTS}, u AS (SELECT seq, unnest(regexp_extract_all(text, 'https?://\S+')) AS u FROM t),
      h AS (SELECT seq, regexp_replace(regexp_extract(lower(u), '^https?://([^/?#:]*)', 1), '^www\.', '') AS domain FROM u)
      SELECT domain, count(DISTINCT seq) AS posts FROM h WHERE domain <> '' GROUP BY domain""",
    "claim_collisions": f"""WITH {CLAIMS}, b AS (SELECT fp, count(DISTINCT post_uri) AS n FROM claims WHERE post_uri IS NOT NULL GROUP BY fp)
      SELECT CAST(sum(n) AS BIGINT) AS inputs, count(*) AS fps, round(1.0 - CAST(count(*) AS DOUBLE) / sum(n), 6) AS collision_rate, max(n) AS largest, quantile_disc(n, 0.95) AS p95 FROM b""",
    "quote_mismatch": rf"""WITH {_FIRST} SELECT uri AS subject_uri, 'quote_mismatch' AS label, CAST(0.55 AS DOUBLE) AS score FROM f
      WHERE (contains(text, '"') OR contains(lower(text), 'according to')) AND NOT regexp_matches(text, 'https?://\S')""",
    "asof_prior": f"""WITH {CLAIMS}, c AS (SELECT author, fp, ts, seq FROM claims WHERE ts IS NOT NULL AND author IS NOT NULL)
      SELECT a.seq, arg_max(b.seq, (b.ts, b.seq)) AS prior_seq FROM c a JOIN c b ON a.author = b.author AND a.fp = b.fp AND b.ts < a.ts GROUP BY a.seq""",
    "edges_degree": "WITH e AS (SELECT author_did AS src, nullif(regexp_extract(reply_parent_uri, '^at://(did:[^/]*)', 1), '') AS dst FROM posts) SELECT dst, count(*) AS replies, count(DISTINCT src) AS accounts FROM e WHERE dst IS NOT NULL AND src <> dst GROUP BY dst",
    "top_authors": "SELECT author, count(*) AS events FROM post_events WHERE author IS NOT NULL GROUP BY author ORDER BY events DESC, author LIMIT 20",
    "unlabeled_antijoin": "SELECT post_uri AS uri, seq FROM claim_history c WHERE post_uri IS NOT NULL AND NOT EXISTS (SELECT 1 FROM posts p WHERE p.uri = c.post_uri)",
    "label_reconcile": """WITH c AS (SELECT DISTINCT post_uri AS subject, evidence_class AS label, provenance = 'jetstream' AS want FROM claim_history WHERE post_uri IS NOT NULL AND provenance IS NOT NULL),
      b AS (SELECT subject, label, bool_or(want) AS w, bool_or(NOT want) AS h FROM c GROUP BY ALL)
      SELECT CASE WHEN w AND h THEN 'keep' WHEN w THEN 'insert' ELSE 'expire' END AS action, count(*) AS n FROM b GROUP BY 1""",
    "event_versions": """WITH e AS (SELECT *, coalesce(json_extract_string(raw, '$.cid'), '') AS c FROM post_events WHERE event_uri IS NOT NULL),
      w AS (SELECT row_number() OVER o AS i, lag(c) OVER o AS b, c FROM e WINDOW o AS (PARTITION BY event_uri ORDER BY ctime, event_no))
      SELECT CASE WHEN i = 1 THEN 'inserted' WHEN b = c THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM w GROUP BY 1""",
}
