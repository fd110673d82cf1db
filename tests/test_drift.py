"""The five rules on hand-written threads, the as-of join, and block-wise first hits."""

import json
import random
import re

from pyspark.sql import functions as F

from claimscope.functions import claim_text as ct
from claimscope.operators import drift, lifecycle
from claimscope.plans import text_queries

POST = "uri string, author string, root string, ts timestamp, text string"


def posts(spark, rows):
    df = spark.createDataFrame(rows, "uri string, author string, root string, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    zero = F.lit(0)
    return df.select("*", zero.alias("n_links"), zero.alias("n_embeds"), zero.alias("n_facets"), F.lit("e").alias("evidence_hash"), ct.fingerprint(F.col("text"))["fp"].alias("fp"))


THREAD = [
    ("p1", "ann", "p1", "2025-01-31 10:00:00", "According to source X, 2025-02-01 is when event H happened."),
    ("p2", "ann", "p1", "2025-01-31 11:00:00", "2025-02-01 it happened. Definitely confirmed."),
    ("p3", "ann", "p1", "2025-01-31 12:00:00", "I heard this is true"),
    ("p4", "bob", "p4", "2025-01-31 12:05:00", '"New study says 1000 cases" - but no link'),
    ("p5", "ann", "p1", "2025-01-31 13:00:00", "This is a repeat claim: event H occurred"),
]


def test_thread_gives_the_known_labels(spark):
    p = posts(spark, THREAD)
    lines = [json.loads(r.value) for r in drift.label_lines(drift.all_rules(p, p)).collect()]
    got = [(x["subject_uri"], x["label"], x["score"], x["evidence"][0].get("prior"), x["evidence"][0].get("date_mentioned")) for x in lines]
    assert got == [
        ("p1", "quote_mismatch", 0.55, None, None), ("p1", "repeat_claim_no_new_evidence", 0.6, "p5", None), ("p1", "time_inconsistency", 0.4, None, "2025-02-01"),
        ("p2", "provenance_laundering_possible", 0.9, "p1", None), ("p2", "repeat_claim_no_new_evidence", 0.6, "p1", None), ("p2", "time_inconsistency", 0.4, None, "2025-02-01"),
        ("p4", "quote_mismatch", 0.55, None, None), ("p5", "provenance_laundering_possible", 0.9, "p1", None), ("p5", "repeat_claim_no_new_evidence", 0.6, "p1", None),
    ]
    assert list(lines[1]) == sorted(lines[1])


def test_surer_on_the_same_evidence(spark):
    p = posts(spark, [("a1", "ann", "r", "2025-01-01 10:00:00", "I think maybe 10 cases occured."), ("a2", "ann", "r", "2025-01-01 10:10:00", "Confirmed: 10 cases occured.")])
    got = drift.assertiveness_increase(p, p).select("subject_uri", "prior_uri").collect()
    assert [tuple(r) for r in got] == [("a2", "a1")]


def alike(q, p):
    q, p = (x.lower().replace("\n", " ").strip() for x in (q, p))
    return q in p or p in q or any(len(w) > 4 and w in p for w in q.split())


def test_latest_comparable_equals_a_backward_scan(spark):
    rng = random.Random(1)
    words = ["", "ok", "no", "a b", "happen", "happened", "rivers", "river", "old dam", "the", "x", "Dam broke", "broken", "!"]
    rows = [(f"u{i:03d}", "hot" if i < 120 else f"a{i % 7}", "r", f"2025-01-01 10:{i % 50:02d}:00", " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(200)]
    p = posts(spark, rows)
    got = {r.subject_uri: r.prior_uri for r in drift.repeated_claims(p).collect()}
    ts = {u: (at, u) for u, _, _, at, _ in rows}
    for before in (False, True):
        want = {}
        for u, a, _, at, t in rows:
            hits = [v for v, b, _, then, x in rows if b == a and v != u and alike(x, t) and (not before or then < at)]
            if hits:
                want[u] = max(hits, key=ts.get)
        if before:
            group = ["author"]
            got = {r.uri: r.prior for r in drift.latest_match(*drift.comparable_keys(p, p, group), group, True).collect()}
        assert got == want and len(want) > 100


def joins_of_plans(monkeypatch, rows):
    """The joins of each plan that runs on the way to the rows, and those of the last."""
    joins, kept = [], drift.stored
    count = lambda df: joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or df
    monkeypatch.setattr(drift, "stored", lambda df: kept(count(df)))
    count(rows())
    return joins


def test_no_plan_of_all_rules_has_many_joins(spark, monkeypatch):
    """A plan is optimised anew, as a whole, whenever one of its stages ends, so the driver's memory grows with its joins."""
    p = posts(spark, THREAD)
    joins = joins_of_plans(monkeypatch, lambda: drift.all_rules(p, p))
    assert len(joins) > 5 and max(joins) <= 3


def test_no_plan_of_laundering_has_many_joins(spark, monkeypatch):
    """Threads and history alike: the second post of a claim is found by its author's history, the other in the thread."""
    rows = [("h1", "ann", "h1", "2025-01-01 10:00:00", "According to X the dam broke"), ("h2", "ann", "h2", "2025-01-02 10:00:00", "the dam broke"),
        ("t1", "bob", "t", "2025-01-01 10:00:00", "According to Y rivers rose"), ("t2", "bob", "t", "2025-01-01 09:00:00", "rivers rose")]
    p = posts(spark, rows).withColumn("fp", F.col("author"))
    found = []
    joins = joins_of_plans(monkeypatch, lambda: found.append(drift.provenance_laundering(p, p)) or found[0])
    assert len(joins) > 5 and max(joins) <= 3
    assert sorted((r.subject_uri, r.prior_uri) for r in found[0].collect()) == [("h2", "h1"), ("t2", "t1")]


def test_exploded_rows_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Few texts become many grams or keys, whose number Spark doesn't foresee when it chooses what goes through the driver."""
    few = [(f"u{i}", "g", f"2025-01-0{i + 1}", "the dam broke " * 20) for i in range(3)]
    many = [(f"v{i}", "g", "2025-01-01", f"word{i}" * 9) for i in range(3000)] + [("v", "g", "2025-01-01", "dam broke")]
    for name, rows in (("few", few), ("many", many)):
        spark.createDataFrame(rows, "uri string, author string, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/{name}")
    few, many = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("few", "many"))
    plans, kept = [], drift.stored
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(drift, "stored", lambda df: kept(plan(df)))
    held = plan(drift.holding(few, many.withColumnRenamed("text", "key"), ["author"]))
    words = few.select("uri", "ts", "author", F.explode(F.split("text", " ")).alias("key"))
    met = plan(drift.latest_match(many.withColumn("key", F.lit("dam")), words, ["author"]))
    assert {(r.uri, r.key) for r in held.collect()} == {(f"u{i}", "dam broke") for i in range(3)}
    assert met.count() == 3001 and {r.prior for r in met.select("prior").distinct().collect()} == {"u2"}
    for lines in map(str.splitlines, plans):
        depth = [re.search(r"[A-Z*]", x).start() if re.search(r"[A-Z*]", x) else 0 for x in lines]
        for i, x in enumerate(lines):
            if "BroadcastExchange" in x:
                below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
                assert not any("Generate" in y for y in lines[i:below])


def test_hot_keys_in_slices_give_the_same(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", rng.randrange(900), rng.choice("abc")) for i in range(1500)]
    df = spark.createDataFrame([*rows, (1500, None, 5, "a"), (1501, None, 6, "a")], "seq int, fp string, s long, author string").withColumn("ts", F.timestamp_seconds("s"))
    for f in (
        lambda hot: drift.asof_prior(df.select("fp", "ts", "seq"), df.select("fp", "ts", F.col("seq").alias("other")), ["fp"], hot).select("seq", "prior.other"),
        lambda hot: lifecycle.second_authors(df, 60, hot).select("seq", "passes"),
        lambda hot: lifecycle.versions(df, "fp", F.col("s"), ["s", "seq"], F.col("author"), hot).select("seq", "outcome"),
    ):
        plain, cut = (sorted(map(tuple, f(hot).collect()), key=str) for hot in (10**6, 40))
        assert plain == cut and len(plain) == 1502 and len({r[1] for r in plain}) > 1


def test_asof_is_strictly_before(spark):
    left = spark.createDataFrame([(1, "k", 10), (2, "k", 20), (3, "k", 5), (4, None, 9)], "id int, key string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    right = spark.createDataFrame([("k", 10, "x"), ("k", 5, "w"), ("k", 10, "y"), ("z", 1, "q")], "key string, s long, v string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = {r.id: r.prior and r.prior.v for r in drift.asof_prior(left, right, ["key"]).collect()}
    assert got == {1: "w", 2: "y", 3: None, 4: None}


def test_reconcile_and_anti_join(spark):
    want = spark.createDataFrame([("s1", "a"), ("s1", "b"), ("s1", "b")], "subject string, label string")
    have = spark.createDataFrame([("s1", "b"), ("s2", "c")], "subject string, label string")
    assert sorted(map(tuple, drift.reconcile(want, have).collect())) == [("s1", "a", "insert"), ("s1", "b", "keep"), ("s2", "c", "expire")]
    subjects, labels = spark.createDataFrame([("s1",), ("s9",)], "uri string"), spark.createDataFrame([("s1",), (None,)], "subject_uri string")
    assert [r[0] for r in drift.unlabeled(subjects, labels).collect()] == ["s9"]


def test_empty(spark):
    p = posts(spark, THREAD).limit(0)
    assert drift.all_rules(p, p).count() == 0


def test_evidence_and_history_come_from_the_claims(spark, tmp_path):
    said = {"a1": "I think maybe 10 cases occured.", "a2": "Confirmed: 10 cases occured.", "b1": "I think maybe 10 cases occured.", "b2": "Confirmed: 10 cases occured.", "c1": '"quoted" with a facet', "c2": '"quoted" without'}
    at = {u: f"2025-01-01T10:{i:02d}:00Z" for i, u in enumerate(said)}
    spark.createDataFrame([(i, u, x, u[0], at[u], None, None if u[0] != "a" else "r") for i, (u, x) in enumerate(said.items())],
        "seq long, uri string, text string, author_did string, created_at string, client_zone string, reply_root_uri string").write.parquet(f"{tmp_path}/posts.parquet")
    claims = [("a", "F", "a1", None, "none"), ("a", "f", "a2", "e2", "embed"), ("b", "g", "b1", "e", "link"), ("b", "G", "b2", "old", "none"), ("b", "g", "b2", "e", "link"), ("c", "h", "c1", "e3", "facet")]
    spark.createDataFrame([(i, a, f, at[u], h, u, k, "text", "jetstream", 0.5) for i, (a, f, u, h, k) in enumerate(claims)],
        "seq long, author_did string, claim_fingerprint string, created_at string, evidence_hash string, post_uri string, evidence_class string, fp_kind string, provenance string, confidence double"
    ).withColumn("observed_at", F.lit("2025-01-01 12:00:00").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/claim_history.parquet")
    p = text_queries.posts(spark, str(tmp_path))
    flags = {r.uri: (r.n_links, r.n_embeds, r.n_facets, r.evidence_hash, r.fp) for r in p.collect()}
    assert flags["a2"] == (0, 1, 0, "e2", "f") and flags["b2"] == (1, 0, 0, "e", "g") and flags["c1"] == (0, 0, 1, "e3", "h") and flags["a1"] == (0, 0, 0, "", "f")
    # a2 has new evidence, b2 has that of its prior; c1 has a facet
    surer = drift.assertiveness_increase(p, text_queries.history(spark, str(tmp_path), p))
    got = {(r.subject_uri, r.rule_id, r.prior_uri) for r in surer.unionByName(drift.quote_mismatch(p)).collect()}
    assert got == {("b2", "assertiveness_increase", "b1"), ("c2", "quote_mismatch", None)}
