"""Ledger, recheck, verdicts, retention and receipts on rows made by hand."""

from pyspark.sql import functions as F

from claimscope.functions import claim_text as ct
from claimscope.operators import detect, ledger, quality

AS_OF = "2023-11-05 00:00:00"


def posts(spark, rows):
    df = spark.createDataFrame(rows, "uri string, author string, root string, ts string, text string, fp string").withColumn("ts", F.col("ts").cast("timestamp"))
    return df.select("*", *(F.lit(0).alias(c) for c in ("n_links", "n_embeds", "n_facets")), F.lit("e").alias("evidence_hash"))


def test_recheck_inserts_keeps_expires_and_holds(spark):
    p = posts(spark, [
        ("p1", "ann", "p1", "2025-01-31 10:00:00", '"so they said"', "f"), ("p2", "bob", "p2", "2025-01-31 11:00:00", "by 2025-02-01 it is over", "f"),
        ("p3", "cid", "p3", "2025-01-31 11:00:00", "nothing here", "f"), ("p4", "dan", "p4", "2025-01-31 11:00:00", '"elsewhere"', "g"), ("p5", "eve", "p5", "2025-01-31 11:00:00", '"again"', "f"),
    ])
    label = "subject string, label string, rule_id string"
    active = spark.createDataFrame([("p3", "quote_mismatch", "quote_mismatch"), ("p2", "time_inconsistency", "time_inconsistency"), ("p4", "time_inconsistency", "time_inconsistency")], label)
    got = ledger.recheck(spark.createDataFrame([("f",), ("f",)], "fp string"), p, p, active, AS_OF, {"quote_mismatch": 1})
    assert {(r.subject, r.label, r.action) for r in got.actions.collect()} == {
        ("p1", "quote_mismatch", "insert"), ("p5", "quote_mismatch", "hold"), ("p2", "time_inconsistency", "keep"), ("p3", "quote_mismatch", "expire"),
    }
    assert {r.status for r in got.entries.collect()} == {"committed", "suppressed", "expired"}
    assert {(r.subject, r.label) for r in got.active.collect()} == {("p1", "quote_mismatch"), ("p2", "time_inconsistency"), ("p4", "time_inconsistency")}
    book = ledger.appended(ledger.appended(None, got.entries), got.entries)
    assert book.count() == 3
    later = ledger.entries(got.entries.where("status = 'committed'"), F.lit("expired"), "2023-11-06 00:00:00")
    assert {(r.subject, r.status) for r in ledger.standing(ledger.appended(book, later)).collect()} == {("p1", "expired"), ("p5", "suppressed"), ("p3", "expired")}
    empty = ledger.recheck(spark.createDataFrame([], "fp string"), p, p, active, AS_OF)
    assert empty.actions.count() == 0 and empty.active.count() == 3


def test_inserts_and_modes(spark):
    kind = "subject string, labeler string, json string"
    new = spark.createDataFrame([("s", "l", "{}"), ("s", "l", "{}"), ("s", "l", '{"a":1}')], kind)
    assert [r.json for r in ledger.unlabeled_inserts(new, new.limit(1)).collect()] == ['{"a":1}']
    assert [ledger.emit_mode(*x) for x in (("emit", True), ("emit", False), ("suppress", False), ("x", True))] == ["emit", "suppress", "suppress", "detect-only"]
    subjects = spark.createDataFrame([("a",), ("b",)], "uri string")
    offered = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "subject_uri string, label string")
    assert [r.subject_uri for r in ledger.ingested(subjects, offered.where("subject_uri = 'a'"), offered).collect()] == ["b"]


def test_majority_churn_and_verdict(spark):
    rows = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y"), ("h", "z")], "g string, v string")
    assert tuple(quality.majority(rows, "g", "v").first()) == (2, 4, 3, 0.75)
    before, after = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b"), (3, None)], [(1, "a"), (2, "c"), (3, "d"), (4, "e")]))
    assert tuple(quality.churn(before, after, "k", "v").first()) == (3, 2, 0.666667)
    measured = spark.createDataFrame([("churn", 0.1), ("collision_rate", 0.01), ("drift_emoji", 0.05), ("other", 1.0)], "measure string, value double")
    assert {r.measure: r.ok for r in quality.verdict(measured, quality.stability_limits()).collect()} == {"churn": True, "collision_rate": False, "drift_emoji": True}


def test_threads_pages_retention_and_receipts(spark):
    p = spark.createDataFrame([("a", None, None), ("b", "a", "a"), ("c", "a", "b"), ("a", None, None)], "uri string, reply_root_uri string, reply_parent_uri string")
    assert {(r.root, r.uri) for r in quality.threads(p).collect()} == {("a", "a"), ("a", "b"), ("b", "b"), ("a", "c"), ("b", "c"), ("c", "c")}
    e = spark.createDataFrame([(1, "2023-11-04 12:00:00", "r"), (2, "2023-11-01 00:00:00", "r"), (3, "2023-10-01 00:00:00", "r"), (4, None, "r")], "n int, t string, raw string").withColumn("t", F.col("t").cast("timestamp"))
    assert {(r.n, r.raw) for r in quality.retained(e, F.col("t"), AS_OF, 7, "raw").collect()} == {(1, "r"), (2, None), (4, None)}
    assert quality.newest(e, [F.desc("n")], 0).count() == 1 and quality.newest(e, [F.desc("n")], 9999).first().n == 4
    log = spark.createDataFrame([("r1", "start", 1, None), ("r1", "finish", 5, "done"), ("r2", "start", 2, "begun"), ("r2", "finish", 3, None)], "run_id string, kind string, at int, note string")
    assert {tuple(r) for r in quality.receipts(log).collect()} == {("r1", 1, 5, "done"), ("r2", 2, 3, "begun")}


def test_evidence_and_saved_baseline():
    assert detect.query_evidence("SELECT  1\n FROM t", [], "h") == detect.query_evidence("SELECT 1 FROM t", [], "h")
    assert detect.set_evidence(["b", "a"], 2) == detect.set_evidence(["a", "b"], 2) and len(detect.note_evidence("x" * 900)["ref"]) == 200
    w = {"ts_start": "a", "ts_end": "b", "window": "1h", "window_fingerprint": "w", "config_hash": "c"}
    d = {"detector_id": "x", "subject_type": "did", "subject_value": "v", "type": "t", "score": 1.0, "severity": "low"}
    assert detect.faults(detect.envelope(d, w, [detect.range_evidence("1", "2", 3)])) == []
    assert set(detect.faults(detect.envelope(d | {"severity": "dire", "subject_type": "planet"}, w))) == {"severity", "subject type", "evidence of a named window"}
    saved = detect.saved_health(dict(detect.HEALTH_START, baseline=8.0, seen=9), 100.0)
    assert detect.restored_health(saved, 200.0)["state"] == "ok" and detect.restored_health(saved, 200.0)["baseline"] == 8.0
    for bad in (None, saved | {"version": 2}, saved | {"baseline": 0.0}, saved | {"at": -5000.0}):
        assert detect.restored_health(bad, 200.0) == detect.HEALTH_START
    assert ct.DEFAULT.version == "v1"
