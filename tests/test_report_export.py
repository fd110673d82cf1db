"""The report and the export cycle on the smallest tables; helpers on rows made by hand."""

import json

from pyspark.sql import functions as F

from claimscope import cli
from claimscope.operators import cluster, export, report
from claimscope.plans import cluster_queries


def test_report_and_summary(spark, tiny):
    claims, decisions = cluster_queries.claims(spark, tiny), cluster_queries.decisions(spark, tiny)
    got = report.cluster_report(claims, decisions, cluster_queries.AS_OF, report.ReportConfig(hours=120, top=7))
    again = report.cluster_report(claims, decisions, cluster_queries.AS_OF, report.ReportConfig(hours=120, top=7))
    assert got == again and json.dumps(got, default=str)
    assert 0 < len(got["clusters"]) + len(got["automation"]) <= 7 and len(got["detections"]) <= 100
    assert sum(k["posts"] for k in got["kinds"].values()) == got["posts"]
    assert all(d["receipt_hash"] and d["det_id"] for d in got["detections"])
    assert f"{got['posts']} claims" in report.summary(got)
    empty = report.cluster_report(claims.limit(0), decisions.limit(0), cluster_queries.AS_OF)
    assert empty["clusters"] == [] and {d["type"] for d in empty["detections"]} == {"sensor_skipped"}


def test_export_in_two_cycles_equals_one(spark, tiny, tmp_path):
    claims, actors = cluster_queries.claims(spark, tiny), spark.read.parquet(f"{tiny}/actor_identity.parquet")
    half = claims.agg(F.max("seq")).first()[0] // 2
    export.export_cycle(spark, claims.where(F.col("seq") <= half), actors, str(tmp_path / "two"), cluster_queries.AS_OF, days=400)
    two = export.export_cycle(spark, claims, actors, str(tmp_path / "two"), cluster_queries.AS_OF, days=400)
    one = export.export_cycle(spark, claims, actors, str(tmp_path / "one"), cluster_queries.AS_OF, days=400)
    assert one == two
    for name in ("uri_fingerprint", "fingerprint_hourly", "fingerprint_bounds", "actor_identity_facts"):
        a, b = (export.read(spark, str(tmp_path / k), name) for k in ("one", "two"))
        assert a.count() > 0 and a.exceptAll(b.select(a.columns)).count() == b.select(a.columns).exceptAll(a).count() == 0
    assert export.read(spark, str(tmp_path / "one"), "uri_fingerprint").count() == cluster.uri_map(claims).count()


def test_helpers(spark):
    nums = spark.createDataFrame([(v,) for v in (5, 1, 4, 2)], "v long")
    assert report.upper_median(nums, "v").first()[0] == 4 and report.upper_median(nums.limit(0), "v").first()[0] is None
    kinds = spark.createDataFrame([("a", "x")] * 9 + [("b", None)], "fp string, fp_kind string")
    assert {(r.fp_kind, r.pct, r.canary) for r in report.kind_shares(kinds).collect()} == {("x", 90.0, False), ("unknown", 10.0, True)}
    ids = spark.range(100)
    assert report.sampled(ids, "id", 5).collect() == report.sampled(ids.repartition(7), "id", 5).collect()
    t = lambda s: spark.createDataFrame(s, "did string, c string").select("did", F.col("c").cast("timestamp").alias("created"))
    got = report.mismatches(t([("a", "2024-01-01"), ("b", "2024-01-01"), ("c", "2024-01-01"), ("d", None)]), t([("a", "2024-01-01"), ("b", "2024-01-01 05:00:00"), ("c", None), ("d", "2024-01-01"), ("e", "2024-01-01")]))
    assert {(r.kind, r.n) for r in got.collect()} == {("match", 1), ("same_day", 1), ("not_checked", 1), ("not_held", 1)}


def test_drift_command(spark, tmp_path):
    rows = [{"uri": "u1", "text": "The harbour office, according to Rossi, closed 431 berths.", "createdAt": "2025-02-01T08:00:00", "authorDid": "a", "replyRootUri": "r"},
            {"uri": "u2", "text": "It is closed: 431 berths.", "createdAt": "2025-02-01T09:00:00", "authorDid": "a", "replyRootUri": "r"}]
    (tmp_path / "posts.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    assert cli.main(["drift", str(tmp_path / "posts.jsonl"), "--out", str(tmp_path / "labels")]) == 0
    lines = [json.loads(line) for f in (tmp_path / "labels").glob("part-*") for line in f.read_text().splitlines()]
    assert ("u2", "provenance_laundering_possible", "u1") in {(x["subject_uri"], x["label"], x["evidence"][0].get("prior")) for x in lines}
