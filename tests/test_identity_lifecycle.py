"""Accounts, strata, queues, versions, and files."""

import json
from datetime import date

from pyspark.sql import functions as F

from claimscope.operators import identity, lifecycle
from claimscope.sources import files


def test_vintages(spark):
    days = ["2023-04-23", "2023-04-24", "2023-07-23", "2023-07-24", "2026-04-20", None]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(identity.vintage_index(F.col("d").cast("timestamp")).alias("i"))
    got = df.select("i", identity.vintage_label(F.col("i"))).collect()
    assert [r[0] for r in got] == [0, 1, 1, 2, 13, -1]
    assert [r[1] for r in got] == ["v0_pre_2023-04-24", "v1_2023-04-24_to_2023-07-24", "v1_2023-04-24_to_2023-07-24", "v2_2023-07-24_to_2023-10-23", "v13_post_2026-04-20", "v_unknown"]


def test_resolver_batch_and_write_back(spark):
    now, h = 10**15, 3_600_000_000
    rows = [("a", None, 0, 5), ("b", "ok", now - 25 * h, 1), ("c", "ok", now - 23 * h, 1), ("d", "error", now - h, 3), ("e", "not_found", now - 100 * h, 1), ("f", "not_found", now - 200 * h, 2), ("g", None, None, 4)]
    df = spark.createDataFrame(rows, "did string, resolver_status string, attempt_us long, first_seen_at long")
    assert [r.did for r in identity.resolver_batch(df, now).collect()] == ["g", "a", "b", "f", "d"]
    acts = spark.createDataFrame([("a", "h1", None, None, None, "live")], "did string, handle string, pds_host string, resolver_status string, success_us long, identity_source string")
    res = spark.createDataFrame([("a", 9, "ok", "h2", "p"), ("a", 8, "error", None, None), ("z", 9, "not_found", None, None)], "did string, at_us long, status string, handle string, pds_host string")
    got = {r.did: tuple(r)[1:] for r in identity.written_back(acts, res).collect()}
    assert got == {"a": ("h1", "p", "ok", 9, "live"), "z": (None, None, "not_found", None, "live")}


def test_vintage_write_once(spark):
    acts = spark.createDataFrame([("a", None), ("b", 5)], "did string, did_created_at long")
    found = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9)], "did string, created long")
    get = lambda repair: {r.did: (r.did_created_at, r.outcome) for r in identity.vintages(acts, found, repair).collect()}
    assert get(False) == {"a": (7, "written"), "b": (5, "skipped_existing"), "c": (None, "skipped_missing_row")}
    assert get(True)["b"] == (8, "repaired")


def test_collapse_midpoints_and_quarters(spark):
    rows = [("s", date(2024, 1, 1), date(2024, 1, 22)), ("s", date(2024, 2, 5), date(2024, 3, 4)), ("s", date(2024, 6, 3), date(2024, 6, 24)), ("t", date(2024, 1, 8), date(2024, 2, 5))]
    got = identity.collapsed_changes(spark.createDataFrame(rows, "shard string, from_week date, to_week date"))
    assert {(r.shard, str(r.midpoint), r.merged) for r in got.collect()} == {("s", "2024-02-01", 2), ("s", "2024-06-13", 1), ("t", "2024-01-22", 1)}
    assert sorted(str(r[0]) for r in identity.kept_midpoints(got).collect()) == ["2024-01-22", "2024-06-13"]
    span = spark.createDataFrame([(date(2023, 1, 23), date(2023, 7, 31)), (date(2023, 1, 1), date(2023, 1, 1))], "first date, last date")
    assert [str(r[0]) for r in identity.quarterly(span).collect()] == ["2023-04-24", "2023-07-24", "2023-10-23"]


def test_queues_versions_and_gate(spark):
    q = lifecycle.queue(spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("c", 9)], "fp string, scheduled_at long"), ["fp"])
    taken, rest = lifecycle.dequeued(q, ["fp"], 2)
    assert [r.fp for r in taken.collect()] == ["a", "b"] and [r.fp for r in rest.collect()] == ["c"]
    assert sorted(r.fp for r in lifecycle.trimmed_queue(q, ["fp"], 2, 1).collect()) == ["c"] and lifecycle.trimmed_queue(q, ["fp"], 3, 1).count() == 3
    v = spark.createDataFrame([("u", 1, "x"), ("u", 2, "x"), ("u", 3, "y"), ("u", 4, "x"), ("w", 1, None)], "uri string, t int, raw string")
    assert sorted((r.uri, r.t, r.outcome) for r in lifecycle.versions(v, "uri", F.col("t"), ["t"], F.col("raw")).collect()) == [("u", 1, "inserted"), ("u", 2, "unchanged"), ("u", 3, "updated"), ("u", 4, "updated"), ("w", 1, "inserted")]
    rows = [("f", "a", 0, 1), ("f", "a", 10, 2), ("f", "b", 20, 3), ("f", "b", 3700, 4), ("f", "a", 3800, 5), ("f", "a", 9000, 6)]
    df = spark.createDataFrame(rows, "fp string, author string, s long, seq long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.seq: r.passes for r in lifecycle.second_authors(df).collect()} == {1: False, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_archive_snapshot_and_hours(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2023-10-01 05:00:00"), (2, "2023-10-01 06:00:00"), (3, "2023-11-04 00:00:00"), (4, None)], "seq long, t string").select("seq", F.col("t").cast("timestamp").alias("ts"))
    stays, n = lifecycle.archive(rows, str(tmp_path / "old"), "2023-11-05 00:00:00", 14)
    assert n == 2 and sorted(r.seq for r in stays.collect()) == [3, 4] and list((tmp_path / "old").glob("day=2023-10-01/*.json.gz"))
    assert files.snapshot(rows, str(tmp_path / "snap")) == 4 and files.snapshot(rows.limit(1), str(tmp_path / "snap")) == 1
    snap = str(tmp_path / "snap")
    assert files.read_snapshot(spark, snap).count() == 1 and files.read_snapshot(spark, str(tmp_path / "none")) is None
    (tmp_path / "snap" / "v3").mkdir()  # a crash before the switch leaves the version before in place
    assert files.read_snapshot(spark, snap).count() == 1
    held = files.read_snapshot(spark, snap)
    assert files.snapshot(rows.limit(2), snap) == 2 and held.count() == 1 and files.read_snapshot(spark, snap).count() == 2
    assert [p.name for p in (tmp_path / "snap").glob("current=*")] == ["current=3"]
    roll = lambda *r: spark.createDataFrame(r, "fingerprint string, hour_epoch long, event_count long")
    files.overwrite_hours(roll(("a", 3600, 1), ("b", 7200, 2)), str(tmp_path / "hours"))
    files.overwrite_hours(roll(("c", 7200, 9)), str(tmp_path / "hours"))
    assert sorted((r.fingerprint, r.event_count) for r in spark.read.parquet(str(tmp_path / "hours")).collect()) == [("a", 1), ("c", 9)]


def test_did_documents_and_logs(spark):
    doc = json.dumps({"alsoKnownAs": ["at://ann.example"], "service": [{"id": "#atproto_pds", "type": "AtprotoPersonalDataServer", "serviceEndpoint": "https://pds1.example:443/"}]})
    raw = spark.createDataFrame([("a", 200, doc), ("b", 404, None), ("c", 500, ""), ("d", 200, "{oops")], "did string, http_status int, body string")
    got = {r.did: (r.status, r.handle, r.pds_host) for r in files.did_documents(raw).collect()}
    assert got["a"] == ("ok", "ann.example", "pds1.example") and got["b"][0] == "not_found" and got["c"][0] == got["d"][0] == "error"
    logs = spark.createDataFrame([("a", '[{"createdAt":"2023-05-01T00:00:00Z"},{"createdAt":"2024-01-01T00:00:00Z"}]'), ("b", "[]"), ("c", None)], "did string, body string")
    assert [r.created is not None for r in files.genesis_time(logs).orderBy("did").collect()] == [True, False, False]


def test_expiry_and_budgets(spark):
    labels = spark.createDataFrame([(1, "2023-09-01", None), (2, "2023-11-01", None), (3, "2023-09-01", "2023-09-02")], "i int, c string, e string").select("i", F.col("c").cast("timestamp").alias("ctime"), F.col("e").cast("timestamp").alias("expired_at"))
    assert [str(r.expired_at)[:10] for r in lifecycle.expired(labels, "2023-11-05").orderBy("i").collect()] == ["2023-11-05", "None", "2023-09-02"]
    dec = spark.createDataFrame([("r", "2023-11-01"), ("r", "2023-11-02"), ("q", "2023-11-02"), ("r", "2023-01-01")], "rule_id string, t string").select("rule_id", F.col("t").cast("timestamp").alias("ts"))
    got = lifecycle.budget_counts(dec, spark.createDataFrame([("r", 1)], "rule_id string, budget long"), "2023-10-01")
    assert {(r.rule_id, r.n, r.exceeded) for r in got.collect()} == {("r", 2, True), ("q", 1, False)}


def test_fields_reduced_in_order_of_arrival(spark):
    cols = "row_no long, did string, time_us long, has_handle boolean, handle string, has_active boolean, active boolean, observed_at string"
    rows = [
        (1, "a", 10, True, "x", False, None, "2023-01-03"), (2, "a", 5, True, "old", True, False, "2023-01-01"), (3, "a", 10, False, None, True, None, "2023-01-02"), (4, "a", 20, True, None, False, None, "2023-01-04"),
        (5, "b", 7, False, None, False, None, "2023-01-01"), (6, "c", 9, True, "c1", True, False, "2023-01-01"), (7, "c", 9, True, "c2", True, True, "2023-01-01"), (8, None, 1, True, "z", False, None, "2023-01-01"), (9, "d", None, True, "z", True, False, "2023-01-05"),
    ]
    df = spark.createDataFrame(rows, cols).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    for hot in (10**6, 1):
        got = {r.did: (r.handle, r.is_active, str(r.first_seen_at)[:10], str(r.last_seen_at)[:10], r.last_time_us, r.events) for r in identity.reduced(df, hot).collect()}
        assert got == {"a": (None, False, "2023-01-01", "2023-01-04", 20, 4), "b": (None, True, "2023-01-01", "2023-01-01", 7, 1), "c": ("c2", True, "2023-01-01", "2023-01-01", 9, 2), "d": (None, True, "2023-01-05", "2023-01-05", None, 1)}
    assert identity.reduced(df.limit(0)).count() == 0


def test_families_hold_under_shifts(spark):
    e = lambda *rows: spark.createDataFrame(rows, "family string, bucket int, delta_pp double, clears boolean")
    base = e(("f", 1, 9.0, True), ("f", 2, 7.0, True), ("g", 1, -9.0, True), ("g", 2, -7.0, True), ("h", 1, 9.0, True))
    effects = {"base": base, "s1": base, "s2": base, "s3": base.where("family = 'f'"), "fresh": base, "both": e(("f", 1, 3.0, False), ("g", 1, 3.0, False))}
    got = {r.family: (r.buckets, r.shifts, r.fresh, r.with_both, r.holds) for r in identity.admissible_families(effects, ["s1", "s2", "s3"]).collect()}
    assert got == {"f": (2, 3, True, True, True), "g": (2, 2, True, False, False)}
