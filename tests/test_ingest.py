"""Messages to events, claims, edges and identity changes; streams equal batches."""

import json

from claimscope.operators import lifecycle
from claimscope.streaming import ingest
from pyspark.sql import functions as F


def commit(did, rkey, text, t, op="create", coll=ingest.POST, **record):
    return json.dumps({"did": did, "time_us": t, "kind": "commit", "commit": {"operation": op, "collection": coll, "rkey": rkey, "cid": f"c{t}", "record": {"text": text, "createdAt": "2023-11-01T00:00:00Z", **record}}})


MESSAGES = [
    commit("did:a", "1", "Ten thousand cases reported in Boston", 1, reply={"parent": {"uri": "at://did:b/x/1"}, "root": {"uri": "at://did:c/x/1"}}),
    commit("did:a", "1", "Ten thousand cases reported in Boston", 2),
    commit("did:a", "1", "Eleven thousand cases reported in Boston", 3, embed={"external": {"uri": "https://x.example/a?b"}}),
    commit("did:b", "2", "", 4, coll=ingest.REPOST, subject={"uri": "at://did:a/x/1"}),
    commit("did:b", "3", "look", 5, embed={"record": {"uri": "at://did:b/x/2"}}), commit("did:b", "4", "quoting them here now", 6, embed={"record": {"uri": "at://did:d/x/2"}}),
    commit("did:b", "5", "gone", 7, op="delete"), commit("did:b", "6", "other", 8, coll="app.bsky.feed.like"), "{broken", "", "[]", json.dumps({"kind": "commit"}),
    json.dumps({"did": "did:a", "kind": "identity", "time_us": 9, "identity": {"seq": 4, "handle": "ann.example"}}), json.dumps({"did": "did:a", "kind": "identity", "time_us": 10, "identity": {"seq": 5}}),
    json.dumps({"did": "did:a", "kind": "identity", "time_us": 11, "identity": {"handle": None}}), json.dumps({"did": "did:a", "kind": "account", "time_us": 12, "account": {"active": False}}), json.dumps({"kind": "account", "time_us": 12}),
]


def test_batch(spark):
    raw = spark.createDataFrame([(m,) for m in MESSAGES], "value string")
    events = ingest.commits(raw)
    assert [r.uri for r in events.orderBy("time_us").collect()] == [f"at://did:{x}" for x in (f"a/{ingest.POST}/1", f"a/{ingest.POST}/1", f"a/{ingest.POST}/1", f"b/{ingest.REPOST}/2", f"b/{ingest.POST}/3", f"b/{ingest.POST}/4")]
    assert {tuple(r)[:3] for r in ingest.edges_of(events).collect()} == {("did:a", "did:b", "reply"), ("did:b", "did:a", "repost"), ("did:b", "did:d", "quote")}
    claims = ingest.claims_of(events).orderBy("post_cid").collect()
    assert [(c.fp_kind, c.evidence_class) for c in claims] == [("entity", "none"), ("entity", "none"), ("entity", "mixed"), ("text", "embed"), ("text", "embed")] or len(claims) == 5
    ids = [(r.time_us, r.has_handle, r.handle, r.has_active, r.active) for r in ingest.identity_changes(raw).orderBy("time_us").collect()]
    assert ids == [(9, True, "ann.example", False, None), (10, False, None, False, None), (11, True, None, False, None), (12, False, None, True, False)]


def drained(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text("\n".join(MESSAGES[k * 2 : k * 2 + 2] if k < 2 else MESSAGES[4:]))
    raw = spark.createDataFrame([(m,) for m in MESSAGES], "value string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = ingest.messages(spark, str(folder), 1)
    want = lifecycle.versions(ingest.commits(raw), "uri", F.col("time_us"), ["time_us"], F.concat_ws("\x1f", "cid", "text")).select("uri", "outcome")
    got = drained(spark, ingest.versioned(ingest.commits(stream)), tmp_path, "versions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    hours = drained(spark, ingest.hourly(ingest.commits(ingest.messages(spark, str(folder), 1))), tmp_path, "hours", "complete")
    assert {r.kind: r.n for r in hours.collect()} == {"post": 5, "repost": 1}
    gate = drained(spark, ingest.gated(ingest.claims_of(ingest.commits(ingest.messages(spark, str(folder), 1)))), tmp_path, "gate")
    assert gate.count() == ingest.claims_of(ingest.commits(raw)).count()


def test_messages_are_written_once(spark, tmp_path):
    """Batches hold events, claims, edges and identity; a batch that is run again overwrites itself, one that isn't done doesn't count."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.txt").write_text("\n".join(MESSAGES[k * 6 : k * 6 + 6] if k == 0 else MESSAGES[6:]))
    ingest.ingest(ingest.messages(spark, str(folder), 1), out).trigger(availableNow=True).start().awaitTermination()
    raw = spark.createDataFrame([(m,) for m in MESSAGES], "value string")
    want = {"events": ingest.commits(raw), "claims": ingest.claims_of(ingest.commits(raw)), "edges": ingest.edges_of(ingest.commits(raw)), "identity": ingest.identity_changes(raw)}
    for name, df in want.items():
        assert ingest.read_ingested(spark, out, name).count() == df.count() > 0
    ingest.stored_batch(out)(raw.limit(6), 0)
    ingest.commits(raw).write.parquet(f"{out}/events/batch=99")
    assert ingest.read_ingested(spark, out, "events").count() == want["events"].count()
