"""Problem 5: one batch, many batches and a replay give the same; against a plain loop."""

import random
from datetime import datetime, timedelta

from claimscope.streaming import late_events as le

T0 = datetime(2023, 11, 1)
US = timedelta(microseconds=1)


def feed(n=240, seed=5):
    rng = random.Random(seed)
    posts, events = [], []
    for i in range(n):
        at = T0 + timedelta(minutes=rng.randrange(3000), microseconds=rng.randrange(10**6))
        posts.append((i, f"u{i}", at.isoformat() + "Z" if rng.random() < 0.95 else "n/a", None))
        for _ in range(rng.choice([1, 1, 2, 3])):
            events.append([len(events), f"u{i}", at + timedelta(minutes=rng.choice([0, 30, 4000, 4319, 4321, 9000])), rng.choice([None, "a", "b"]), f"f{rng.randrange(5)}"])
    rng.shuffle(events)
    return posts, [(i, *e[1:]) for i, e in enumerate(events)]


def expected(posts, events):
    at = {u: datetime.fromisoformat(c[:-1]) for _, u, c, _ in posts if c != "n/a"}
    first = {}
    for e in events:
        first[e[1]] = min(first.get(e[1], e), e, key=lambda e: (e[2], e[0]))
    out = {}
    for u, e in first.items():
        if u in at and e[2] - at[u] <= timedelta(hours=72):
            hour = int((at[u] - datetime(1970, 1, 1)).total_seconds()) // 3600 * 3600
            n, authors = out.setdefault((e[4], hour), [0, set()])
            out[e[4], hour][0] += 1
            authors |= {e[3]} - {None}
    return sorted((f, h, n, len(a)) for (f, h), (n, a) in out.items())


EVENTS = "event_no long, event_uri string, ctime timestamp_ntz, author string, claim_fingerprint string"


def late_ones(posts, events):
    at = {u: datetime.fromisoformat(c[:-1]) for _, u, c, _ in posts if c != "n/a"}
    return sorted(e[0] for e in events if e[1] in at and e[2] - at[e[1]] > timedelta(hours=72))


def test_batches_agree(spark, tmp_path):
    """One batch and eight give the same totals and the same late deliveries, and so does a driver that goes on in the folder."""
    posts, events = feed()
    instants = le.event_instants(spark.createDataFrame(posts, "seq long, uri string, created_at string, client_zone string"))
    for parts in (1, 8):
        folder, state = str(tmp_path / f"feed{parts}"), str(tmp_path / f"state{parts}")
        for k in range(parts):
            spark.createDataFrame(events[k::parts], EVENTS).coalesce(1).write.mode("append").parquet(folder)
        counts = le.HourlyCounts(spark, instants, buckets=4, folder=state).run(folder, files_per_batch=1 if parts > 1 else None)
        assert sorted(map(tuple, counts.current().collect())) == expected(posts, events)
        assert sorted(r.event_no for r in counts.late().collect()) == late_ones(posts, events)
        more = [(9000, "u0", T0, "z", "f9"), (9001, "u1", T0 + timedelta(days=30), "z", "f9")]
        spark.createDataFrame(more, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        again = le.HourlyCounts(spark, instants, buckets=4, folder=state).run(folder)
        assert len(again.batches) >= 2
        assert sorted(map(tuple, again.current().collect())) == expected(posts, events + more)
        assert sorted(r.event_no for r in again.late().collect()) == late_ones(posts, events + more)


def test_state_goes_with_the_watermark(spark, tmp_path):
    """Behind the watermark an event's state is gone: what still comes in time for its event is diverted, not counted twice."""
    instants = spark.createDataFrame([("u", 0), ("v", 200 * 24 * le.HOUR)], "event_uri string, event_us long")
    folder = str(tmp_path / "feed")
    start = datetime(1970, 1, 1)
    for k, (uri, day) in enumerate([("u", 1), ("v", 200), ("v", 201), ("u", 2)]):
        spark.createDataFrame([(k, uri, start + timedelta(days=day), "a", "f")], EVENTS).coalesce(1).write.mode("append").parquet(folder)
        counts = le.HourlyCounts(spark, instants, disorder_days=1, buckets=2, folder=str(tmp_path / "state")).run(folder)
    assert sorted(map(tuple, counts.current().collect())) == [("f", 0, 1, 1), ("f", 200 * 86400, 1, 1)]
    assert [(r.event_no, r.outcome) for r in counts.late().collect()] == [(3, "behind")]


def test_differences_and_single_file(spark, tmp_path):
    right = spark.createDataFrame([("a", 0, 2, 1), ("b", 0, 1, 1), ("c", 0, 1, 0)], "fingerprint string, hour_epoch long, event_count long, unique_authors long")
    published = spark.createDataFrame([("a", 0, 2, 1), ("b", 0, 2, 1), ("d", 0, 1, 1)], right.schema)
    assert sorted(map(tuple, le.differences(right, published).collect())) == [("b", 0), ("c", 0), ("d", 0)]
    spark.createDataFrame([(1, "u", T0, "x", "f"), (2, None, T0, "x", "f"), (3, "u", None, "x", "f")], EVENTS).coalesce(1).write.parquet(str(tmp_path / "one"))
    file = next((tmp_path / "one").glob("part-*.parquet"))
    instants = spark.createDataFrame([("u", 1698796800000000)], "event_uri string, event_us long")
    counts = le.HourlyCounts(spark, instants, folder=str(tmp_path / "s")).run(str(file))
    assert list(map(tuple, counts.current().collect())) == [("f", 1698796800, 1, 1)]
    assert le.HourlyCounts(spark, instants).current().count() == 0
