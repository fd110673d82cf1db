"""Envelopes, cooldown, sensors and the health machine, on traces worked out by hand."""

import random

import pytest

from claimscope.operators import cluster, detect
from pyspark.sql import functions as F


def run(windows, state=None):
    state, out = dict(state or detect.HEALTH_START), []
    for w in windows:
        state, row = detect.health_step(state, *w)
        out.append(row)
    return out


def good(n=1, eps=500, backlog=0, lag=0.0):
    return [(eps * 60, 60.0, backlog, 0, lag)] * n


def test_low_rate_degrades_and_freezes_the_baseline():
    rows = run(good(5) + good(3, eps=10) + good(1, eps=10))
    assert [r["state"] for r in rows[:5]] == ["warming_up"] * 4 + ["ok"] and rows[7]["state"] == "degraded" and rows[7]["reasons"] == "platform_low_eps"
    assert rows[7]["event"] == "platform_degraded" and rows[5]["baseline"] > rows[6]["baseline"] > rows[7]["baseline"] == rows[8]["baseline"]


def test_lag_drops_and_backlog():
    assert run(good(5) + good(3, lag=200.0))[-1]["reasons"] == "lag_high"
    assert run(good(5) + [(30000, 60.0, b, 0, 50.0) for b in (200, 400, 600)])[-1]["reasons"] == "consumer_backlog"
    assert run(good(5) + [(30000, 60.0, 0, 3000, 0.0)] * 3)[-1]["reasons"] == "high_drop_rate"


def test_recovery_recalibrates_first():
    rows = run(good(5) + good(3, lag=200.0) + good(6, backlog=100))
    # the first steady backlog comes one window after the jump to 100
    back = next(i for i, r in enumerate(rows) if r["event"] == "platform_recovered")
    assert rows[back]["state"] == "ok" and rows[back]["gated"]
    later = run(good(5) + good(3, lag=200.0) + good(6, backlog=100) + good(3, backlog=100))
    assert [r["gated"] for r in later[back : back + 3]] == [True, True, False]


def test_health_as_a_dataframe(spark):
    rows = [("s", i, 30000 if i < 5 else 600, 60.0, 0, 0, 0.0) for i in range(8)]
    df = spark.createDataFrame(rows, "stream string, window_no long, events_in long, window_secs double, backlog long, dropped long, lag_s double")
    got = [r.state for r in detect.health(df).orderBy("window_no").collect()]
    assert got == [r["state"] for r in run(good(5) + good(3, eps=10))]


def test_cooldown(spark):
    seen, _ = detect.cooldown_fold([(1, 1.0, "low"), (2, 1.2, "low"), (3, 1.6, "low"), (4, 1.6, "med"), (5, 1.6, "low"), (9, 1.6, "low")])
    assert seen == [True, False, True, True, False, True]
    df = spark.createDataFrame([("d", 2, 1.2, "low"), ("d", 1, 1.0, "low"), ("e", 2, 1.0, "info")], "det_id string, window_no long, score double, severity string")
    assert {(r.det_id, r.window_no): r.emitted for r in detect.cooled(df).collect()} == {("d", 1): True, ("d", 2): False, ("e", 2): True}


def test_envelopes_are_stable():
    w = {"ts_start": "a", "ts_end": "b", "window": "1h", "window_fingerprint": "", "config_hash": "c"}
    d = {"detector_id": "x", "subject_type": "did", "subject_value": "v", "type": "t", "score": 1.23456789, "severity": "low", "explain": {"l": list(range(30)), "s": "y" * 300}}
    e = detect.envelope(d, w, [{"kind": "note", "ref": "b"}, {"kind": "note", "ref": "a"}])
    assert e["score"] == 1.234568 and e["explain"]["truncated"] and len(e["explain"]["l"]) == 10 and len(e["explain"]["s"]) == 200
    assert e == detect.envelope(d, w, [{"kind": "note", "ref": "a"}, {"kind": "note", "ref": "b"}])
    assert e["receipt_hash"] == detect.receipt(e | {"receipt_hash": ""}) and [x["ref"] for x in e["evidence"]] == ["a", "b"]
    assert detect.stable_json({"b": 1.00000001, "a": {"z", "y"}}) == '{"a":["y","z"],"b":1.0}'
    with pytest.raises(ValueError):
        detect.receipt({"x": float("nan")})


SERIES = "fp string, bin timestamp, posts long, authors long"


def series(spark, rows):
    return spark.createDataFrame(rows, "fp string, h long, posts long, authors long").select("fp", F.timestamp_seconds(F.col("h") * 3600).alias("bin"), "posts", "authors")


def test_burst_half_life_and_entropy(spark):
    s = series(spark, [("a", i, 2, 2) for i in range(10)] + [("a", 10, 20, 15), ("b", 0, 5, 1), ("c", 0, 2, 1), ("c", 1, 10, 1), ("c", 2, 8, 1), ("c", 3, 4, 1), ("c", 4, 2, 1), ("d", 0, 2, 1), ("d", 1, 9, 1)])
    got = {r.fp: r for r in cluster.bursts(s).collect()}
    assert got["a"].burst_score == 18.0 and got["a"].synchrony == 0.75 and "b" not in got and got["a"].author_growth == 6.5
    lives = {r.fp: (r.peak_posts, r.half_life_bins) for r in cluster.half_lives(s).collect()}
    assert lives == {"a": (20, None), "b": (5, None), "c": (10, 2), "d": (9, None)}
    e = cluster.entropies(spark.createDataFrame([("x", 10), ("x", 10), ("y", 7)], "fp string, posts long"), ["fp"])
    assert {r.fp: r.entropy for r in e.collect()} == {"x": 1.0, "y": 0.0}
    assert cluster.herfindahl(s.limit(0)).first().herfindahl == 0.0


def test_regime_shift(spark):
    rows = [(i, "bait", 10) for i in range(10)] + [(i, "gloss", 1) for i in range(10)] + [(10, "shield", 10), (10, "bait", 1)]
    v = spark.createDataFrame(rows, "h long, label string, n long").select(F.timestamp_seconds(F.col("h") * 3600).alias("bin"), "label", "n")
    got = cluster.regime_shifts(v, 10, 0.2).orderBy("bin").collect()
    assert [r.shifted for r in got] == [False] * 9 + [True] and got[0].jsd == 0.0
    assert cluster.regime_shifts(v.where("h = 0" if "h" in v.columns else "false")).count() == 0


def test_sensors(spark):
    s = series(spark, [(f"f{i}", h, 1, 1) for h in range(5) for i in range(10)] + [("f0", 5, 100, 1), ("f1", 5, 1, 1)])
    got = detect.concentration(s).orderBy("bin").collect()
    assert [r.severity for r in got] == [None] * 5 + ["high"] and got[0].herfindahl == 0.1
    v = detect.author_velocity(s).where("fp = 'f0'").orderBy("bin").collect()
    assert v[0].baseline is None and v[-1].severity == "high" and v[-1].change == -0.99


def test_stream_lag_and_backlog_reach_the_health_machine(spark, tmp_path):
    from claimscope.plans import detect_queries

    rng = random.Random(2)
    lags = [0, -50, 0, *(rng.choice([0, 5, 200, 90_000, -3, None]) for _ in range(60))]
    rows = [(i // 9, i, i, None if x is None else float(x)) for i, x in enumerate(lags)]
    want, v = {}, 0.0
    for w, _, _, x in rows:
        if x is not None:
            x = min(max(x, 0.0), 600.0)
            v = x if v == 0.0 else 0.2 * x + 0.8 * v
        want[w] = v
    got = {r.window: r.lag_s for r in detect.stream_lag(spark.createDataFrame(rows, "window long, at long, no long, lag_s double")).collect()}
    assert got == pytest.approx(want) and want[0] != want[6]
    # hours of 5, 205, 405, ... arrivals, each five minutes behind its post's time in the zone of its client
    at, events = lambda h, s: f"2025-01-01T{h:02d}:{s // 60:02d}:{s % 60:02d}", []
    for h in range(6):
        events += [(len(events) + k, f"u{h}.{k}", at(h, 600 + k), '{"createdAt": "%s"}' % at(h + 1, 300 + k)) for k in range(5 + 200 * h)]
    spark.createDataFrame(events, "event_no long, event_uri string, c string, raw string").selectExpr("*", "cast(c as timestamp_ntz) ctime").write.parquet(f"{tmp_path}/post_events.parquet")
    spark.createDataFrame([(i, u, "Europe/Paris") for i, u, _, _ in events], "seq long, uri string, client_zone string").write.parquet(f"{tmp_path}/posts.parquet")
    windows = detect_queries.health_windows(spark, str(tmp_path)).orderBy("window_no").collect()
    assert [r.backlog for r in windows] == [5 + 200 * h for h in range(6)] and [round(r.lag_s, 6) for r in windows] == [300.0] * 6
    health = detect_queries.stream_health(spark, str(tmp_path)).orderBy("window_no").collect()
    assert health[0].gated and health[4].state == "degraded" and health[4].reasons == "lag_high,consumer_backlog"
