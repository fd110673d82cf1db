"""Problem 3, against a plain fold."""

import random

from claimscope.operators import changefeed

SCHEMA = "row_no long, did string, event_kind string, time_us long, seq long, has_handle boolean, handle string, has_active boolean, active boolean, extra string"


def fold(rows, base=()):
    seen = {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[1] is not None and r[3] is not None:
            seen.setdefault((r[1], r[3], -(2**63) if r[4] is None else r[4]), r)
    state = {d: [h, a] for d, h, a in base}
    for (did, _, _), r in sorted(seen.items(), key=lambda kv: kv[0]):
        if r[2] == "tombstone":
            state.pop(did, None)
            continue
        s = state.setdefault(did, [None, True])
        if r[5]:
            s[0] = r[6]
        if r[7]:
            s[1] = bool(r[8])
    return sorted((d, h or "", int(a)) for d, (h, a) in state.items())


def made(n, seed, dids=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["identity", "identity", "account", "tombstone"])
        rows.append([i, f"did:{min(rng.randrange(dids * 2), dids) if rng.random() < 0.7 else 0}", kind, rng.randrange(40), rng.choice([None, 1, 2, 3]),
                     kind == "identity" and rng.random() < 0.9, rng.choice([None, "a", "b", "c"]) if kind == "identity" else None,
                     kind == "account", rng.choice([None, True, False]) if kind == "account" else None, "x"])
    for r in rng.sample(rows, n // 4):
        rows.append([len(rows), *r[1:]])
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


def test_against_fold_with_and_without_slices(spark):
    for seed in (1, 2):
        rows = made(300, seed)
        # repeats with other contents count once, by the smallest row number
        df = spark.createDataFrame(rows, SCHEMA)
        for hot in (200_000, 20):
            assert sorted(map(tuple, changefeed.current_state(df, hot=hot).collect())) == fold(rows), (seed, hot)


def test_base_rows_are_counted_and_removed(spark):
    rows = made(60, 3)
    base = [("did:1", "old", False), ("did:99", None, True), ("did:98", "kept", False)]
    got = changefeed.current_state(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(base, "did string, handle string, active boolean"))
    assert sorted(map(tuple, got.collect())) == fold(rows, base)


def test_images_sum_to_one_row_an_account(spark):
    df = spark.createDataFrame(made(200, 4), SCHEMA)
    sums = changefeed.images(df).groupBy("did", "handle", "active").sum("weight").collect()
    assert all(r[3] in (0, 1) for r in sums)


def test_nulls_and_empty(spark):
    rows = [(1, None, "identity", 1, 1, True, "a", False, None, ""), (2, "d", "identity", None, 1, True, "a", False, None, ""), (3, "e", None, 5, None, None, "zz", None, None, None), (None, "e", None, 5, None, None, "zz", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, changefeed.current_state(df).collect())) == [("e", "", 1)]
    assert changefeed.current_state(df.limit(0)).count() == 0
