"""Problem 4: every combination against exact sets; parts joined."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from claimscope.llm import patterns

GROUPS = ["day", "kind"]


def rows(n=2000):
    rng = random.Random(8)
    return [(rng.choice([None, *(f"a{i}" for i in range(200))]) if rng.random() < 0.6 else "hot", rng.choice(["d1", "d2", None]), rng.choice("xyz"), "z") for _ in range(n)]


def brute(data):
    out = {}
    for n in range(3):
        for kept in combinations(range(2), n):
            for r in data:
                if r[0] is not None:
                    key = ("+".join(GROUPS[k] for k in kept), *(r[1 + k] if k in kept else None for k in range(2)))
                    out.setdefault(key, set()).add(r[0])
    return {k: len(v) for k, v in out.items()}


def members(spark, data):
    df = spark.createDataFrame(data, "id string, day string, kind string, cell string")
    return patterns.memberships(df, F.col("id"), {g: F.col(g) for g in GROUPS})


def test_all_combinations_exactly(spark):
    data = rows()
    totals = patterns.patterns(members(spark, data))
    assert {tuple(r[:3]): r[3] for r in patterns.combination_counts(totals, GROUPS).collect()} == brute(data)
    ids = lambda f: {r[0] for r in data if r[0] is not None and f(r)}
    assert patterns.union_count(totals, lambda c: (c["kind"] == "x") | (c["day"] == "d1")).first()[0] == len(ids(lambda r: r[2] == "x" or r[1] == "d1"))
    assert patterns.overlap_count(totals, lambda c: c["kind"] == "x", lambda c: c["kind"] == "y").first()[0] == len(ids(lambda r: r[2] == "x") & ids(lambda r: r[2] == "y"))


def test_parts_join_to_the_whole(spark):
    data = rows()
    whole = patterns.patterns(patterns.merge(members(spark, data[:700]), members(spark, data[500:1400]), members(spark, data[1300:])))
    assert {tuple(r[:3]): r[3] for r in patterns.combination_counts(whole, GROUPS).collect()} == brute(data)


def test_empty_and_nulls(spark):
    assert patterns.combination_counts(patterns.patterns(members(spark, []).limit(0)), GROUPS).count() == 0
    totals = patterns.patterns(members(spark, [(None, "d1", "x", "")]))
    assert totals.count() == 0 and patterns.union_count(totals, lambda c: F.lit(True)).first()[0] == 0


def test_patterns_within_a_group(spark):
    """Counts that no combination crosses are those of each group by itself."""
    data = rows()
    df = spark.createDataFrame(data, "id string, day string, kind string, cell string")
    totals = patterns.patterns(patterns.memberships(df, F.col("id"), {"day": F.col("day")}, {"kind": F.col("kind")}))
    got = {(r.kind, r.grouping, r.day): r.n for r in patterns.combination_counts(totals, ["day"]).collect()}
    want = {(k[2], "", None): n for k, n in brute(data).items() if k[0] == "kind"} | {(k[2], "day", k[1]): n for k, n in brute(data).items() if k[0] == "day+kind"}
    assert got == want
