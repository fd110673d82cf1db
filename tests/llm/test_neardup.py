"""Problem 1 against all pairs, on the common way and on the way of hot buckets."""

import random
from itertools import combinations

import pytest

from claimscope.llm import neardup
from claimscope.llm.textform import words


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(texts, k, least):
    sets = {i: shingles(t, k) for i, t in texts.items() if t}
    return {(i, j) for i, j in combinations(sorted(sets), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least}


def made(seed=1, bases=90, copies=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                c = rng.randrange(len(t))
                t = t[c:] + t[:c]
            out.append(" ".join(t) + rng.choice(["", " please share this with all your friends today"]))
    out += ["", "one two", "!!!", " ".join(vocabulary * 50)]
    return dict(enumerate(out)) | {9999: None}


@pytest.mark.parametrize("limit", [64, 2])
def test_pairs_equal_brute_force(spark, limit):
    texts = made()
    like = neardup.Likeness(words=3, threshold=0.5, rows=2, bands=28, bucket_limit=limit)
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "seq long, text string, similarity int")
    got = {(r[0], r[1]): r[2] for r in neardup.similar_pairs(df, like).collect()}
    want = brute(texts, 3, 0.5)
    assert set(got) <= want and len(want - set(got)) <= 0.005 * len(want) and len(want) > 200
    for i, j in list(got)[:50]:
        a, b = shingles(texts[i], 3), shingles(texts[j], 3)
        assert abs(got[i, j] - len(a & b) / len(a | b)) < 1e-9


def test_defaults_and_empty(spark):
    texts = made(2)
    df = spark.createDataFrame(list(texts.items()), "seq long, text string")
    got = {(r[0], r[1]) for r in neardup.similar_pairs(df).collect()}
    want = brute(texts, 5, 0.8)
    assert got <= want and len(want - got) <= 0.02 * len(want) + 1
    assert neardup.similar_pairs(df.limit(0)).count() == 0
    assert neardup.similar_pairs(df.union(df)).count() == len(got)


def test_posterior_bound():
    """No pair at the threshold is dropped more often than the bound says, by the exact binomial chance."""
    import math

    for n in (16, 32, 48, 64):
        m = neardup.least_matches(n, 0.5, 1e-5)
        assert sum(math.comb(n, k) * 0.5**n for k in range(m)) < 3e-4
        assert neardup.least_matches(n, 0.8, 1e-5) > m


def test_representatives_are_first_of_their_copies(spark):
    df = spark.createDataFrame([(1, "A b c d"), (2, "a B c d!"), (3, "a b c e"), (4, None)], "seq long, text string")
    assert sorted(r[0] for r in neardup.representatives(df).collect()) == [1, 3, 4]
