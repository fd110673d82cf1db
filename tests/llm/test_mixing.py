"""Problem 9: budgets are met, caps hold, selection is by seed; the fit against all subsets."""

from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimscope.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.lists(st.tuples(st.integers(1, 12), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]))
def test_fit_is_best_below_the_budget(budget, pairs):
    lengths, counts = [n for n, _ in pairs], [c for _, c in pairs]
    got = mixing.fit(budget, lengths, counts)
    assert all(0 <= g <= c for g, c in zip(got, counts))
    sums = [sum(n * k for n, k in zip(lengths, ks)) for ks in product(*(range(c + 1) for c in counts))]
    assert sum(n * g for n, g in zip(lengths, got)) == max(s for s in sums if s <= budget)


def test_fit_of_large_budgets(spark):
    lengths, counts = list(range(50, 2000, 7)), [10_000] * 279
    for budget in (10**9 + 1, 123_456_789, 60_000):
        got = mixing.fit(budget, lengths, counts)
        assert sum(n * g for n, g in zip(lengths, got)) == budget and all(g <= c for g, c in zip(got, counts))


@pytest.mark.parametrize("budget,lengths,counts,best", [
    (230_000, [100_000], [5], 200_000), (130_000, [100_000, 65_000], [1, 2], 130_000), (1_000_000, [300_001, 7], [3, 20_000], 999_998), (99_999, [100_000], [5], 0), (10**8 + 3, [70_000, 90_000], [900, 900], 10**8),
])
def test_fit_of_long_documents(budget, lengths, counts, best):
    got = mixing.fit(budget, lengths, counts)
    assert sum(n * g for n, g in zip(lengths, got)) == best and all(g <= c for g, c in zip(got, counts))


def rows(spark):
    out = [(i, "big", 10 + i % 7) for i in range(3000)] + [(10_000 + i, "small", 5 + i % 3) for i in range(100)] + [(20_000 + i, "same", 8) for i in range(400)]
    return spark.createDataFrame(out, "doc_id long, source string, n_tokens long"), spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 4), ("same", 0.3, 3), ("none", 0.0, 2), ("void", 0.1, 2)], "source string, target_share double, max_repeats int")


def test_mixture(spark):
    lengths, targets = rows(spark)
    mixture = mixing.mix(lengths, targets, seed=1)
    got = {r.source: r for r in mixing.reached(mixture, lengths, targets).collect()}
    budget = {r.source: r.budget for r in mixing.budgets(lengths, targets).collect()}
    assert got["small"].tokens == budget["small"] == 4 * got["small"].available and got["small"].most_repeats == 4
    for s in ("big", "same"):
        assert 0 <= budget[s] - got[s].tokens < 8 and got[s].most_repeats <= got[s].max_repeats
    assert got["void"].tokens == got["none"].tokens == 0
    assert abs(got["big"].share - 0.5) < 0.01
    a, b = (sorted(map(tuple, mixing.mix(lengths, targets, seed=s).collect())) for s in (1, 1))
    assert a == b and a != sorted(map(tuple, mixing.mix(lengths, targets, seed=2).collect()))
    assert mixing.mix(lengths.limit(0), targets).count() == 0 and mixing.mix(lengths, targets.limit(0)).count() == 0


def test_token_lengths(spark):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(mixing.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=mixing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "", None, "été 🧵 <|endoftext|>", "x" * 20_000]
    df = spark.createDataFrame([(i, "s" if i < 4 else None, t) for i, t in enumerate(texts)] + [(9, "s", "a b")], "doc_id long, source string, text string")
    got = {r.doc_id: r.n_tokens for r in mixing.token_lengths(df).collect()}
    assert got == {0: len(enc.encode_ordinary(texts[0])), 3: len(enc.encode_ordinary(texts[3])), 9: 2}
