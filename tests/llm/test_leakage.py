"""Problem 8 against a scan of every window."""

import random

from claimscope.llm import leakage
from claimscope.llm.textform import words


def corpus(seed=3):
    rng = random.Random(seed)
    v = [f"t{i}" for i in range(60)]
    docs = [" ".join(rng.choice(v) for _ in range(rng.randrange(0, 200))) for _ in range(60)]
    items = [" ".join(rng.choice(v) for _ in range(rng.randrange(5, 30))) for _ in range(30)]
    for k, it in enumerate(items):
        w = it.split()
        for n in (9, 10, 14):
            at = rng.randrange(max(1, len(w) - n))
            docs[(k * 7 + n) % len(docs)] += " " + ", ".join(w[at : at + n]).upper()
    return docs + ["", "t1 t2"], items + ["", "too short"]


def brute(docs, items, run=10):
    out = set()
    for i, it in enumerate(items):
        w = words(it)
        wins = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for d, t in enumerate(docs):
            x = words(t)
            if any(tuple(x[k : k + run]) in wins for k in range(len(x) - run + 1)):
                out.add((d, i))
    return out


def test_phrases(spark, monkeypatch):
    docs, items = corpus()
    df = spark.createDataFrame([*((i, t, "e") for i, t in enumerate(docs)), (900, None, "e"), (3, docs[3], "e")], "doc_id long, text string, item string")
    it = spark.createDataFrame([*enumerate(items), (901, None)], "item_id long, text string")
    want = brute(docs, items)
    assert {tuple(r) for r in leakage.leaked_items(df, it).collect()} == want and len(want) > 20
    monkeypatch.setattr(leakage, "BLOCK", 20)  # several blocks of items
    assert {tuple(r) for r in leakage.leaked_items(df, it).collect()} == want
    assert leakage.leaked_items(df.limit(0), it).count() == 0 and leakage.leaked_items(df, it.limit(0)).count() == 0


def test_places_and_near_matches(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = ["zero " + item, "one two three four x five six seven eight nine ten", "ten nine eight seven six five four three two one", "one two three"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    it = spark.createDataFrame([(5, item)], "item_id long, text string")
    index = leakage.PositionalIndex.build(df)
    assert {tuple(r) for r in index.phrases(it).collect()} == {(0, 5, 0, 1), (0, 5, 1, 2)}
    near = {(r.doc, r.slack > 0) for r in index.near(it, slop=1, anchors=10).collect()}
    assert (0, False) in near and (1, True) in near and not any(d == 3 for d, _ in near)


def near_brute(docs, items, run, slop, need):
    """The least slack of each (doc, item, win) over every start; a posting counts for one word."""
    out = {}
    for i, it in enumerate(items):
        w = words(it)
        for k in range(len(w) - run + 1):
            for d, t in enumerate(docs):
                x = words(t)
                for s in range(-run, len(x) + run):
                    used, slack = {}, 0
                    for j in range(run):
                        near = [p for p in range(max(0, s + j - slop), min(len(x), s + j + slop + 1)) if x[p] == w[k + j]]
                        slack = max([slack, *([min(abs(p - s - j) for p in near)] if near else [])])
                        free = [p for p in near if p > max(used.get(w[k + j], [-1]))]
                        if free:
                            used.setdefault(w[k + j], []).append(free[0])
                    if sum(map(len, used.values())) >= need:
                        out[d, i, k] = min(out.get((d, i, k), slack), slack)
    return out


def test_near_matches_with_words_edited(spark, monkeypatch):
    rng = random.Random(6)
    v = [f"t{i}" for i in range(40)]
    items = [" ".join(rng.choice(v) for _ in range(14)) for _ in range(6)] + ["no " * 12]
    docs = [" ".join(rng.choice(v) for _ in range(rng.randrange(0, 60))) for _ in range(14)] + ["no", "no no no no no no no no", ""]
    for i, it in enumerate(items[:6]):
        for edits in (1, 2, 3):
            w = it.split()[2:12]
            for at in rng.sample(range(10), edits):
                w[at] = f"edited{at}"
            w.insert(rng.randrange(10), "extra")
            docs[(3 * i + edits) % 14] += " " + " ".join(w)
    items.append("one two three four five six seven eight nine unheard")  # a word that no document holds
    docs.append("so one two three four five six seven eight nine ten")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2)
    it = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = near_brute(docs, items, 10, 2, 8)
    assert (len(docs) - 1, len(items) - 1, 0) in want and len(want) > 12 and not any(d == 14 for d, _, _ in want)
    for tokens, places in ((1 << 20, 1 << 20), (50, 30)):  # whatever the shards
        monkeypatch.setattr(leakage, "SHARD_TOKENS", tokens)
        monkeypatch.setattr(leakage, "PLACES", places, raising=False)
        got = {}
        for r in leakage.PositionalIndex.build(df).near(it, slop=2).collect():
            got[r.doc, r.item, r.win] = min(got.get((r.doc, r.item, r.win), r.slack), r.slack)
        assert got == want
