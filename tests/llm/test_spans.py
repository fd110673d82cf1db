"""Problem 10 against every offset; long, periodic and empty texts."""

import random
from itertools import combinations

from claimscope.llm import spans


def longest(a, b, least):
    best, seen = 0, {}
    for i in range(len(a) - least + 1):
        seen.setdefault(a[i : i + least], i)
    for j in range(len(b) - least + 1):
        i = seen.get(b[j : j + least])
        if i is not None:
            n = least
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_against_every_offset(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé 🧵\n") for _ in range(n))
    docs = [text(rng.randrange(0, 900)) for _ in range(40)]
    for n in (99, 100, 101, 180, 100, 100):
        a, b = rng.sample(range(40), 2)
        piece = text(n)
        docs[a] += piece + text(20)
        docs[b] = text(7) + piece + docs[b]
    docs += ["ab" * 400, "x" + "ab" * 60, "c" + "ab" * 40 + text(100), "y" * 1000, "y" * 99, "y" * 100, docs[0], "", text(spans.PIECE + 500)]
    docs.append(docs[-1][spans.PIECE - 60 : spans.PIECE + 60])
    df = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(docs)), (99, None, 1)], "doc_id long, text string, pos int")
    got = spans.shared_spans(df, least=100, unit=40).collect()
    want = {(i, j): n for i, j in combinations(range(len(docs) - 2), 2) if (n := longest(docs[i], docs[j], 100))}
    want[len(docs) - 2, len(docs) - 1] = 120
    found = {}
    for r in got:
        assert docs[r.doc_a][r.start_a : r.start_a + r.length] == docs[r.doc_b][r.start_b : r.start_b + r.length]
        found[r.doc_a, r.doc_b] = max(found.get((r.doc_a, r.doc_b), 0), r.length)
    assert found == want and len(want) >= 6
    assert spans.shared_spans(df.limit(0)).count() == 0
    lengths = {r.doc_id: r for r in spans.shared_lengths(spans.shared_spans(df, least=100, unit=40), df).collect()}
    assert lengths[0].shared_chars == lengths[0].n_chars == len(docs[0])


def test_duplicate_lines_keep_their_offsets(spark):
    docs = [(1, "first line\n  second line \nthird"), (2, "other\nsecond line\n\nthird\nthird"), (3, ""), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in spans.duplicate_units(df).collect())
    assert [g[:2] for g in got] == [(2, 1), (2, 3), (2, 4)]
    text = dict(docs)[2]
    assert [text[g[2] : g[3]] for g in got] == ["second line", "third", "third"] and all(g[4] == 1 for g in got)
    assert spans.duplicate_units(df.limit(0)).count() == 0


def covered(a, b, least):
    """The places of a that lie in least characters which b has too."""
    held = {b[j : j + least] for j in range(len(b) - least + 1)}
    return {x for i in range(len(a) - least + 1) if a[i : i + least] in held for x in range(i, i + least)}


def test_every_alignment_of_periodic_runs(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    docs = []
    for period in (1, 2, 7, 40, 80, 100, 119):
        for least_over in (0, 5, 20, 150):
            line, head = text(period), text(150)
            cutout = (line * 400)[(at := rng.randrange(period)) : at + 300 + least_over]
            docs.append((head if least_over else text(90)) + line * (1 + 1600 // period) + text(200))
            docs.append((head if least_over == 20 else text(130)) + cutout + text(170))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    runs = spans.shared_spans(df)
    got = {}
    for r in runs.collect():
        a, b = docs[r.doc_a], docs[r.doc_b]
        assert r.length >= 300 and a[r.start_a : r.start_a + r.length] == b[r.start_b : r.start_b + r.length]
        here = got.setdefault((r.doc_a, r.doc_b), [set(), set(), 0])
        here[0].update(range(r.start_a, r.start_a + r.length)), here[1].update(range(r.start_b, r.start_b + r.length))
        here[2] = max(here[2], r.length)
    want = {}
    for i, j in combinations(range(len(docs)), 2):
        a, b = docs[i], docs[j]
        if n := longest(a, b, 300):
            want[i, j] = [covered(a, b, 300), covered(b, a, 300), n]
    assert got == want and len(want) >= 28


def test_pieces_without_duplicates(spark):
    docs = [(1, "First line\n  second\tline \nthird"), (2, "keep\nＳecond   LINE\n\nthird\nmore\nthird"), (3, "third"), (4, ""), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in spans.without_duplicates(df).collect())
    text = dict(docs)
    assert all(text[d][s:e] == t for d, s, e, t in got)
    assert [(d, t.strip()) for d, _, _, t in got] == [(1, docs[0][1]), (2, "keep"), (2, "more")]
    assert spans.without_duplicates(df.limit(0)).count() == 0


def test_pairs_of_whole_copies(spark):
    """Copies of a text pair among themselves and with all that one of them shares."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    piece = text(320)
    docs = [text(50) + piece, a := text(10) + piece + text(30), a, a, text(400), b := text(299), b]
    df = spark.createDataFrame([(10 - i, t) for i, t in enumerate(docs)] + [(10, docs[0])], "doc_id long, text string")
    got = {(r.doc_a, r.doc_b): r.length for r in spans.shared_spans(df).collect()}
    assert got == {(7, 8): 360, (7, 9): 360, (8, 9): 360, (7, 10): 320, (8, 10): 320, (9, 10): 320}
