"""Problems 6 and 7 against brute force."""

from itertools import combinations

from claimscope.llm import formatcopies, lookalike
from claimscope.llm.textform import collapse, consistent, format_free, has_text

TEXTS = [
    "The old weir", "Тhe оld weir", "The  old\tweir", "the old weir", "The old weir.", "THE OLD WEIR!", None, "", " ", "...", "…", "été", "été", "ete",
    "Ref: 1\nStatus: x\nPlace: y", "status: x; place: y; ref: 1", "Ref 1 Status x Place y", "Ref: 2\nStatus: x\nPlace: y", "a" * 300_000, "Ａ" * 300_000, "🧵", "the old weir", "The old weir",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "seq long, text string, f1 string")


def test_lookalike_pairs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS) if t is not None and has_text(t)]
    want = {(i, j) for (i, a), (j, b) in combinations(rows, 2) if consistent(a) == consistent(b) and collapse(a) != collapse(b)}
    got = {tuple(r) for r in lookalike.lookalike_pairs(frame(spark)).collect()}
    assert got == want and len(want) >= 4
    assert lookalike.lookalike_pairs(frame(spark, [])).count() == 0


def test_consistent_forms_cover_every_row(spark):
    got = {r[0]: r[1] for r in lookalike.consistent_forms(frame(spark)).collect()}
    assert len(got) == len(TEXTS) and got[6] is None and got[0] == got[1] == got[2] == "The old weir" and got[11] == got[12] != got[13]


def test_collation_class_members(spark):
    """Forms that the collation holds equal share their smallest member, whatever the mapping left."""
    forms = spark.createDataFrame([(1, 1, "ab"), (2, 2, "a\u0007b"), (3, 3, "aB")], "f1 long, f2 long, form string")
    assert {tuple(r) for r in lookalike.canonical_members(forms).select("f1", "c1").collect()} == {(1, 2), (2, 2)}


def brute_groups(texts):
    rows = [(i, *format_free(t)) for i, t in enumerate(texts) if t is not None and has_text(t)]
    group = {i: i for i, _, _ in rows}
    for (i, p, f), (j, q, g) in combinations(rows, 2):
        if p == q or f and f == g:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = {k: new if v == old else v for k, v in group.items()}
    members = {}
    for i, g in group.items():
        members.setdefault(g, []).append(i)
    return {(i, min(m), len(m)) for m in members.values() if len(m) > 1 for i in m}


def test_text_groups(spark):
    got = {tuple(r) for r in formatcopies.text_groups(frame(spark)).collect()}
    assert got == brute_groups(TEXTS)
    assert {(14, 14, 3), (15, 14, 3), (16, 14, 3)} <= got
    assert formatcopies.text_groups(frame(spark, [])).count() == 0
    collapsed = {(r[0], r[1]) for r in formatcopies.collapsed_posts(frame(spark)).collect()}
    assert (0, 8) in collapsed and sum(n for _, n in collapsed) == len(TEXTS)


def test_chains_of_fields_and_letters(spark):
    """Rows 0 and 1 agree in letters only; 2 and 3 are their fields in another order; 4 and 5 go on from there."""
    texts = ["ab: c/d: e/f: g", "a: bc/d: e/f: g", "f: g/d: e/a: bc", "f: g/d: e/ab: c", "fg: /d: e/a: bc/x: y", "f: g/de: /a: bc/x: y", "x: y/a: bc/de: /f: g", "other"]
    got = {tuple(r) for r in formatcopies.text_groups(frame(spark, texts)).collect()}
    assert got == brute_groups(texts) and {i for i, first, _ in got if first == 0} == {0, 1, 2, 3}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in formatcopies.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_hot_group_and_claims(spark):
    rows = [(i, "a", "u", ["d0b8782c", "D0B8-782C", " d0b8 782c\n", "'d0b8782c'"][i % 4], i) for i in range(3000)]
    rows += [(3000, None, "u", "d0b8782c", 1), (3001, "a", None, "d0b8782c", 1), (3002, "a", "u", None, 1), (3003, "a", "u", "ffff", 1), (3003, "a", "u", "ffff", 1)]
    df = spark.createDataFrame(rows, "seq long, author_did string, post_uri string, claim_fingerprint string, v1 long")
    got = formatcopies.record_groups(df, "seq", ["author_did", "post_uri"], "claim_fingerprint")
    assert got.where("first_seq = 0 AND copies = 3000").count() == 3000 and got.where("seq = 3003 AND copies = 2").count() == 2 and got.count() == 3002
    assert formatcopies.record_groups(df.limit(0), "seq", ["author_did", "post_uri"], "claim_fingerprint").count() == 0
