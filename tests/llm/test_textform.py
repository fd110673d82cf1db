"""The consistent form, words, and the formatting-free key of single texts."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from claimscope.llm import textform as tf


@pytest.mark.parametrize("a,b", [
    ("Ｆｕｌｌ １２", "Full 12"), ("été", "été"), ("zero​width﻿", "zerowidth"), ("soft­hyphen", "softhyphen"), ("a b　c", "a b c"),
    ("ﬁne", "fine"), ("rерlасеd", "replaced"), ("Ѕkохоеtһost", "Skoxoethost"), ("Βureau", "Bureau"), ("negό", "negó"), ("evacuό", "evacuó"),
    ("лoдок", "лодок"), ("Tиxо", "Тихо"), ("Тһіѕ", "This"), ("Baу Watch", "Bay Watch"), ("oca и", "оса и"), ("говорил o доме", "говорил о доме"), ("аре here", "ape here"),
    ("τoday", "today"), ("ɡоogle", "google"), ("gօօd", "good"), ("Үes", "Yes"), ("a\u2028b", "a b"), ("a\u1680b\x85c", "a b c"), ("ждут у Truthen Вaу", "ждут у Truthen Bay"),
    ("και ήταν", "και ήταν"), ("їжi", "їжі"),
    (" x \t\r\n y ", "x y"), ("a‍b", "ab"), ("ЗACYXA", "ЗАСУХА"),
])
def test_equal(a, b):
    assert tf.consistent(a) == tf.consistent(b) == b.strip().replace(" \t\r\n ", " ")


@pytest.mark.parametrize("a,b", [("a", "A"), ("resume", "résumé"), ("a b", "ab"), ("a.", "a"), ("\U0001f469‍\U0001f692", "\U0001f469\U0001f692"), ("оса and и", "oca and и"), ("ılık", "ilik"), ("а", "a")])
def test_different(a, b):
    assert tf.consistent(a) != tf.consistent(b)


@given(st.text())
def test_form_is_stable(t):
    once = tf.consistent(t)
    assert tf.consistent(once) == once or any(ord(c) > 0x36F for c in t)
    assert tf.has_text(t) == bool(tf.letters_and_digits(t)) or not t.isascii()


PAIRS = [(a, b, s) for s, table in (("c", tf.LATIN_CYRILLIC), ("g", tf.LATIN_GREEK), ("", tf.TOWARDS_LATIN)) for a, b in table.split()]


@pytest.mark.parametrize("latin,twin,script", PAIRS)
def test_every_letter_of_the_tables_in_a_word_of_either_script(latin, twin, script):
    assert tf.consistent(f"f{twin}bf zone") == f"f{latin}bf zone"
    if script:  # and a Latin letter in a word of the other script
        around = {"c": "жд", "g": "δλ"}[script]
        assert tf.consistent(f"{around}{latin}{around}") == f"{around}{twin}{around}"


@given(st.lists(st.sampled_from(["Truthen", "Bay", "opened", "вода", "дорога", "ждут", "BOX", "упала,"]), min_size=1, max_size=8), st.data())
def test_swapped_letters_leave_no_trace(parts, data):
    """Words with letters of their own, and names after them, come back from any swap but that of all their letters."""
    swapped = []
    for w in parts:
        own = tf._judged(w)[0]
        table = tf._TO_CYRILLIC if own == "l" else tf._TO_LATIN
        swapped.append("".join(table.get(c, c) if own and c in tf._OPEN and data.draw(st.booleans()) else c for c in w))
    assert tf.consistent(" ".join(swapped)) == tf.consistent(" ".join(parts))


def test_words():
    assert tf.words("Don't_stop 1,234 ＡＢ-ç!") == ["don", "t", "stop", "1", "234", "ab", "ç"]
    assert tf.words("") == tf.words("... !") == []


def test_named_fields():
    base = tf.format_free("Ref: ZK-4\nStatus: odd jetty\nPlace: Gona Bay")
    for other in ("status: odd jetty ; place: gona bay ; ref: zk-4", "PLACE:GONA BAY |  REF:ZK-4 | STATUS:ODD JETTY", "Place: Gona Bay|Ref: ZK 4|Status: Odd Jetty\n"):
        assert tf.format_free(other)[1] == base[1] and len(base[1]) == 3
    assert tf.format_free("Ref: ZK-5\nStatus: odd jetty\nPlace: Gona Bay")[1] != base[1]
    assert tf.format_free("Two: fields\nonly: here")[1] == []
    assert tf.format_free("Some prose, then a: b, c: d and e: f")[1] == []
    assert tf.format_free("Hello,  World")[0] == tf.format_free("hello world!")[0] == "helloworld"
