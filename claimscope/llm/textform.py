"""The consistent form of a text, its words, and its formatting-free key.

Plain Python on one string: these run inside Arrow functions on whole batches, as Spark
has no built-in for Unicode normalisation. ASCII texts take a short way through.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Characters that leave no mark (format characters, fillers, variation selectors), as code point ranges.
INVISIBLE_RANGES = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​‌‎‏‪-‮"
    "⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff"
)
# Letters of two scripts that look the same, Latin first.
LATIN_CYRILLIC = (
    "aа eе oо pр cс yу xх sѕ iі jј hһ dԁ qԛ wԝ vѵ lӏ AА BВ EЕ KК MМ HН OО PР CС TТ XХ SЅ IІ JЈ YУ QԚ WԜ VѴ GԌ"
)
LATIN_GREEK = "oο vν pρ aα iι uυ jϳ AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ JͿ"
# Letters that always stand for a Latin one when the rest of the word is Latin, but else for themselves.
TOWARDS_LATIN = (
    "yγ oσ tτ xχ kκ nη wω kк yү YҮ hҺ lӀ "
    "oօ uս hհ nո gց qզ OՕ SՏ UՍ LԼ "
    "AᎪ DᎠ RᎡ TᎢ iᎥ YᎩ JᎫ EᎬ WᎳ MᎷ HᎻ GᏀ ZᏃ VᏙ SᏚ LᏞ CᏟ PᏢ KᏦ BᏴ"
)
# Latin letters of phonetic writing that look like plain ones.
PHONETIC = "gɡ aɑ yʏ"
# Latin letters whose Cyrillic or Greek twin is in everyday use; the other twins only ever imitate Latin.
EVERYDAY_CYRILLIC = "aeopcyxABEKMHOPCTXY"
EVERYDAY_GREEK = "ovABEZHIKMNOPTYX"

_TO_LATIN = {p[1]: p[0] for p in (LATIN_CYRILLIC + " " + LATIN_GREEK + " " + TOWARDS_LATIN).split()}
_TO_CYRILLIC = {p[0]: p[1] for p in LATIN_CYRILLIC.split()}
_TO_GREEK = {p[0]: p[1] for p in LATIN_GREEK.split()}
_INTO = {
    "l": _TO_LATIN,
    "c": _TO_CYRILLIC | {g: _TO_CYRILLIC[a] for a, g in _TO_GREEK.items() if a in _TO_CYRILLIC},
    "g": _TO_GREEK | {c: _TO_GREEK[a] for a, c in _TO_CYRILLIC.items() if a in _TO_GREEK},
}
#: Twins that say nothing about the script of their word; those that speak for their own if nothing else does; those of Latin.
_OPEN = {x for a in EVERYDAY_CYRILLIC for x in (a, _TO_CYRILLIC[a])} | {x for a in EVERYDAY_GREEK for x in (a, _TO_GREEK[a])}
_OWN = {p[1] for p in TOWARDS_LATIN.split()} | set("αιυρ")
_IMITATIONS = {x for p in (LATIN_CYRILLIC + " " + LATIN_GREEK).split() for x in p} - _OPEN - _OWN
_PHONETIC = str.maketrans({p[1]: p[0] for p in PHONETIC.split()})

_INVISIBLE = re.compile(f"[{INVISIBLE_RANGES}]+")
_JOINER = re.compile("‍")
_OTHER_SCRIPT = re.compile("[ɐ-ʯͰ-ϿЀ-԰Ա-֏Ꭰ-\u13ffἀ-῿]")
_ODD_BLANKS = re.compile("[\x85\u1680\u2028\u2029]")
_BLANKS = re.compile("[ \t\r\n]+")
_WORD_WITH_MARKS = re.compile("[^\\W_](?:[^\\W_]|[̀-ͯ])*")
_WORD = re.compile(r"[^\W_]+")
_NOT_COUNTED = re.compile(r"[\W_]+")
_FIELD = re.compile(r"([^\W\d_][\w\-]*)\s*:(?!//)")
_SENTENCE_END = re.compile("[.!?…\n]")
_LOOSE = re.compile("[\t\r\n]|  ")
_ASCII_NOT_COUNTED = {i: None for i in range(128) if not chr(i).isalnum()}


def collapse(text: str) -> str:
    """Runs of blank, tab, CR and LF as one blank, cut at both ends."""
    return (_BLANKS.sub(" ", text) if _LOOSE.search(text) else text).strip(" ")


def _script(ch: str) -> str:
    o = ord(ch)
    if 0x400 <= o <= 0x52F:
        return "c"
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return "g"
    if 0x530 <= o <= 0x58F:
        return "a"
    if 0x13A0 <= o <= 0x13FF:
        return "k"
    if (o < 0x2B0 or 0x1E00 <= o <= 0x1EFF) and ch.isalpha():
        return "l"
    return ""


@lru_cache(1 << 16)
def _judged(word: str) -> tuple[str, str]:
    """(script that a word is written in, or "" if its letters don't say; the scripts that its letters are of).

    Letters that no other script imitates speak first, the most of them, Latin on a tie; then imitations, for Latin; then letters
    that resemble Latin ones but are in use themselves.
    """
    sure: dict[str, int] = {}
    own: dict[str, int] = {}
    scripts, imitated = set(), False
    for ch in word if word.isascii() else unicodedata.normalize("NFD", word):
        if s := _script(ch):
            scripts.add(s)
            if ch in _IMITATIONS:
                imitated = True
            elif ch not in _OPEN:
                votes = own if ch in _OWN else sure
                votes[s] = votes.get(s, 0) + 1
    if not sure and imitated:
        return "l", "".join(sorted(scripts))
    votes = sure or own
    return max(votes, key=lambda s: (votes[s], s == "l"), default=""), "".join(sorted(scripts))


@lru_cache(1 << 16)
def _in_script(word: str, script: str) -> str:
    """The word with the look-alikes of other scripts put into its own."""
    table = _INTO.get(script)
    if table is None:
        return word
    return unicodedata.normalize("NFC", "".join(table.get(ch, ch) for ch in unicodedata.normalize("NFD", word)))


def _lookalikes(text: str) -> str:
    """Letters that imitate another script, put into the script their word is otherwise written in.

    A word without a letter of its own goes by the rest of the text: if all other words are of one script, it takes that.
    Beside several scripts a word whose letters are all of one stays; a word of mixed letters that continues a name (both begin
    with a capital, within a sentence) takes the name's script, else that of most of its letters, on a tie of the word before it.
    """
    at = list(_WORD_WITH_MARKS.finditer(text))
    judged = [_judged(m.group()) for m in at]
    whole = {s for s, _ in judged if s}
    targets = [s for s, _ in judged]
    if len(whole) == 1 and whole <= set(_INTO):
        only = next(iter(whole))
        targets = [only if held else "" for _, held in judged]
    else:
        for i, (script, held) in enumerate(judged):
            if not script and len(held) > 1:
                targets[i] = _undecided(text, at, judged, i)
    out, end = [], 0
    for m, target in zip(at, targets):
        if target and not (target == "l" and m.group().isascii()):
            out += [text[end : m.start()], _in_script(m.group(), target)]
            end = m.end()
    return "".join([*out, text[end:]])


def _undecided(text: str, at: list[re.Match], judged: list[tuple[str, str]], i: int) -> str:
    """The script of a word of mixed letters, none of them its own, beside several scripts or none."""
    begins = lambda k: k == 0 or _SENTENCE_END.search(text, at[k - 1].end(), at[k].start())
    word, before, j = at[i].group(), "", i
    while not before and not begins(j):
        j -= 1
        before = judged[j][0]
    if before in _INTO and word[0].isupper() and at[j].group()[0].isupper() and not begins(j):
        return before
    letters = [s for s in map(_script, unicodedata.normalize("NFD", word)) if s in _INTO]
    most = max(map(letters.count, letters), default=0)
    best = {s for s in letters if letters.count(s) == most}
    return before if before in best else "l" if "l" in best else min(best, default="")


def _joiners(m: re.Match) -> str:
    """A zero-width joiner shows only between two pictographs."""
    s, i = m.string, m.start()
    before, after = s[i - 1 : i], s[i + 1 : i + 2]
    shows = before and after and unicodedata.category(before) in ("So", "Sk") and unicodedata.category(after) == "So"
    return m.group() if shows else ""


def uncollapsed(text: str) -> str:
    """The consistent form with its white space as stored."""
    if text.isascii():
        return text
    text = _INVISIBLE.sub("", text)
    if "‍" in text:
        text = _JOINER.sub(_joiners, text)
    text = _ODD_BLANKS.sub(" ", unicodedata.normalize("NFKC", text)).translate(_PHONETIC)
    return _lookalikes(text) if _OTHER_SCRIPT.search(text) else text


def consistent(text: str) -> str:
    """The one form in which texts that look the same are equal.

    Compatibility forms (full width, ligatures, odd blanks) become plain, accents composed, characters without a
    mark go, look-alike letters take their word's script, white space collapses. Case, punctuation and accents stay.
    """
    return collapse(uncollapsed(text))


def words(text: str) -> list[str]:
    """Longest runs of letters and digits of the consistent form, in lower case."""
    return _WORD.findall(uncollapsed(text).lower())


def has_text(text: str | None) -> bool:
    """Whether a letter or digit occurs."""
    return text is not None and _WORD.search(text) is not None


def letters_and_digits(text: str) -> str:
    if text.isascii():
        return text.translate(_ASCII_NOT_COUNTED).lower()
    return _NOT_COUNTED.sub("", text).casefold()


def format_free(text: str) -> tuple[str, list[str]]:
    """What is left when formatting doesn't count: letters and digits in one case; and the named fields.

    Fields are ``name: value`` units; a text is made of fields if it begins with a name and has three or
    more. A unit is ``name`` + TAB + ``value``, sorted, so neither order nor separators count. Else the list is empty.
    """
    form = uncollapsed(text)
    plain = letters_and_digits(form)
    at = list(_FIELD.finditer(form)) if form.count(":") >= 3 else []
    if len(at) < 3 or letters_and_digits(form[: at[0].start()]):
        return plain, []
    ends = [m.start() for m in at[1:]] + [len(form)]
    return plain, sorted(
        letters_and_digits(m.group(1)) + "\t" + letters_and_digits(form[m.end() : e]) for m, e in zip(at, ends)
    )
