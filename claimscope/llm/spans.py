"""Long exact spans shared between records (problem 10).

``duplicate_units`` hashes lines or paragraphs: units are normalised (consistent form, one case, white space collapsed), their digests
grouped globally, the earliest ranked occurrence of each stays and the others are listed with their offsets in the text as stored;
``without_duplicates`` removes them.

Lines alone can't show every shared passage, as one may begin and end inside a line. ``shared_spans`` therefore cuts units by
content: of every ``least - unit + 1`` neighbouring runs of ``unit`` characters the one with the smallest hash is taken. Two
texts that share ``least`` characters then always have such a unit in common, wherever the passage lies. Digests of units are
grouped globally as before; texts that share one are compared around it, exactly as stored. Of equal texts only the first takes
part; the pairs of its copies follow from its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from claimscope.llm.arrow import digests
from claimscope.llm.textform import collapse, consistent
from claimscope.runtime import cut, stored

LEAST, UNIT = 300, 120
#: Characters that one pass of the hash covers; longer texts are covered in overlapping pieces.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 2**64)
    return tuple(
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]).astype(np.uint64)) for b in (_BASE, inverse)
    )


def _units(least: int, unit: int):
    width = least - unit + 1
    size = PIECE + 2 * least + width

    def pieces(texts: list[str]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Groups of (row, offset, code points) of about PIECE characters; texts shorter than least are left out."""
        group, total = [], 0
        for i, t in enumerate(texts):
            if len(t) < least:
                continue
            code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            for at in range(0, max(1, len(code) - least + 1), PIECE):
                part = code[at : at + PIECE + least - 1]
                if total and total + len(part) > size - width:
                    yield group
                    group, total = [], 0
                group.append((i, at, part))
                total += len(part)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = _powers(size)
        for b in batches:
            for group in pieces(b.column(1).to_pylist()):
                lengths = np.array([len(p) for _, _, p in group])
                ends = np.cumsum(lengths)
                code = np.concatenate([p for _, _, p in group]).astype(np.uint64) + np.uint64(1)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(code * up[: len(code)], dtype=np.uint64)])
                h = (sums[unit:] - sums[:-unit]) * down[: len(code) - unit + 1]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                n = len(h)
                ranked = (h & ~np.uint64(0xFFFFF)) | np.arange(n, dtype=np.uint64)
                pad = -n % width
                blocks = np.concatenate([ranked, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
                ahead = np.minimum.accumulate(blocks, axis=1).ravel()
                behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
                least_of = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
                inside = np.zeros(n - width + 1, bool)  # windows that lie within one text
                for s, e in zip(ends - lengths, ends):
                    inside[s : e - least + 1] = True
                at = np.unique((least_of[inside] & np.uint64(0xFFFFF)).astype(np.int64))
                piece = np.searchsorted(ends, at, side="right")
                # a periodic run gives the same unit again and again, at one step: its first place and the step stand for all
                step = np.diff(at)
                same = (h[at[1:]] == h[at[:-1]]) & (step < unit) & (piece[1:] == piece[:-1])
                same[1:] &= ~(same[:-1] & (step[1:] != step[:-1]))
                keep = ~np.concatenate([[False], same])
                step = np.append(np.where(same, step, 0), 0)[keep]
                at, piece = at[keep], piece[keep]
                row = np.array([i for i, _, _ in group])[piece]
                offset = np.array([o for _, o, _ in group])[piece] - (ends - lengths)[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), b.column(0).take(pa.array(row)), pa.array((at + offset).astype(np.int32)), pa.array(step.astype(np.int32))],
                    ["unit", "doc", "pos", "step"],
                )

    return run


def content_units(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, unit: int = UNIT) -> DataFrame:
    """(unit, doc, pos, step): the digests and offsets of the units of every text of least characters or more.

    A unit that comes again at the same step of less than its length is one row, of its first place; else step is 0.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= least)
    return rows.mapInArrow(_units(least, unit), "unit long, doc long, pos int, step int").distinct()


def _common(a: str, b: str, i: int, j: int, step: int) -> int:
    """How many characters agree from a[i], b[j] on, forwards or (step -1) before them."""
    most = min(len(a) - i, len(b) - j) if step > 0 else min(i, j)

    def agree(lo: int, hi: int) -> bool:
        return a[i + lo : i + hi] == b[j + lo : j + hi] if step > 0 else a[i - hi : i - lo] == b[j - hi : j - lo]

    n, stride = 0, 64
    while n < most and agree(n, min(most, n + stride)):
        n = min(most, n + stride)
        stride *= 2
    lo, hi = n, min(most, n + stride)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if agree(lo, mid) else (lo, mid - 1)
    return lo


def _periodic(t: str, at: int, step: int) -> tuple[int, int]:
    """The borders of the run around t[at] that repeats every step characters."""
    return at - _common(t, t, at, at + step, -1), at + step + _common(t, t, at, at + step, 1)


def _repeated(s: str, t: str, i: int, j: int, step: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start in s, start in t, length) of alignments of two runs of one period, of which s[i] and t[j] are equal places.

    Runs agree wherever they overlap in phase, and no further unless their borders meet. Of the alignments with an overlap
    of least characters so many are given that they cover what all of them cover in both texts, the longest among them.
    """
    (a, a_end), (b, b_end) = _periodic(s, i, step), _periodic(t, j, step)
    up = lambda d: d + (i - j - d) % step
    down = lambda d: d - (d - i + j) % step
    borders = (a - b, a_end - b_end)
    for d in {x for x in borders if x == up(x)}:
        at = max(a, b + d)
        before, after = _common(s, t, at, at - d, -1), _common(s, t, at, at - d, 1)
        if before + after >= least:
            yield at - before, at - d - before, before + after
    if min(a_end - a, b_end - b) >= least:
        first, last = a + least - b_end, a_end - least - b
        tried = {up(first), down(last), *range(up(first), last + 1, least // step * step), *(f(x) for f in (up, down) for x in borders)}
        for d in tried - set(borders):
            if first <= d <= last:
                at = max(a, b + d)
                yield at, at - d, min(a_end, b_end + d) - at


def _runs(least: int, unit: int):
    def places(t: str, at: int, step: int) -> range:
        return range(at, _periodic(t, at, step)[1] - unit + 1, step) if step else range(at, at + 1)

    def shared(s: str, t: str, anchors: list[dict]) -> set[tuple[int, int, int]]:
        if s == t:
            return {(0, 0, len(s))}
        found, single, done = set(), set(), set()
        for p in anchors:
            i, j, step = p["pa"], p["pb"], p["sa"] or p["sb"]
            if s[i : i + unit] != t[j : j + unit]:
                continue
            if not step:
                single.add((i, j))
            elif p["sa"] and p["sb"] and p["sa"] != p["sb"]:
                single.update((x, y) for x in places(s, i, p["sa"]) for y in places(t, j, p["sb"]))
            else:
                runs = (_periodic(s, i, step), _periodic(t, j, step), step, (i - j) % step)
                if runs not in done:
                    done.add(runs)
                    found.update(_repeated(s, t, i, j, step, least))
        reached: dict[int, int] = {}
        for i, j in sorted(single):
            if reached.get(i - j, -1) > i:
                continue
            before, after = _common(s, t, i, j, -1), _common(s, t, i, j, 1)
            reached[i - j] = i + after
            if before + after >= least:
                found.add((i - before, j - before, before + after))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for x, y, s, t, anchors in zip(*(c.to_pylist() for c in b.columns)):
                for place in sorted(shared(s, t, anchors)):
                    for c, v in zip(out, (x, y, *place)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out], ["doc_a", "doc_b", "start_a", "start_b", "length"]
            )

    return run


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, unit: int = UNIT) -> DataFrame:
    """(doc_a, doc_b, start_a, start_b, length): the longest runs of least or more characters that two texts share.

    doc_a < doc_b; offsets count code points of the text as stored. Nulls, empty and shorter texts share nothing.
    Equal texts give one run. Where both texts repeat with one period, the runs given cover all that any alignment does.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= least)
    copies = _copies(rows)
    firsts = rows.join(copies.where("doc <> first").select("doc"), "doc", "left_anti")
    units = cut(content_units(firsts, "doc", "text", least, unit))
    held = units.groupBy("unit").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("unit")
    common = units.join(held, "unit")
    a, b = common.alias("a"), common.alias("b")
    met = a.join(b, F.expr("a.unit = b.unit AND a.doc < b.doc")).select(
        F.col("a.doc").alias("doc_a"), F.col("b.doc").alias("doc_b"), F.struct(F.col("a.pos").alias("pa"), F.col("a.step").alias("sa"), F.col("b.pos").alias("pb"), F.col("b.step").alias("sb")).alias("at"),
    )
    pairs = cut(met.groupBy("doc_a", "doc_b").agg(F.collect_set("at").alias("anchors")))
    ids = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct()
    texts = firsts.join(ids, "doc", "left_semi").dropDuplicates(["doc"])
    both = (
        pairs.join(texts.select(F.col("doc").alias("doc_a"), F.col("text").alias("text_a")), "doc_a")
        .join(texts.select(F.col("doc").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
        .select("doc_a", "doc_b", "text_a", "text_b", "anchors")
    )
    runs = both.mapInArrow(_runs(least, unit), "doc_a long, doc_b long, start_a long, start_b long, length long")
    return _of_copies(runs, copies)


def _copies(rows: DataFrame) -> DataFrame:
    """(doc, first, length) of each text that has copies; the first is the smallest of its key."""
    named = rows.select("doc", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.length("text").cast("long").alias("length")).distinct()
    groups = named.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    return stored(named.join(groups, ["h1", "h2"]).select("doc", "first", "length"))


def _of_copies(runs: DataFrame, copies: DataFrame) -> DataFrame:
    """The runs between first texts as those of all their copies, and the copies' own: as long as what is asked for."""
    more = copies.select(F.col("first"), F.col("doc").alias("copy"))
    for c, o in ("ab", "ba"):
        runs = runs.join(more.withColumnRenamed("first", f"doc_{c}"), f"doc_{c}", "left")
        runs = runs.select(F.coalesce("copy", f"doc_{c}").alias(f"doc_{c}"), f"doc_{o}", f"start_{c}", f"start_{o}", "length")
    swap = F.col("doc_a") > F.col("doc_b")
    either = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    runs = runs.select(either("doc_a", "doc_b", "doc_a"), either("doc_b", "doc_a", "doc_b"), either("start_a", "start_b", "start_a"), either("start_b", "start_a", "start_b"), "length")
    x, y = copies.alias("x"), copies.alias("y")
    same = x.join(y, F.expr("x.first = y.first AND x.doc < y.doc"))
    zero = F.lit(0).cast("long")
    return runs.unionByName(same.select(F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b"), zero.alias("start_a"), zero.alias("start_b"), F.col("x.length").alias("length")))


def _lines(separator: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, no, starts, ends, units = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = 0
                for k, part in enumerate(text.split(separator)):
                    unit = part.strip(" \t\r\n")
                    if len(unit) >= least:
                        lead = len(part) - len(part.lstrip(" \t\r\n"))
                        docs.append(doc), no.append(k), starts.append(at + lead), ends.append(at + lead + len(unit)), units.append(unit)
                    at += len(part) + len(separator)
            ids = digests(collapse(consistent(u)).casefold() for u in units)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(no, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1])],
                ["doc", "unit_no", "start", "end", "u1", "u2"],
            )

    return run


def duplicate_units(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n", least: int = 1) -> DataFrame:
    """(doc, unit_no, start, end, kept_doc, kept_unit_no) of each line that equals an earlier one when normalised.

    Rank is the order of (key, unit number). start and end are offsets into the text as stored, so cutting them out removes
    the duplicates. Nulls and empty lines have no unit; a unit may occur in any number of texts.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    units = rows.mapInArrow(_lines(separator, least), "doc long, unit_no int, start long, end long, u1 long, u2 long")
    first = (
        units.groupBy("u1", "u2")
        .agg(F.min(F.struct("doc", "unit_no")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("u1", "u2", F.col("first.doc").alias("kept_doc"), F.col("first.unit_no").alias("kept_unit_no"))
    )
    return units.join(first, ["u1", "u2"]).where("doc <> kept_doc OR unit_no <> kept_unit_no").drop("u1", "u2")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, start, end, part = [], [], [], []
        for key, text, removed in zip(*(c.to_pylist() for c in b.columns)):
            at = 0
            for lo, hi in [*((r["start"], r["end"]) for r in removed or []), (len(text), len(text))]:
                if text[at:lo].strip():
                    doc.append(key), start.append(at), end.append(lo), part.append(text[at:lo])
                at = hi
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(part, pa.string())], ["doc_id", "start", "end", "text"])


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n", least: int = 1) -> DataFrame:
    """(doc_id, start, end, text): the pieces of each text that are left without its duplicate units, with their original offsets.

    Pieces of white space alone are left out; a text of which nothing is left has no row. A repeated key is one text's.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull()).dropDuplicates(["doc"])
    removed = duplicate_units(rows, "doc", "text", separator, least).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    return rows.join(removed, "doc", "left").mapInArrow(_cut_out, "doc_id long, start long, end long, text string")


def shared_lengths(runs: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, shared_chars, partners) of each text with a shared run: characters covered by its runs, once each."""
    sides = runs.select(F.col("doc_a").alias(key), F.col("start_a").alias("s"), "length", F.col("doc_b").alias("partner")).union(
        runs.select("doc_b", "start_b", "length", "doc_a")
    )
    partners = sides.groupBy(key).agg(F.countDistinct("partner").alias("partners"))
    covered = sides.groupBy(key, "s").agg(F.max(F.col("s") + F.col("length")).alias("e"))
    before = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    covered = covered.withColumn("from", F.greatest("s", F.coalesce(F.max("e").over(before), F.lit(0))))
    chars = covered.groupBy(key).agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.col("from"))).alias("shared_chars"))
    sizes = docs.select(F.col(key).cast("long").alias(key), F.length(text).cast("long").alias("n_chars")).dropDuplicates([key])
    return chars.join(partners, key).join(sizes, key).select(key, "n_chars", "shared_chars", "partners")
