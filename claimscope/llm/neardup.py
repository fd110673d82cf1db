"""Near-duplicate texts with small edits (problem 1): sequential Bayesian verification of banded candidates.

1. Each text's set of successive words is hashed; 64 minimum hashes form its signature, pairs of them its bands.
2. Equal bands are candidates. A task that meets a bucket too often hands its members to the exact way (3) and
   marks the bucket, so no bucket ever gathers more than a few rows from each task; a bucket that is
   marked, or larger than ``bucket_limit`` in all, hands over its remaining members as well.
3. Members of such buckets are joined among themselves on the rarest part of their sets (prefix filter with counts
   over all members), which finds every pair at the threshold.
4. Sketches of the candidates' signatures are compared 16 values at a time; a pair is dropped as soon as the posterior
   probability (uniform prior) that it reaches the threshold falls under ``miss``. Survivors are verified on their sets.

A pair exactly at similarity 0.5 shares none of 28 bands with probability (1 - 0.25)^28 = 0.03 %.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.arrow import list_array
from claimscope.llm.formatcopies import text_groups
from claimscope.llm.textform import words
from claimscope.runtime import cut, stored

SIGNATURE, BATCH = 64, 16


@dataclass(frozen=True)
class Likeness:
    """words: in a row of a shingle; rows, bands: of the signature; miss: accepted probability of a wrong drop."""

    words: int = 5
    threshold: float = 0.8
    rows: int = 4
    bands: int = 16
    miss: float = 1e-5
    bucket_limit: int = 64


#: What pN_found of problem 1 asks for.
CLAIMS = Likeness(words=3, threshold=0.5, rows=2, bands=28)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches among n signature values with P(similarity >= threshold | matches) >= miss, uniform prior."""
    tail, m = 0.0, -1
    while tail < miss:
        m += 1
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
    return m


def shingle_ids(text: str, k: int) -> list[int]:
    w = words(text)
    return sorted({xxhash.xxh3_64_intdigest(" ".join(w[i : i + k])) for i in range(len(w) - k + 1)})


def signatures(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(SIGNATURE, n) minimum hashes of the non-empty sets that begin at starts."""
    multipliers = np.random.default_rng(20231027).integers(1, 2**63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((SIGNATURE, len(starts)), np.uint32)
    for k, a in enumerate(multipliers):
        out[k] = np.minimum.reduceat(((flat * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _prepared(like: Likeness):
    """(seq, shingles, sketch) of each text with a shingle; the sketch is the lowest byte of each signature value, enough to compare by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_ids(t, like.words) for t in b.column(1).to_pylist()]
            rows = np.array([i for i, s in enumerate(sets) if s], np.int64)
            if not len(rows):
                continue
            flat = np.array([x for s in sets for x in s], np.uint64)
            offsets = np.concatenate([[0], np.cumsum([len(sets[i]) for i in rows])])
            sig = np.ascontiguousarray(signatures(flat, offsets[:-1]).astype(np.uint8).T)
            sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIGNATURE), len(rows), [None, pa.py_buffer(sig)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column(0).to_numpy()[rows]), list_array(flat.view(np.int64), offsets.astype(np.int32)), sketch.cast(pa.binary())], ["seq", "shingles", "sketch"]
            )

    return run


#: kinds of band rows: a member of a bucket, a marked bucket, a member for the exact way.
MEMBER, MARK, HOT = 0, 1, 2


def _bands(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            sets = b.column(1)
            starts = sets.offsets.to_numpy()
            flat = sets.values.to_numpy()[starts[0] : starts[-1]].view(np.uint64)
            sig = signatures(flat, (starts - starts[0])[:-1]).astype(np.uint64)
            keys = np.empty((b.num_rows, like.bands), np.uint64)
            for j in range(like.bands):
                h = np.full(b.num_rows, j * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                for v in sig[j * like.rows : (j + 1) * like.rows]:
                    h = (h ^ v) * np.uint64(0xFF51AFD7ED558CCD)
                    h ^= h >> np.uint64(32)
                keys[:, j] = h
            keys = keys.view(np.int64)
            seq = b.column(0).to_numpy()
            found, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
            often = (count > like.bucket_limit) | np.isin(found, known)
            marks = found[often & ~np.isin(found, known)]
            known = np.concatenate([known, marks])
            mine = often[inverse.reshape(keys.shape)]
            hot = seq[mine.any(axis=1)]
            flat_keys, flat_seq = keys[~mine], np.repeat(seq, like.bands).reshape(keys.shape)[~mine]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([flat_keys, marks, hot * -0x61C8864680B583EB])),  # spread, not by bucket
                    pa.array(np.concatenate([np.full(len(flat_keys), MEMBER), np.full(len(marks), MARK), np.full(len(hot), HOT)]).astype(np.int8)),
                    pa.array(np.concatenate([flat_seq, np.zeros(len(marks), np.int64), hot])),
                ],
                ["bucket", "kind", "seq"],
            )

    return run


def _candidates(limit: int):
    """From band rows in order of bucket: pairs (a, b), a < b, of small buckets; members (a, null) of the others."""

    def close(key: np.ndarray, kind: np.ndarray, seq: np.ndarray, large: np.ndarray) -> pa.RecordBatch | None:
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        marked = np.logical_or.reduceat(kind == MARK, start) | (size > limit) | np.isin(key[start], large)
        alone = np.logical_or.reduceat(kind == HOT, start)
        a, b = [], []
        for s in np.unique(size[(size > 1) & ~marked & ~alone]):
            at = start[(size == s) & ~marked & ~alone][:, None] + np.arange(s)
            i, j = np.triu_indices(s, 1)
            x, y = seq[at[:, i]].ravel(), seq[at[:, j]].ravel()
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
        rest = np.repeat(marked, size) & (kind == MEMBER) | (kind == HOT)
        hot = np.unique(seq[rest])
        pairs = np.concatenate(a) if a else np.empty(0, np.int64)
        others = np.concatenate(b) if b else np.empty(0, np.int64)
        same = pairs == others
        if not len(pairs) and not len(hot):
            return None
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([pairs[~same], hot])),
                pa.array(np.concatenate([others[~same], hot]), mask=np.arange(len(pairs[~same]) + len(hot)) >= len(pairs[~same])),
            ],
            ["a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64)]
        large = np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns)]
            key = held[0]
            last = int(np.searchsorted(key, key[-1]))
            if len(key) - last > limit:  # known to be large, so its members need not wait for its end
                large, last = np.append(large[-1:], key[-1]), len(key)
            if last and (out := close(*(h[:last] for h in held), large)) is not None:
                yield out
            held = [h[last:] for h in held]
        if len(held[0]) and (out := close(*held, large)) is not None:
            yield out

    return run


def _plausible(like: Likeness):
    """Of pairs with both sketches, those whose posterior chance of reaching the threshold stays at miss or above.

    Bytes of different values are equal once in 256, which raises the threshold that matches are held against.
    """
    threshold = like.threshold + (1 - like.threshold) / 256
    least = [(n, least_matches(n, threshold, like.miss)) for n in range(BATCH, SIGNATURE + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for i in (2, 3))
            alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, m in least:
                matches = matches + (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                keep = matches >= m
                alive, matches, done = alive[keep], matches[keep], n
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in b.columns[:2]], ["a", "b"])

    return run


def _rare_pairs(sets: DataFrame, like: Likeness) -> DataFrame:
    """All pairs (a, b) of (seq, shingles) that can reach the threshold: those that share one of their rarest shingles."""
    each = sets.select("seq", F.size("shingles").alias("n"), F.explode("shingles").alias("x"))
    counted = each.join(each.groupBy("x").agg(F.count("*").alias("df")), "x")
    keep = F.col("n") - F.ceil(F.col("n") * like.threshold - 1e-9) + 1
    ranked = counted.groupBy("seq", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("xs"))
    prefix = ranked.select("seq", "n", F.explode(F.slice("xs", F.lit(1), keep.cast("int"))).alias("p")).select("seq", "n", "p.x")
    p, q = prefix.alias("p"), prefix.alias("q")
    near = F.expr(f"p.x = q.x AND p.seq < q.seq AND p.n >= q.n * {like.threshold} - 1e-9 AND q.n >= p.n * {like.threshold} - 1e-9")
    return p.join(q, near).select(F.col("p.seq").alias("a"), F.col("q.seq").alias("b"))


def _sides(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """The pairs with a column of both their members."""
    for c in "ab":
        pairs = pairs.join(of.select(F.col("seq").alias(c), F.col(column).alias(f"{column}_{c}")), c)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def similar_pairs(texts: DataFrame, like: Likeness = Likeness(), key: str = "seq", text: str = "text") -> DataFrame:
    """(a, b, similarity), a < b: texts whose shingle sets have a Jaccard similarity of the threshold or more.

    Texts should be representatives of their exact or format-free copies. Nulls, and texts with fewer words than a
    shingle, have an empty set and no pair. Of a repeated key any one row counts.
    """
    rows = texts.select(F.col(key).cast("long").alias("seq"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = stored(rows.mapInArrow(_prepared(like), "seq long, shingles array<long>, sketch binary"))
    repeated = cut(rows.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1").select("seq"))
    if not repeated.isEmpty():  # keys are meant to be unique, so only they are compared to find out
        once = rows.join(repeated, "seq", "left_semi").groupBy("seq").agg(F.min(F.struct("shingles", "sketch")).alias("x")).select("seq", "x.*")
        rows = stored(rows.join(repeated, "seq", "left_anti").unionByName(once))
    bands = rows.select("seq", "shingles").mapInArrow(_bands(like), "bucket long, kind byte, seq long")
    spread = bands.repartition(F.col("bucket")).sortWithinPartitions("bucket", "seq")
    found = cut(spread.mapInArrow(_candidates(like.bucket_limit), "a long, b long").distinct())

    def sets(wanted: DataFrame) -> DataFrame:
        return rows.select("seq", "shingles").join(wanted, "seq", "left_semi")

    pairs, hot = found.where("b IS NOT NULL"), found.where("b IS NULL").select(F.col("a").alias("seq"))
    if not hot.isEmpty():
        pairs = pairs.union(_rare_pairs(cut(sets(hot)), like)).distinct()
    likely = cut(_sides(pairs, rows, "sketch").mapInArrow(_plausible(like), "a long, b long"))
    both = _sides(likely, sets(likely.select(F.explode(F.array("a", "b")).alias("seq")).distinct()), "shingles")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    similarity = common / (F.size("shingles_a") + F.size("shingles_b") - common)
    return both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= like.threshold)


def representatives(texts: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """The texts without format-free copies of an earlier one."""
    copies = text_groups(texts, key, text).where("seq <> first_seq").select(F.col("seq").alias(key))
    return texts.join(copies, key, "left_anti")
