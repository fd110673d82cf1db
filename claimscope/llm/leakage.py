"""Evaluation texts inside training texts (problem 8): a distributed positional inverted index.

The index is partitioned by document: a shard holds the postings (term, position) of a run of documents as sorted arrays,
one row a shard, and is stored in the shared folder, so it can be searched again with other items. A search takes each
item's windows of ``run`` successive words to every shard: it starts from the shortest list of a window's terms, moves
its positions back by the term's place, and keeps the starts that the other lists, next rarest first, agree with. What
all lists agree with is an exact phrase. A proximity match is a place where a stated share of the words stand within a few
words of where the phrase has them, whichever words those are. No postings are shuffled.

Items' windows are made by the tasks and stored, and sent to the shards in blocks of bounded size, one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from claimscope.llm.textform import words
from claimscope.runtime import cut, scratch, stored

RUN, ANCHORS, SHARE = 10, 3, 0.8
#: Tokens of a shard, and documents at most; windows of a block of items.
SHARD_TOKENS, SHARD_DOCS, BLOCK = 1 << 20, 1 << 16, 200_000
#: Places that a proximity search looks at in one go.
PLACES = 1 << 20

_SHARD = pa.schema([("docs", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("term_starts", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))])


def _term(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    docs: list[int] = []
    starts: list[int] = []
    tokens: list[int] = []

    def full() -> pa.RecordBatch:
        t = np.array(tokens, np.int64)
        order = np.argsort(t, kind="stable").astype(np.int32)
        terms, at = np.unique(t[order], return_index=True)
        row = [docs, starts, terms, at.astype(np.int32), order]
        return pa.RecordBatch.from_arrays([pa.array([r], f.type) for r, f in zip(row, _SHARD)], schema=_SHARD)

    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            docs.append(doc), starts.append(len(tokens))
            for w in words(text):
                k = names.get(w)
                if k is None:
                    k = names[w] = _term(w)
                tokens.append(k)
            if len(names) > 500_000:
                names = {}
            if len(tokens) >= SHARD_TOKENS or len(docs) >= SHARD_DOCS:
                yield full()
                docs, starts, tokens = [], [], []
    if docs:
        yield full()


def _postings(b: pa.RecordBatch, i: int, vocabulary: np.ndarray):
    """A shard's documents and their edges, its positions, and of each word of the vocabulary its place among the terms, first posting and count."""
    docs, doc_starts, terms, term_starts, positions = (np.asarray(c[i].values) for c in b.columns)
    ends = np.append(term_starts, len(positions))
    place = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
    known = terms[place] == vocabulary
    lo = np.where(known, ends[place], 0).astype(np.int64)
    count = np.where(known, ends[place + 1] - lo, 0)
    # keys order postings by (term, position), so one binary search looks a posting up
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(ends)) << 32) | positions
    return docs, np.append(doc_starts, len(positions)).astype(np.int64), positions, place.astype(np.int64), lo, count, keys


def _places(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all postings of lists that start at lo and have n of them."""
    return np.repeat(np.arange(len(n)), n), np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _phrases(items: np.ndarray, wins: np.ndarray, windows: np.ndarray):
    """items, wins: of each window; windows: its terms, one row a window."""
    run = windows.shape[1]
    vocabulary, index = np.unique(windows, return_inverse=True)
    index = index.reshape(windows.shape)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if not len(b.column(2)[i].values):
                    continue
                docs, edge, positions, place, lo, count, keys = _postings(b, i, vocabulary)
                use = np.flatnonzero((count[index] > 0).all(axis=1))
                if not len(use):
                    continue
                rarest = np.argsort(count[index[use]], axis=1, kind="stable")
                first = index[use, rarest[:, 0]]
                win, at = _places(lo[first], count[first])
                start = positions[at].astype(np.int64) - rarest[win, 0]
                doc = np.searchsorted(edge[:-1], start + rarest[win, 0], side="right") - 1
                keep = (start >= edge[doc]) & (start + run <= edge[doc + 1])
                for j in range(1, run):
                    win, start, doc = win[keep], start[keep], doc[keep]
                    if not len(win):
                        break
                    want = (place[index[use[win], rarest[win, j]]] << 32) | (start + rarest[win, j])
                    keep = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
                if len(win) == len(keep):
                    win, start, doc = win[keep], start[keep], doc[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[doc]), pa.array(items[use[win]]), pa.array(wins[use[win]]), pa.array(start - edge[doc]), pa.array(np.zeros(len(win), np.int64))], ["doc", "item", "win", "start", "slack"]
                )

    return search


def _near(items: np.ndarray, wins: np.ndarray, windows: np.ndarray, order: np.ndarray, slop: int, need: int):
    """order: the words of each window, rarest in the corpus first; need: how many of them must stand near their places."""
    run = windows.shape[1]
    missing = run - need
    vocabulary, index = np.unique(windows, return_inverse=True)
    index = index.reshape(windows.shape)
    same = (windows[:, :, None] == windows[:, None, :]) & np.tri(run, k=-1, dtype=bool)
    earlier = np.where(same.any(axis=2), run - 1 - same[:, :, ::-1].argmax(axis=2), -1)  # the last place before with the same word

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if not len(b.column(2)[i].values):
                    continue
                docs, edge, positions, place, lo, count, keys = _postings(b, i, vocabulary)
                keys = np.append(keys, np.int64(2**63 - 1))

                def after(term, at):
                    """The first posting of the term at a position or behind it."""
                    return np.searchsorted(keys, (place[term] << 32) + at)

                def within(term, k, upto):
                    return (count[term] > 0) & (keys[k] <= (place[term] << 32) + upto)

                def verified(win, start, doc):
                    """(words present, slack) of places; a posting stands for one word of a window only."""
                    first, last = edge[doc], edge[doc + 1] - 1
                    present, slack = np.zeros(len(win), np.int64), np.zeros(len(win), np.int64)
                    used = np.full((len(win), run + 1), -1, np.int64)
                    for j in range(run):
                        term, want = index[win, j], start + j
                        before = used[np.arange(len(win)), earlier[win, j]]  # -1 gives the last column: none
                        k = np.maximum(after(term, np.maximum(want - slop, first)), before + 1)
                        ok = within(term, k, np.minimum(want + slop, last))
                        used[:, j] = np.where(ok, k, before)
                        present += ok
                        k = after(term, np.clip(want, first, last + 1))
                        away = np.full(len(win), slop + 1)
                        for c in (k - 1, k):
                            p = keys[c] - (place[term] << 32)
                            away = np.where((count[term] > 0) & (p >= first) & (p <= last), np.minimum(away, np.abs(p - want)), away)
                        slack = np.maximum(slack, np.where(away <= slop, away, 0))
                    return present, slack

                def found(win, at, col, r):
                    p = positions[at].astype(np.int64)
                    start, doc = p - col, np.searchsorted(edge[:-1], p, side="right") - 1
                    # rarer words are taken as absent: where one is there, its own postings lead to the place
                    lost = np.full(len(win), r)
                    for j in range(r + 1, run):
                        o = order[win, j]
                        term, want = index[win, o], start + o
                        k = after(term, np.maximum(want - 2 * slop, edge[doc]))
                        lost += ~within(term, k, np.minimum(want + 2 * slop, edge[doc + 1] - 1))
                        keep = lost <= missing
                        win, start, doc, lost = win[keep], start[keep], doc[keep], lost[keep]
                    best, move = np.full(len(win), np.iinfo(np.int64).max), np.zeros(len(win), np.int64)
                    for e in sorted(range(-slop, slop + 1), key=abs):
                        present, slack = verified(win, start + e, doc)
                        better = (present >= need) & (slack < best)
                        best, move = np.where(better, slack, best), np.where(better, e, move)
                    hit = best <= slop
                    return np.stack([doc[hit], win[hit], (start + move)[hit], best[hit]])

                rows = []
                for r in range(missing + 1):
                    seed = index[np.arange(len(index)), order[:, r]]
                    ends = np.cumsum(count[seed])
                    at = 0
                    while at < len(seed):
                        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, side="right")))
                        win, k = _places(lo[seed[at:upto]], count[seed[at:upto]])
                        if len(win):
                            rows.append(found(win + at, k, order[win + at, r], r))
                        at = upto
                if not rows:
                    continue
                doc, win, start, slack = np.unique(np.concatenate(rows, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[doc]), pa.array(items[win]), pa.array(wins[win]), pa.array(start - edge[doc]), pa.array(slack)], ["doc", "item", "win", "start", "slack"]
                )

    return search


def _windows(run: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, win, terms = [], [], []
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                t = [_term(w) for w in words(text)]
                for i in range(len(t) - run + 1):
                    item.append(key), win.append(i), terms.append(t[i : i + run])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(win, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["item", "win", "terms"])

    return make


def _counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                if len(b.column(2)[i].values):
                    n = _postings(b, i, vocabulary)[5]
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0].astype(np.int64))], ["word", "n"])

    return run


class PositionalIndex:
    """The stored postings of a corpus; nulls have none, and a repeated row is a document of its own with the same id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> "PositionalIndex":
        path = path or scratch(docs.sparkSession, "positional")
        rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        kinds = "docs array<long>, doc_starts array<int>, terms array<long>, term_starts array<int>, positions array<int>"
        rows.mapInArrow(_shards, kinds).write.mode("overwrite").parquet(path)
        return cls(docs.sparkSession, path)

    def _found(self, items: DataFrame, key: str, text: str, run: int, search) -> DataFrame:
        """The search of all windows. They are made by the tasks and stored; the driver holds one block of them at a time."""
        kinds = "doc long, item long, win long, start long, slack long"
        rows = items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        windows = rows.mapInArrow(_windows(run), "item long, win long, terms array<long>").distinct()
        windows = cut(windows)
        blocks = math.ceil(windows.count() / BLOCK)
        shards = self.spark.read.parquet(self.path)
        found = self.spark.createDataFrame([], kinds)
        for n in range(blocks):
            part = windows.where(F.pmod(F.xxhash64("item", "win"), F.lit(blocks)) == n).toArrow()
            terms = part.column("terms").combine_chunks().flatten().to_numpy().reshape(-1, run)
            block = part.column("item").to_numpy(), part.column("win").to_numpy(), terms
            hits = shards.mapInArrow(search(shards, block), kinds)
            found = found.unionByName(hits if blocks == 1 else stored(hits))
        return found

    def phrases(self, items: DataFrame, run: int = RUN, key: str = "item_id", text: str = "text") -> DataFrame:
        """(doc, item, win, start): the document holds the item's words from win on, run of them, at its word start."""
        return self._found(items, key, text, run, lambda _, block: _phrases(*block)).drop("slack")

    def near(self, items: DataFrame, run: int = RUN, slop: int = 4, anchors: int = ANCHORS, key: str = "item_id", text: str = "text", share: float = SHARE) -> DataFrame:
        """(doc, item, win, start, slack): share of a window's words, and at least anchors, each within slop words of its place from start on.

        The others may be missing, in the document or in all of them. A posting counts for one word. slack is the largest distance
        of the words that are there; 0: these words stand as in a phrase. start is before the document where its first words are missing.
        Of the starts around a posting of one of the rarest words the one of least slack is given; which words those are follows their
        counts in all shards, and does not change which windows match nor their least slack.
        """
        need = max(1, math.ceil(share * run - 1e-9), min(anchors, run))

        def search(shards: DataFrame, block: tuple[np.ndarray, np.ndarray, np.ndarray]):
            vocabulary, index = np.unique(block[2], return_inverse=True)
            n = np.zeros(len(vocabulary), np.int64)
            for r in shards.mapInArrow(_counts(vocabulary), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
                n[r.word] = r.n
            order = np.argsort(n[index.reshape(block[2].shape)], axis=1, kind="stable")
            return _near(*block, order, slop, need)

        return self._found(items, key, text, run, search)


def leaked_items(docs: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id): documents that hold at least run successive words of an item, both in the consistent form.

    Nulls, empty texts, and items shorter than run words match nothing. Repeated rows match once.
    """
    found = PositionalIndex.build(docs).phrases(items, run)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()
