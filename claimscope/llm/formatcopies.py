"""Duplicates hidden by formatting (problem 7): dictionary encoding.

Each distinct value of a column is canonicalised once, over the whole table. Each distinct canonical value is given an integer in a
stored dictionary, records are rewritten as sorted tuples of these integers, and only the compact tuples are grouped. Group sizes are
sums and first members minima, so a value or a group may hold any part of the rows.

A text has up to two canonical values: its letters and digits, and the tuple of its named fields. Texts that agree in either are in one
group, and so are texts linked by a chain of such agreements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.functions.claim_text import plain_key
from claimscope.llm.arrow import digests, list_array
from claimscope.llm.textform import format_free
from claimscope.runtime import cut, stored

_PAIR = "array<struct<k1:bigint,k2:bigint>>"


def _canonical_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's text replaced by the identifiers of its plain form and of its fields; without letter or digit it goes."""
    for b in batches:
        plain, fields = [], []
        for value in b.column(b.num_columns - 1).to_pylist():
            p, f = format_free(value)
            plain.append(p)
            fields.append(f)
        ids = digests(plain)
        ends = np.concatenate([[0], np.cumsum([2 * len(f) for f in fields])]).astype("int32")
        units = list_array(digests(x for f in fields for x in f).reshape(-1), ends)
        out = pa.RecordBatch.from_arrays(
            [*b.columns[:-1], pa.array(ids[:, 0]), pa.array(ids[:, 1]), units], [*b.schema.names[:-1], "k1", "k2", "units"]
        )
        yield out.filter(pa.array([bool(p) for p in plain]))


def _hashed(value: F.Column) -> tuple[F.Column, F.Column]:
    return F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")


def _numbered(keys: DataFrame) -> DataFrame:
    """A dictionary: the distinct keys, each with an integer of its own. It is stored, so the integers hold from then on."""
    return stored(keys.distinct().withColumn("id", F.monotonically_increasing_id()))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the links (a, b) is connected to. Rounds grow as the logarithm of a chain's length."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        nearer = labels.join(near, "node").select("node", "root", F.least("root", "least").alias("next"))
        onward = nearer.select(F.col("node").alias("next"), F.col("next").alias("last"))
        moved = cut(nearer.join(onward, "next").select("node", "root", F.col("last").alias("next")))
        labels = moved.select("node", F.col("next").alias("root"))
        if moved.where("next < root").isEmpty():
            return labels


def text_groups(texts: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """(seq, first_seq, copies) of each text that has copies: texts equal in letters and digits, or in their named fields.

    A text without fields that equals one with fields in its letters and digits is in the latter's group. Nulls and texts without
    letter or digit are in no group.
    """
    rows = texts.select(F.col(key).cast("long").alias("seq"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    values = rows.groupBy(*_hashed(F.col("text"))).agg(F.min("seq").alias("first"), F.count("*").alias("n"), F.first("text").alias("text"))
    kinds = "h1 long, h2 long, first long, n long, k1 long, k2 long, units array<long>"
    coded = stored(values.mapInArrow(_canonical_texts, kinds))
    # each distinct plain form has an integer, and what its values add up to
    forms = coded.groupBy("k1", "k2").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    forms = stored(forms.withColumn("form", F.monotonically_increasing_id()))
    unit = F.expr("transform(sequence(0, size(units) - 1, 2), i -> struct(units[i] AS k1, units[i + 1] AS k2))").cast(_PAIR)
    named = coded.where("size(units) > 0")
    units = named.select("h1", "h2", F.explode(unit).alias("u")).select("h1", "h2", "u.*")
    tuples = units.join(_numbered(units.select("k1", "k2")), ["k1", "k2"]).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("tuple"))
    held = named.select("h1", "h2", "k1", "k2").join(tuples, ["h1", "h2"]).join(forms.select("k1", "k2", "form"), ["k1", "k2"])
    held = stored(held.select("form", "tuple").distinct())
    led = held.join(held.groupBy("tuple").agg(F.min("form").alias("leader")), "tuple").select("form", "leader").distinct()
    span = led.groupBy("form").agg(F.min("leader").alias("leader"), F.max("leader").alias("other"))
    chains = span.where("leader < other").select("form", F.col("leader").alias("a")).join(led.select("form", F.col("leader").alias("b")), "form")
    chains = cut(chains.where("a <> b").select("a", "b"))
    span = span.select("form", "leader")
    if not chains.isEmpty():
        roots = components(chains).select(F.col("node").alias("leader"), "root")
        span = span.join(roots, "leader", "left").select("form", F.coalesce("root", "leader").alias("leader"))
    forms = forms.join(span, "form", "left").select("k1", "k2", F.coalesce("leader", "form").alias("leader"), "first", "n")
    groups = forms.groupBy("leader").agg(F.min("first").alias("first_seq"), F.sum("n").alias("copies")).where("copies > 1")
    found = coded.select("h1", "h2", "k1", "k2").join(forms.join(groups, "leader"), ["k1", "k2"]).select("h1", "h2", "first_seq", "copies")
    return rows.select("seq", *_hashed(F.col("text"))).join(found, ["h1", "h2"]).select("seq", "first_seq", "copies")


def record_groups(records: DataFrame, key: str, exact: list[str], canonical: str) -> DataFrame:
    """(seq, first_seq, copies) of records equal in the exact columns and in the letters and digits of the canonical one.

    Records with a null in any of these columns are in no group.
    """
    columns = [*exact, canonical]
    rows = records.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    cells = F.array(*(F.struct(F.lit(n).alias("c"), F.col(c).cast("string").alias("v")) for n, c in enumerate(columns)))
    values = rows.select(F.explode(cells).alias("x")).groupBy("x.c", *_hashed(F.col("x.v"))).agg(F.first("x.v").alias("v"))
    form = F.when(F.col("c") == len(exact), plain_key(F.col("v"))).otherwise(F.col("v"))
    values = stored(values.select("c", "h1", "h2", F.xxhash64(form).alias("k1"), F.xxhash64(F.lit(1), form).alias("k2")))
    names = stored(values.join(_numbered(values.select("c", "k1", "k2")), ["c", "k1", "k2"]).select("c", "h1", "h2", "id"))
    hashes = [h.alias(f"{h_}_{n}") for n, c in enumerate(columns) for h_, h in zip(("h1", "h2"), _hashed(F.col(c).cast("string")))]
    coded = rows.select(F.col(key).cast("long").alias("seq"), *hashes)
    for n in range(len(columns)):
        of = names.where(F.col("c") == n).select(F.col("h1").alias(f"h1_{n}"), F.col("h2").alias(f"h2_{n}"), F.col("id").alias(f"id_{n}"))
        coded = coded.join(of, [f"h1_{n}", f"h2_{n}"]).drop(f"h1_{n}", f"h2_{n}")
    coded = stored(coded.select("seq", F.sort_array(F.array(*(f"id_{n}" for n in range(len(columns))))).alias("tuple")))
    groups = coded.groupBy("tuple").agg(F.min("seq").alias("first_seq"), F.count("*").alias("copies")).where("copies > 1")
    return coded.join(groups, "tuple").select("seq", "first_seq", "copies")


def collapsed_posts(texts: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """One record of each group of texts with its number of copies: (first_seq, copies, text of the first)."""
    groups = stored(text_groups(texts, key, text))
    first = groups.where("seq = first_seq").select(F.col("seq").alias(key), "copies")
    copies = groups.where("seq <> first_seq").select(F.col("seq").alias(key))
    return (
        texts.join(copies, key, "left_anti")
        .join(first, key, "left")
        .select(F.col(key).alias("first_seq"), F.coalesce("copies", F.lit(1)).alias("copies"), F.col(text).alias("text"))
    )
