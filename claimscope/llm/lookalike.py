"""Visually identical text (problem 6).

Texts are mapped to the consistent form in Arrow batches; SQL then groups the mapped values under
the accent- and case-sensitive Unicode collation, takes the smallest member of each class as its canonical
form and joins it back. Nulls get a null form; empty and symbol-only texts are forms like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.arrow import digests
from claimscope.llm.textform import collapse, consistent, has_text


def _forms(keep_form: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            mapped = [consistent(t) for t in texts]
            f, s = digests(mapped), digests(collapse(t) for t in texts)
            cols = [b.column(0), pa.array([has_text(t) for t in mapped]), *(pa.array(x) for x in (*f.T, *s.T))]
            names = ["seq", "has_text", "f1", "f2", "s1", "s2"]
            if keep_form:
                cols, names = [*cols, pa.array(mapped, pa.string())], [*names, "form"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


_SCHEMA = "seq long, has_text boolean, f1 long, f2 long, s1 long, s2 long"


def forms(texts: DataFrame, key: str = "seq", text: str = "text", keep_form: bool = True) -> DataFrame:
    """(seq, has_text, f1, f2: identifier of the mapped form, s1, s2: of the text as stored, form) of each non-null text."""
    rows = texts.select(F.col(key).cast("long").alias("seq"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    return rows.mapInArrow(_forms(keep_form), _SCHEMA + (", form string" if keep_form else ""))


def canonical_members(mapped: DataFrame) -> DataFrame:
    """Of mapped forms (f1, f2, form): (f1, f2, canonical, c1, c2) of those whose class under the collation holds others.

    Each distinct form is collated once. After mapping, a class rarely has two members, so the result is small; the
    forms it leaves out are their own canonical member.
    """
    spark = mapped.sparkSession
    return spark.sql(
        """
        WITH distinct_forms AS (SELECT f1, f2, form FROM {mapped} GROUP BY f1, f2, form),
        classes AS (
          SELECT form COLLATE UNICODE AS k, min(form) AS canonical, min_by(f1, form) AS c1, min_by(f2, form) AS c2
          FROM distinct_forms GROUP BY form COLLATE UNICODE HAVING count(*) > 1)
        SELECT d.f1, d.f2, c.canonical, c.c1, c.c2
        FROM distinct_forms d JOIN classes c ON d.form COLLATE UNICODE = c.k
        """,
        mapped=mapped,
    )


def consistent_forms(texts: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """(key, form): one consistent form of every text; texts that look the same have equal forms. Null stays null."""
    mapped = forms(texts, key, text)
    c = canonical_members(mapped.select("f1", "f2", "form"))
    known = mapped.join(c, ["f1", "f2"], "left").select(
        F.col("seq").alias(key), F.coalesce("canonical", "form").alias("form")
    )
    missing = texts.where(F.col(text).isNull()).select(F.col(key).cast("long").alias(key), F.lit(None).cast("string").alias("form"))
    return known.unionByName(missing)


def lookalike_pairs(texts: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """(seq_a, seq_b): texts with a letter or digit, equal in the consistent form but not as stored, smaller key first.

    Only classes with two or more stored forms are paired, and only their rows with different stored forms.
    Pairs are what is asked for, so the result of a class is as long as it has differing pairs.
    """
    canon = canonical_members(forms(texts, key, text).select("f1", "f2", "form"))
    rows = (
        forms(texts, key, text, keep_form=False)
        .where("has_text")
        .join(canon.select("f1", "f2", "c1", "c2"), ["f1", "f2"], "left")
        .select("seq", F.coalesce("c1", "f1").alias("c1"), F.coalesce("c2", "f2").alias("c2"), "s1", "s2")
    )
    mixed = (
        rows.groupBy("c1", "c2")
        .agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.min("s2").alias("lo2"), F.max("s2").alias("hi2"))
        .where("lo <> hi OR lo2 <> hi2")
        .select("c1", "c2")
    )
    rows = rows.join(mixed, ["c1", "c2"])
    a, b = rows.alias("a"), rows.alias("b")
    return a.join(
        b,
        F.expr("a.c1 = b.c1 AND a.c2 = b.c2 AND a.seq < b.seq AND (a.s1 <> b.s1 OR a.s2 <> b.s2)"),
    ).select(F.col("a.seq").alias("seq_a"), F.col("b.seq").alias("seq_b"))
