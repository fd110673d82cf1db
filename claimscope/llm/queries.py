"""Queries of the corpus operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.functions.claim_text import plain_key
from claimscope.llm import formatcopies, leakage, lookalike, mixing, neardup, patterns, spans
from claimscope.operators.timestamps import instant_micros
from claimscope.runtime import cut, stored, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    texts = neardup.representatives(table(spark, d, "posts"))
    return neardup.similar_pairs(texts, neardup.CLAIMS).select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p1_known_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The known pairs that the near-duplicate operator finds, with their similarity; expect says what each should be."""
    known = table(spark, d, "fingerprint_known_pairs")
    sides = known.select((F.col("pair_id") * 2).alias("seq"), F.col("a").alias("text")).union(known.select((F.col("pair_id") * 2 + 1), "b"))
    found = neardup.similar_pairs(sides, neardup.CLAIMS).where("a % 2 = 0 AND b = a + 1")
    return known.select("pair_id", "expect").join(found.select((F.col("a") / 2).cast("long").alias("pair_id"), "similarity"), "pair_id")


def p4_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Authors and fingerprints of the claims, once each for every combination of day, fp_kind and evidence_class.

    A claim's day is that of its created_at, or of its arrival if created_at means no instant. The counts are exact.
    """
    claims = table(spark, d, "claim_history").select(
        "author_did",
        plain_key(F.col("claim_fingerprint")).alias("fingerprint"),
        F.to_date(F.coalesce(F.timestamp_micros(instant_micros(F.col("created_at"))), F.col("observed_at"))).alias("day"), "fp_kind", "evidence_class",
    )
    return _counted(claims)


def p4_distinct_by_arrival(spark: SparkSession, d: str) -> DataFrame:
    """As p4_distinct_counts, by day of arrival, from two parts that are kept apart: live claims and the others."""
    claims = table(spark, d, "claim_history").select(
        "author_did", plain_key(F.col("claim_fingerprint")).alias("fingerprint"), F.to_date("observed_at").alias("day"), "fp_kind", "evidence_class", "provenance"
    )
    live = F.coalesce(F.col("provenance") == "jetstream", F.lit(False))
    return _counted(claims.where(live), claims.where(~live))


def _counted(*parts: DataFrame) -> DataFrame:
    """Counts over all parts. Of several, each part's memberships are stored for themselves and then merged."""
    groups = ["day", "fp_kind", "evidence_class"]
    out = None
    for name in ("author_did", "fingerprint"):
        members = [patterns.memberships(p, F.col(name), {g: F.col(g) for g in groups}) for p in parts]
        totals = patterns.patterns(members[0] if len(parts) == 1 else patterns.merge(*map(stored, members)))
        part = patterns.combination_counts(totals, groups).select(F.lit(name).alias("identifier"), "grouping", F.col("day").cast("string").alias("day"), "fp_kind", "evidence_class", "n", F.lit(0.0).alias("error_bound"))
        out = part if out is None else out.unionByName(part)
    return out


def p4_day_authors(spark: SparkSession, d: str) -> DataFrame:
    """Distinct authors of a fingerprint in a day of arrivals, beside what adding up its hourly figures would give."""
    hour = F.hour("ctime").alias("hour")
    events = table(spark, d, "post_events").select("author", F.col("claim_fingerprint").alias("fingerprint"), F.to_date("ctime").alias("day"), hour).where("fingerprint IS NOT NULL AND day IS NOT NULL")
    totals = patterns.patterns(patterns.memberships(events, F.col("author"), {"hour": F.col("hour")}, {"fingerprint": F.col("fingerprint"), "day": F.col("day")}))
    counts = patterns.combination_counts(totals, ["hour"])
    authors, added = F.sum(F.when(F.col("grouping") == "", F.col("n"))), F.sum(F.when(F.col("grouping") == "hour", F.col("n")))
    return counts.groupBy("fingerprint", F.col("day").cast("string").alias("day")).agg(authors.alias("authors"), added.alias("added_up"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "posts"))


def p6_consistent_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_forms(table(spark, d, "posts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    posts = formatcopies.text_groups(table(spark, d, "posts")).withColumn("record_table", F.lit("posts"))
    claims = formatcopies.record_groups(table(spark, d, "claim_history"), "seq", ["author_did", "post_uri"], "claim_fingerprint")
    both = posts.unionByName(claims.withColumn("record_table", F.lit("claim_history")))
    return both.where("seq <> first_seq").select("record_table", "first_seq", F.col("seq").alias("copy_seq"))


def p7_claim_copies(spark: SparkSession, d: str) -> DataFrame:
    """Claims stored more than once: the first record and its number of copies."""
    groups = formatcopies.record_groups(table(spark, d, "claim_history"), "seq", ["author_did", "post_uri"], "claim_fingerprint")
    return groups.where("seq = first_seq").select("first_seq", "copies")


def p7_collapsed_posts(spark: SparkSession, d: str) -> DataFrame:
    return formatcopies.collapsed_posts(table(spark, d, "posts"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_near_matches(spark: SparkSession, d: str) -> DataFrame:
    """Items of which a document holds a window but for a few words moved or replaced, with the least displacement found."""
    index = leakage.PositionalIndex.build(table(spark, d, "documents"))
    return index.near(table(spark, d, "eval_items")).groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.min("slack").alias("slack"), F.countDistinct("win").alias("windows"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(cut(mixing.token_lengths(table(spark, d, "documents"))), table(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    lengths, targets = cut(mixing.token_lengths(table(spark, d, "documents"))), table(spark, d, "source_targets")
    return mixing.reached(mixing.mix(lengths, targets), lengths, targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents")).select("doc_a", "doc_b").distinct()


def p10_shared_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Of each document that shares long passages: how many of its characters are found elsewhere, and in how many others."""
    docs = table(spark, d, "documents")
    return spans.shared_lengths(spans.shared_spans(docs), docs)


def p10_duplicate_lines(spark: SparkSession, d: str) -> DataFrame:
    return spans.duplicate_units(table(spark, d, "documents"))


def p10_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each document without the lines that an earlier one holds, as pieces of the text as stored."""
    return spans.without_duplicates(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_known_pairs, p4_distinct_counts, p4_distinct_by_arrival, p4_day_authors, p6_found, p6_consistent_forms, p7_found, p7_claim_copies,
    p7_collapsed_posts, p8_found, p8_near_matches, p9_mixture, p9_shares, p10_found, p10_shared_lengths, p10_duplicate_lines, p10_deduplicated,
)}
