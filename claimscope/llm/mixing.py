"""Mixing sources to target weights (problem 9): subset-sum budget fitting on exact token lengths.

Documents are tokenised once with a public tokenizer and counted by (source, length). The total is the largest at which
every source can reach its share within its cap. A source then gives as many whole passes as fit its budget; what is
left of the budget is fitted by length: a proportional part of every length, then a bounded-knapsack table over the
small rest. Which documents of a length get the extra repeat is settled by a seeded hash.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from claimscope.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer's vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a source and length are spread over so many hash cells, to rank them without one task holding them all.
CELLS = 4096
#: Tokens that the proportional part leaves to the knapsack table, at least; with longer documents three times the longest.
ROOM = 1 << 15


def _lengths(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(SparkFiles.get(file), "rb"))}
        enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens) of each document with a source and a text; one row for each row given.

    tokenizer: a vocabulary file that the driver can read; it is sent to the executors.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    rows = docs.where(F.col(text).isNotNull() & F.col("source").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col(text).alias("text"))
    return rows.mapInArrow(_lengths(os.path.basename(tokenizer)), "doc_id long, source string, n_tokens long").where("n_tokens > 0")


def fit(budget: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many of each length to take so that their sum is as near below budget as can be found; never above.

    The proportional part keeps the mix of lengths. What it leaves is filled from the largest length down until the rest is a few of the
    longest documents, for which a bounded-knapsack table is exact: no other choice from what is left comes nearer. The table has a cell
    a token of that rest (five bytes; in units of the lengths' common divisor).
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    if budget <= 0 or not lengths:
        return [0] * len(lengths)
    # leave room for the table: it is exact, the proportional part is not
    room = min(budget, max(ROOM, 3 * max(lengths)))
    take = [(budget - room) * c // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        more = max(0, min(counts[i] - take[i], (rest - room) // lengths[i]))
        take[i] += more
        rest -= more * lengths[i]
    unit = math.gcd(*lengths)
    target = rest // unit
    by = np.full(target + 1, -1, np.int32)  # the step that first reached a sum
    reach, steps = np.zeros(target + 1, bool), []
    reach[0] = True
    for i in order:  # binary splitting of the number that is left of each length
        size = lengths[i] // unit
        left, part = min(counts[i] - take[i], target // size), 1
        while left > 0 and not reach[target]:
            n = min(part, left)
            fresh = np.flatnonzero(reach[: target + 1 - n * size] & ~reach[n * size :]) + n * size
            by[fresh], reach[fresh] = len(steps), True
            steps.append((i, n))
            left, part = left - n, part * 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i, n = steps[by[at]]
        take[i] += n
        at -= n * (lengths[i] // unit)
    return take


def budgets(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, budget): a row a target source; tokens as whole numbers.

    A source with a share but without tokens can't be mixed; its share is left out of the total and its budget is 0.
    """
    have = lengths.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    all_ = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    all_ = all_.join(have, "source", "left").na.fill(0, ["available"])
    usable = (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    most = all_.agg(F.min(F.when(usable, F.col("available") * F.col("max_repeats") / F.col("target_share"))).alias("total"))
    return all_.crossJoin(most).select(  # one row against the few targets
        "source", "target_share", "max_repeats", "available",
        F.when(usable, F.floor(F.col("total") * F.col("target_share") + 1e-6)).otherwise(F.lit(0)).cast("long").alias("budget"),
    )


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("n_tokens")
    have = int(pdf["available"].iloc[0])
    passes, rest = divmod(int(pdf["budget"].iloc[0]), have)
    cap = int(pdf["max_repeats"].iloc[0])
    if passes >= cap:
        passes, rest = cap, 0
    pdf["extra"] = fit(rest, pdf["n_tokens"].tolist(), pdf["n"].tolist()) if rest else 0
    pdf["passes"] = passes
    return pdf[["source", "n_tokens", "n", "passes", "extra"]]


def length_plan(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, n_tokens, n, passes, extra): of the n documents of a length, extra are used passes + 1 times.

    A source's histogram goes to one task; it has as many rows as there are different lengths, however many documents.
    """
    histogram = lengths.groupBy("source", "n_tokens").agg(F.count("*").alias("n"))
    return (
        histogram.join(budgets(lengths, targets).where("budget > 0"), "source")
        .groupBy("source")
        .applyInPandas(_fit_source, "source string, n_tokens long, n long, passes long, extra long")
    )


def mix(lengths: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, repeats) of the documents in the mixture, repeats at most the source's cap.

    Ties of the seeded hash go to the smaller doc_id; equal rows of one document are then told apart by nothing and
    each counts as a document.
    """
    plan = cut(length_plan(lengths, targets))
    docs = lengths.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("cell", F.pmod("h", F.lit(CELLS)))
    split = plan.where("extra > 0 AND extra < n")
    cells = docs.join(split.select("source", "n_tokens", "extra"), ["source", "n_tokens"]).groupBy("source", "n_tokens", "cell", "extra").agg(F.count("*").alias("m"))
    before = Window.partitionBy("source", "n_tokens").orderBy("cell")
    cells = cells.withColumn("before", F.sum("m").over(before) - F.col("m"))
    whole = cells.where(F.col("before") < F.col("extra")).select("source", "n_tokens", "cell", (F.col("extra") - F.col("before")).alias("take"), "m")
    # whole cells are taken as they are; only the documents of a cell that the border runs through are ranked
    kept = docs.join(whole, ["source", "n_tokens", "cell"])
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "cell").orderBy("h", "doc_id"))
    picked = kept.where("take >= m").unionByName(kept.where("take < m").withColumn("r", rank).where("r <= take").drop("r"))
    picked = picked.select("doc_id", "source", "n_tokens", F.lit(1).alias("more"))
    base = docs.join(plan.select("source", "n_tokens", "n", "passes", "extra"), ["source", "n_tokens"])
    base = base.select("doc_id", "source", "n_tokens", F.when(F.col("extra") == F.col("n"), F.col("passes") + 1).otherwise(F.col("passes")).alias("more"))
    return (
        base.unionByName(picked)
        .where("more > 0")
        .groupBy("doc_id", "source", "n_tokens")
        .agg(F.sum("more").cast("int").alias("repeats"))
    )


def reached(mixture: DataFrame, lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available, tokens, documents, most_repeats, share): what each source really gives."""
    got = mixture.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats")
    )
    rows = budgets(lengths, targets).drop("budget").join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    total = got.agg(F.sum("tokens").alias("total"))
    return rows.crossJoin(total).select("source", "target_share", "max_repeats", "available", "tokens", "documents", "most_repeats", (F.col("tokens") / F.col("total")).alias("share"))
