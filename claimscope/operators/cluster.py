"""Claim clusters over time: series, bursts, half-lives, entropy, label shifts.

A claim row is (fp, ts, author, confidence, evidence_class, fp_kind). Bins are the ones observed; gaps are never filled.
Per-fingerprint windows run over bins, not rows: the series is aggregated first (partially before the shuffle), so a hot
fingerprint is as long as its number of bins. All windows of one series share its partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASELINE_BINS, REGIME_BINS = 24, 168


def bin_of(ts: Column, hours: int) -> Column:
    """The start of the bin of so many hours within its UTC day; bins start anew at midnight if hours doesn't divide 24."""
    return F.date_trunc("day", ts) + F.make_interval(hours=(F.floor(F.hour(ts) / hours) * hours).cast("int"))


def timeseries(claims: DataFrame, hours: int = 1) -> DataFrame:
    """(fp, bin, posts, authors, avg_confidence). Rows without time are in no bin; missing confidences don't count.

    Means are rounded to 4 places, halves up, in whole numbers of billionths, so they don't depend on the order of rows.
    """
    billionths = F.sum(F.round(F.col("confidence") * 1e9).cast("long"))
    n = F.nullif(F.count("confidence"), F.lit(0))
    mean = F.floor((billionths * 2 + n * 100_000).cast("decimal(38,0)") / (n * 200_000).cast("decimal(20,0)")).cast("double") / 10_000
    return (
        claims.where("ts IS NOT NULL AND fp IS NOT NULL")
        .groupBy("fp", bin_of(F.col("ts"), hours).alias("bin"))
        .agg(F.count("*").alias("posts"), F.countDistinct("author").alias("authors"), mean.alias("avg_confidence"))
    )


def evidence_series(claims: DataFrame, hours: int = 1) -> DataFrame:
    """(fp, bin, evidence_class, posts): the long form of a series' evidence counts."""
    return claims.where("ts IS NOT NULL AND fp IS NOT NULL").groupBy("fp", bin_of(F.col("ts"), hours).alias("bin"), "evidence_class").agg(F.count("*").alias("posts"))


def bursts(series: DataFrame, baseline: int = BASELINE_BINS) -> DataFrame:
    """(fp, bin, posts, authors, n_bins, burst_score, synchrony, author_growth, total_posts) of each fingerprint's last bin.

    The score is the last bin's distance from the mean of up to ``baseline`` bins before it, in their population standard
    deviations (1 where they don't vary). Variance comes from exact whole-number sums. One bin alone has no score.
    """
    order = Window.partitionBy("fp").orderBy("bin")
    before = order.rowsBetween(-baseline, -1)
    whole = Window.partitionBy("fp")
    scored = series.select(
        "fp", "bin", "posts", "authors",
        F.row_number().over(order).alias("i"),
        F.count("*").over(whole).alias("n_bins"),
        F.sum("posts").over(whole).alias("total_posts"),
        F.count("*").over(before).cast("double").alias("n"),
        F.sum("posts").over(before).cast("double").alias("s"),
        F.sum(F.col("posts") * F.col("posts")).over(before).cast("double").alias("ss"),
        F.sum("authors").over(before).cast("double").alias("sa"),
    ).where("i = n_bins AND n_bins >= 2")
    variance = (F.col("n") * F.col("ss") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))
    mean, mean_authors = F.col("s") / F.col("n"), F.col("sa") / F.col("n")
    return scored.select(
        "fp", "bin", "posts", "authors", "n_bins",
        F.round((F.col("posts") - mean) / F.when(variance > 0, F.sqrt(variance)).otherwise(F.lit(1.0)), 3).alias("burst_score"),
        F.round(F.col("authors").cast("double") / F.col("posts"), 3).alias("synchrony"),
        F.round(F.when(mean_authors > 0, (F.col("authors") - mean_authors) / mean_authors).otherwise(F.lit(0.0)), 3).alias("author_growth"),
        "total_posts",
    )


def ranked_bursts(scored: DataFrame, top: int) -> DataFrame:
    """The top bursts with their rank; equal scores go by fingerprint. The limit is the report's."""
    best = scored.orderBy(F.desc("burst_score"), "fp").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("burst_score"), "fp")))


def half_lives(series: DataFrame, min_bins: int = 0) -> DataFrame:
    """(fp, n_bins, peak_posts, half_life_bins): bins from the first peak to the first later bin at half of it or less.

    Null where it never falls so far, or the peak is below 2.
    """
    order, whole = Window.partitionBy("fp").orderBy("bin"), Window.partitionBy("fp")
    indexed = series.select("fp", "posts", F.row_number().over(order).alias("i"), F.max("posts").over(whole).alias("peak"))
    first = Window.partitionBy("fp")
    placed = indexed.withColumn("at", F.min(F.when(F.col("posts") == F.col("peak"), F.col("i"))).over(first))
    fell = F.min(F.when((F.col("i") > F.col("at")) & (F.col("posts") * 2 <= F.col("peak")) & (F.col("peak") >= 2), F.col("i") - F.col("at")))
    return placed.groupBy("fp").agg(F.count("*").alias("n_bins"), F.max("peak").alias("peak_posts"), fell.cast("int").alias("half_life_bins")).where(F.col("n_bins") >= min_bins)


def entropies(counts: DataFrame, key: list[str], n: str = "posts") -> DataFrame:
    """(*key, entropy) in bits, of rows with a count each."""
    total = F.sum(n).cast("double")
    # -sum(p log2 p) = log2(total) - sum(n log2 n) / total: one aggregate, no join with the total
    return counts.groupBy(*key).agg(
        F.round(F.log2(total) - F.sum(F.col(n) * F.log2(F.col(n).cast("double"))) / total, 6).alias("entropy")
    )


def herfindahl(counts: DataFrame, n: str = "posts") -> DataFrame:
    """(herfindahl, total, parts): the sum of squared shares; 0 for an empty table."""
    total = F.coalesce(F.sum(n), F.lit(0)).cast("double")
    return counts.agg(
        F.round(F.coalesce(F.sum(F.col(n).cast("double") * F.col(n)) / F.nullif(total * total, F.lit(0.0)), F.lit(0.0)), 9).alias("herfindahl"),
        total.cast("long").alias("total"), F.count("*").alias("parts"),
    )


def kind_histogram(claims: DataFrame) -> DataFrame:
    """(fp_kind, fps, posts): missing kinds count as unknown."""
    return claims.groupBy(F.coalesce("fp_kind", F.lit("unknown")).alias("fp_kind")).agg(F.countDistinct("fp").alias("fps"), F.count("*").alias("posts"))


def dominant_kinds(claims: DataFrame) -> DataFrame:
    """(fp, fp_kind, posts): each fingerprint's most frequent kind; the greatest name on a tie."""
    n = claims.where("fp IS NOT NULL").groupBy("fp", F.coalesce("fp_kind", F.lit("unknown")).alias("fp_kind")).agg(F.count("*").alias("posts"))
    return n.groupBy("fp").agg(F.max(F.struct("posts", "fp_kind")).alias("m")).select("fp", "m.fp_kind", "m.posts")


def window_totals(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count("*").alias("posts"), F.countDistinct("fp").alias("fps"))


def single_author_heavy(scored: DataFrame, least: int = 10) -> DataFrame:
    """Fingerprints with one author at most in the last bin and ``least`` posts or more in all."""
    return scored.where((F.col("authors") <= 1) & (F.col("total_posts") >= least))


def label_vectors(decisions: DataFrame, hours: int = 1) -> DataFrame:
    """(bin, label, n) of committed decisions."""
    return decisions.where("status = 'committed' AND ts IS NOT NULL").groupBy(bin_of(F.col("ts"), hours).alias("bin"), "label").agg(F.count("*").alias("n"))


def regime_shifts(vectors: DataFrame, baseline: int = REGIME_BINS, threshold: float = 0.3) -> DataFrame:
    """(bin, jsd, shifted): Jensen-Shannon divergence, in bits, of each bin from the pooled bins before it.

    The grid holds bins times labels: both are few (time bins and a fixed set of labels), however many decisions there are.
    The first bin has nothing before it. Fewer than two bins give nothing.
    """
    bins = vectors.select("bin").distinct().withColumn("i", F.row_number().over(Window.orderBy("bin")))
    grid = bins.crossJoin(vectors.select("label").distinct()).join(vectors, ["bin", "label"], "left").na.fill(0, ["n"])
    past = Window.partitionBy("label").orderBy("i").rowsBetween(-baseline, -1)
    both = grid.withColumn("base", F.coalesce(F.sum("n").over(past), F.lit(0)))
    whole = Window.partitionBy("bin")
    p = F.col("n") / F.sum("n").over(whole).cast("double")
    q = F.col("base") / F.nullif(F.sum("base").over(whole), F.lit(0)).cast("double")
    m = (F.col("p") + F.col("q")) / 2

    def part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(F.lit(0.0))

    return (
        both.withColumn("p", p).withColumn("q", q).where("q IS NOT NULL")
        .groupBy("bin")
        .agg(F.round(F.sum(part("p") + part("q")) / 2, 4).alias("jsd"))
        .withColumn("shifted", F.col("jsd") >= threshold)
    )


def author_ratios(series: DataFrame, top: int = 20) -> DataFrame:
    """(fp, posts, author_bins, ratio) of the fingerprints with most posts: authors counted anew in each bin."""
    return (
        series.groupBy("fp").agg(F.sum("posts").alias("posts"), F.sum("authors").alias("author_bins"))
        .orderBy(F.desc("posts"), "fp").limit(top)
        .withColumn("ratio", F.round(F.col("author_bins").cast("double") / F.col("posts"), 6))
    )


def hourly_rollup(claims: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """(fingerprint, hour_epoch, event_count, unique_authors) of the whole hours touched since as_of - hours."""
    start = F.date_trunc("hour", F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours)))
    recent = claims.where((F.col("ts") >= start) & (F.col("ts") < F.lit(as_of).cast("timestamp")))
    return recent.groupBy(F.col("fp").alias("fingerprint"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("hour_epoch")).agg(
        F.count("*").alias("event_count"), F.countDistinct("author").alias("unique_authors")
    )


def uri_map(claims: DataFrame) -> DataFrame:
    """(post_uri, fp, ts, seq): the latest claim of each post by its place in the log."""
    return claims.where("post_uri IS NOT NULL").groupBy("post_uri").agg(F.max(F.struct("seq", "fp", "ts")).alias("m")).select("post_uri", "m.fp", "m.ts", "m.seq")


def bounds(mapped: DataFrame) -> DataFrame:
    """(fp, first_seen_epoch, last_seen_epoch, total_claims) over the deduplicated map."""
    return mapped.groupBy("fp").agg(F.unix_seconds(F.min("ts")).alias("first_seen_epoch"), F.unix_seconds(F.max("ts")).alias("last_seen_epoch"), F.count("*").alias("total_claims"))
