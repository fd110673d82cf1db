"""Drift between statements of one author: thread pairs, as-of joins and the five rules.

Posts are (uri, author, root, ts, text, n_links, n_embeds, n_facets, evidence_hash, fp). Rules give (subject_uri, label,
score, prior_uri, date_mentioned, rule_id); ties of equal times go by uri.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.functions import claim_text as ct
from claimscope.operators import ordered
from claimscope.runtime import stored

# Rule, label and score, in the order of the rules.
RULES = {
    "provenance_laundering": ("provenance_laundering_possible", 0.9),
    "repeat_claim_no_new_evidence": ("repeat_claim_no_new_evidence", 0.6),
    "assertiveness_increase": ("assertiveness_increase_possible", 0.7),
    "quote_mismatch": ("quote_mismatch", 0.55),
    "time_inconsistency": ("time_inconsistency", 0.4),
}
# What a label says about its rule.
REASONS = {
    "provenance_laundering": "attribution removed compared to prior post",
    "repeat_claim_no_new_evidence": "claim repeated without new evidence",
    "assertiveness_increase": "assertiveness/confidence increased without new evidence",
    "quote_mismatch": "quote or attribution present but no link/facet found",
    "time_inconsistency": "mentioned date appears in future compared to createdAt",
}
#: Needles are met by so many of their first characters.
GRAM = 5


def _label(rows: DataFrame, rule: str, prior: Column | None = None, date: Column | None = None) -> DataFrame:
    label, score = RULES[rule]
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("uri").alias("subject_uri"), F.lit(label).alias("label"), F.lit(score).alias("score"),
        (prior if prior is not None else none).alias("prior_uri"), (date if date is not None else none).alias("date_mentioned"), F.lit(rule).alias("rule_id"),
    )


def _normal(text: Column) -> Column:
    return F.btrim(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")))


def holding(haystacks: DataFrame, needles: DataFrame, group: list[str]) -> DataFrame:
    """(uri, ts, *group, key): each haystack (uri, ts, *group, text) with the needles (*group, key) of its group that its text holds; stored.

    A needle is met by its first GRAM characters, looked up among those of the haystacks, so only texts that have these in common
    are compared. Shorter needles, distinct strings of a few characters, are compared with the texts of their group. Haystacks of
    groups without a needle should be left out before. The two ways are stored one after the other, as each plan holds the driver's memory.
    Grams are merged: Spark takes exploded rows to be as few as before, and would broadcast any number of them through the driver.
    """
    columns = ["uri", "ts", *group, "key"]
    needles = needles.select(*group, "key").distinct().withColumn("g", F.xxhash64(*group))
    long = needles.where(F.length("key") >= GRAM).withColumn("gram", F.xxhash64(F.substring("key", 1, GRAM)))
    hay = haystacks.select("uri", "ts", *group, "text").withColumn("g", F.xxhash64(*group))
    places = F.when(F.length("text") >= GRAM, F.sequence(F.lit(1), F.length("text") - (GRAM - 1)))
    grams = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substring("text", i, F.lit(GRAM)))))
    met = hay.select("uri", "g", F.explode(grams).alias("gram")).join(long.hint("merge"), ["g", "gram"]).select("uri", *group, "key")
    found = stored(met.join(hay.drop("g"), ["uri", *group]).where(F.contains("text", "key")).select(*columns))
    short = stored(hay.join(needles.where(F.length("key") < GRAM), ["g", *group]).where(F.contains("text", "key")).select(*columns))
    return found.unionByName(short)


def latest_match(posts: DataFrame, priors: DataFrame, group: list[str], before: bool = False) -> DataFrame:
    """(uri, prior): of each post the latest other prior of its group with which it has a key in common; with ``before``, an earlier one.

    Both are (uri, ts, *group, key). Of a key only its two latest priors matter, or with ``before`` the last before each post, so
    the pairs of a group are never made. Ties of time go by uri. Keys are exploded rows, so they are merged as in holding.
    """
    keys = [*group, "key"]
    if before:
        met = asof_prior(posts, priors, keys).where("prior IS NOT NULL")
        return met.groupBy("uri").agg(F.max("prior").alias("p")).select("uri", F.col("p.uri").alias("prior"))
    order = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("uri"))
    two = priors.select(*keys, "ts", "uri").distinct().withColumn("r", F.row_number().over(order)).where("r <= 2")
    met = posts.select(*keys, "uri").join(two.select(*keys, F.struct("ts", F.col("uri").alias("prior")).alias("p")).hint("merge"), keys).where("p.prior <> uri")
    return met.groupBy("uri").agg(F.max("p").alias("p")).select("uri", "p.prior")


def comparable_keys(posts: DataFrame, priors: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keys for latest_match of posts and priors (uri, ts, *group, text) whose texts are comparable, as claim_text.comparable says.

    A key is a long word or the whole text of a prior that stands in a post's text; or a post's whole text that stands in a prior's. The
    latter is only looked for where no long word of the post, between two others, would lead to the same priors.
    """
    p, q = (x.select("uri", "ts", *group, _normal(F.col("text")).alias("text")) for x in (posts, priors))
    kept = lambda way: F.concat(F.lit(way), F.col("key")).alias("key")
    words = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 4)
    needles = q.select("uri", "ts", *group, F.explode(F.array_union(words, F.array("text"))).alias("key"))
    forth = holding(p, needles, group)
    inner = F.split("text", r"\s+")
    covered = F.exists(F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))), lambda w: F.length(w) > 4)
    bare = p.where(~covered).withColumnRenamed("text", "key")
    back = holding(stored(q.join(bare.select(*group).distinct(), group, "left_semi")), bare, group)
    columns = ["uri", "ts", *group]
    return (
        forth.select(*columns, kept("<")).unionByName(bare.select(*columns, kept(">"))),
        needles.select(*columns, kept("<")).unionByName(back.select(*columns, kept(">"))),
    )


def _prepared(posts: DataFrame) -> DataFrame:
    """The posts with whether they attribute their claim, and their dates, numbers and names as tokens; stored, as all is read again."""
    sig = posts.withColumn("sig", ct.signals(F.col("text"))).withColumn("attributed", ct.attributed(F.col("text")))
    named = lambda kind: F.transform(F.col(f"sig.{kind}"), lambda t: F.concat(F.lit(f"{kind}:"), t))
    return stored(sig.withColumn("tokens", F.array_distinct(F.concat(*map(named, ("dates", "quantities", "entities"))))).drop("sig"))


def provenance_laundering(posts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """A post without attribution, like another of its author in the thread that has one; else, like an earlier claim of the fingerprint."""

    def matched(p: DataFrame, q: DataFrame, group: list[str], before: bool) -> DataFrame:
        both = comparable_keys(p, q, group)
        keys = (k.unionByName(x.select("uri", "ts", *group, F.explode("tokens").alias("key"))) for k, x in zip(both, (p, q)))
        return stored(latest_match(*keys, group, before))

    rows = _prepared(posts.select("uri", "author", "root", "ts", "text", "fp"))
    without, with_ = rows.where("NOT attributed"), rows.where("attributed")
    # only where an author has both in a thread is there anything to compare
    group = ["root", "author"]
    both = stored(without.join(with_.select(*group).distinct(), group, "left_semi")), stored(with_.join(without.select(*group).distinct(), group, "left_semi"))
    found = matched(*both, group, False)
    out = _label(found, "provenance_laundering", F.col("prior"))
    if history is not None:
        rest = without.join(found.select("uri"), "uri", "left_anti")
        past, group = _prepared(history.select("uri", "author", "fp", "ts", "text")).where("attributed"), ["author", "fp"]
        rest, past = stored(rest.join(past.select(*group).distinct(), group, "left_semi")), stored(past.join(rest.select(*group).distinct(), group, "left_semi"))
        out = out.unionByName(_label(matched(rest, past, group, True), "provenance_laundering", F.col("prior")))
    return out


def repeated_claims(posts: DataFrame) -> DataFrame:
    """A post comparable with another of its author in the thread, both with links or embeds or both without."""
    rows = posts.select("uri", "author", "root", "ts", "text", ((F.col("n_links") > 0) | (F.col("n_embeds") > 0)).alias("evidence"))
    group = ["root", "author", "evidence"]
    several = rows.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1").select(*group)
    rows = stored(rows.join(several, group, "left_semi"))
    found = stored(latest_match(*comparable_keys(rows, rows, group), group))
    return _label(found, "repeat_claim_no_new_evidence", F.col("prior"))


def asof_prior(posts: DataFrame, history: DataFrame, keys: list[str], hot: int = ordered.HOT) -> DataFrame:
    """Each post with the last history row of its keys strictly before it: (..., prior: struct or null).

    One order over the union instead of a range join; rows of one time are decided together, so none precedes another.
    """
    held = [c for c in history.columns if c not in keys and c != "ts"]
    left = posts.withColumn("_h", F.lit(None).cast(history.select(F.struct("ts", *held).alias("h")).schema["h"].dataType))
    right = history.select(*keys, "ts", F.struct("ts", *held).alias("_h"))
    for c in posts.columns:
        if c not in right.columns:
            right = right.withColumn(c, F.lit(None).cast(posts.schema[c].dataType))
    both = left.withColumn("_post", F.lit(True)).unionByName(right.withColumn("_post", F.lit(False)))
    return ordered.latest(both, keys, F.unix_micros("ts"), F.col("_h"), "prior", True, hot).where("_post").drop("_h", "_post")


def assertiveness_increase(posts: DataFrame, history: DataFrame, delta: float = 0.2) -> DataFrame:
    """A post surer by ``delta`` or more than its author's last claim of the same fingerprint, on the same evidence."""
    rows = posts.select("uri", "author", "fp", "ts", "evidence_hash", ct.assertiveness(F.col("text")).alias("confidence"))
    past = history.select("author", "fp", "ts", "uri", "evidence_hash", ct.assertiveness(F.col("text")).alias("confidence"))
    met = asof_prior(rows, past, ["author", "fp"])
    surer = met.where((F.col("confidence") - F.col("prior.confidence") >= delta) & F.col("evidence_hash").eqNullSafe(F.col("prior.evidence_hash")))
    return _label(surer, "assertiveness_increase", F.col("prior.uri"))


def quote_mismatch(posts: DataFrame) -> DataFrame:
    quoted = F.contains(F.col("text"), F.lit('"')) | F.contains(F.lower("text"), F.lit("according to"))
    return _label(posts.where(quoted & (F.col("n_links") == 0) & (F.col("n_facets") == 0)), "quote_mismatch")


def time_inconsistency(posts: DataFrame) -> DataFrame:
    """The first date in the text lies after the post."""
    first = F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2})", 1)
    return _label(posts.where(F.try_to_timestamp(first) > F.col("ts")), "time_inconsistency", date=first)


def all_rules(posts: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Labels of all rules; the history feeds the fallback and the as-of join."""
    parts = [provenance_laundering(posts, history), repeated_claims(posts), quote_mismatch(posts), time_inconsistency(posts)]
    if history is not None:
        parts.append(assertiveness_increase(posts, history))
    return reduce(DataFrame.unionByName, parts).where("score >= 0.4")


def label_lines(labels: DataFrame) -> DataFrame:
    """(value): one JSON text a label, keys in order, sorted by subject, label and falling score."""
    rule = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    evidence = F.to_json(F.array(F.struct("date_mentioned", F.col("subject_uri").alias("post"), F.col("prior_uri").alias("prior"))))
    line = F.concat(
        F.lit('{"evidence":'), evidence, F.lit(',"label":'), F.to_json(F.struct("label")).substr(F.lit(10), F.length(F.to_json(F.struct("label"))) - 10),
        F.lit(',"reasons":["'), rule[F.col("rule_id")], F.lit('"],"score":'), F.round("score", 3).cast("string"), F.lit(',"subject_uri":"'), F.col("subject_uri"), F.lit('"}'),
    )
    return labels.orderBy("subject_uri", "label", F.desc("score")).select(line.alias("value"))


def reconcile(desired: DataFrame, active: DataFrame) -> DataFrame:
    """(subject, label, action): keep, insert or expire, from what should hold and what does. Repeats count once."""
    d = desired.select("subject", "label").distinct().withColumn("want", F.lit(True))
    a = active.select("subject", "label").distinct().withColumn("have", F.lit(True))
    both = d.join(a, ["subject", "label"], "full")
    return both.select("subject", "label", F.when(F.col("have").isNull(), "insert").when(F.col("want").isNull(), "expire").otherwise("keep").alias("action"))


def unlabeled(subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """Subjects without a label; a null label subject hides nothing."""
    return subjects.join(labels.select(F.col("subject_uri").alias("uri")).where("uri IS NOT NULL"), "uri", "left_anti")
