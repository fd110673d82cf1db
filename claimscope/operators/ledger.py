"""Labels and their ledger: what should hold is compared with what does, and every change is written down.

The ledger is append-only: (decision_id, subject, label, rule_id, status, at). A decision is named by its content, so writing it twice
changes nothing; the status of a subject's label is that of its latest entry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.operators import drift

INSERTED, EXPIRED, HELD = "committed", "expired", "suppressed"


def decision_id(*fields: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)), 256)


def entries(labels: DataFrame, status: Column, as_of: str) -> DataFrame:
    """Ledger entries of labels (subject, label, rule_id)."""
    rows = labels.select("subject", "label", "rule_id", status.alias("status"), F.lit(as_of).cast("timestamp").alias("at")).distinct()
    return rows.select(decision_id("subject", "label", "rule_id", "status", "at").alias("decision_id"), *rows.columns)


def appended(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """The ledger with the entries that it doesn't hold yet."""
    return new if ledger is None else ledger.unionByName(new.join(ledger.select("decision_id"), "decision_id", "left_anti"))


def standing(ledger: DataFrame) -> DataFrame:
    """(subject, label, status, at) as the latest entry of each says; of entries of one time, an expiry counts last."""
    last = F.max(F.struct("at", (F.col("status") == EXPIRED).alias("gone"), "status")).alias("x")
    return ledger.groupBy("subject", "label").agg(last).select("subject", "label", "x.status", "x.at")


def unlabeled_inserts(labels: DataFrame, active: DataFrame) -> DataFrame:
    """Labels (subject, labeler, json) that aren't active in exactly that form; repeats once."""
    return labels.distinct().join(active.select("subject", "labeler", "json"), ["subject", "labeler", "json"], "left_anti")


def capped(inserts: DataFrame, caps: dict[str, int], default: int = 0) -> DataFrame:
    """The inserts with ``within``: whether a rule's cap for one run still covers them, surest first; a cap of 0 is none."""
    from pyspark.sql import Window

    cap = F.coalesce(F.create_map(*(F.lit(x) for kv in (caps or {"": 0}).items() for x in kv))[F.col("rule_id")], F.lit(default))
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("score"), "subject", "label"))
    return inserts.withColumn("within", (cap == 0) | (rank <= cap))


def emit_mode(asked: str, confirmed: bool) -> str:
    """detect-only unless asked for more; emit needs to be confirmed, else labels are held back."""
    return asked if asked in ("detect-only", "suppress") or (asked == "emit" and confirmed) else "suppress" if asked == "emit" else "detect-only"


@dataclass(frozen=True)
class Recheck:
    """actions: (subject, label, rule_id, score, action); entries: what the ledger gains; active: (subject, label, rule_id) afterwards."""

    actions: DataFrame
    entries: DataFrame
    active: DataFrame


def recheck(fps: DataFrame, posts: DataFrame, history: DataFrame, active: DataFrame, as_of: str, caps: dict[str, int] | None = None) -> Recheck:
    """One batch: the rules run over the posts of the dequeued fingerprints; their labels are inserted, kept or expired.

    fps: (fp). active: (subject, label, rule_id). Labels of other posts stay as they are. What a rule's cap leaves out is
    written down as held back and isn't active.
    """
    mine = posts.join(fps.select("fp").distinct(), "fp", "left_semi")
    known = active.join(mine.select(F.col("uri").alias("subject")), "subject", "left_semi")
    want = drift.all_rules(mine, history).select(F.col("subject_uri").alias("subject"), "label", "rule_id", "score")
    want = want.groupBy("subject", "label", "rule_id").agg(F.max("score").alias("score"))
    both = drift.reconcile(want, known)
    ruled = want.unionByName(known.withColumn("score", F.lit(None).cast("double"))).groupBy("subject", "label").agg(F.max("rule_id").alias("rule_id"), F.max("score").alias("score"))
    rows = capped(both.where("action = 'insert'").join(ruled, ["subject", "label"]), caps or {})
    actions = rows.select("subject", "label", "rule_id", "score", F.when(F.col("within"), "insert").otherwise("hold").alias("action")).unionByName(
        both.where("action <> 'insert'").join(ruled, ["subject", "label"]).select("subject", "label", "rule_id", "score", "action")
    )
    status = F.when(F.col("action") == "insert", INSERTED).when(F.col("action") == "expire", EXPIRED).otherwise(HELD)
    gone = actions.where("action = 'expire'").select("subject", "label")
    after = active.join(gone, ["subject", "label"], "left_anti").unionByName(actions.where("action = 'insert'").select("subject", "label", "rule_id"))
    return Recheck(actions, entries(actions.where("action <> 'keep'"), status, as_of), after)


def ingested(subjects: DataFrame, labels: DataFrame, offered: DataFrame) -> DataFrame:
    """Labels (subject_uri, label, ...) that an outside labeler offers for subjects (uri) without any."""
    open_ = drift.unlabeled(subjects, labels).select(F.col("uri").alias("subject_uri")).distinct()
    return offered.join(open_, "subject_uri", "left_semi")


def explained(labels: DataFrame, uri: str) -> DataFrame:
    """The labels of one subject with their reasons and evidence."""
    reasons = F.create_map(*(F.lit(x) for kv in drift.REASONS.items() for x in kv))
    return labels.where(F.col("subject_uri") == uri).select("label", "score", reasons[F.col("rule_id")].alias("reason"), "prior_uri", "date_mentioned").orderBy("label", F.desc("score"))
