"""Applying a stream of inserts, updates and deletes (problem 3): a signed multiset of row images.

Each deduplicated change contributes its before-image with -1 and its after-image with +1. Multiplicities are summed
together with the base table's rows (+1 each), and rows with a positive sum are the present state.

Images need the state before and after each change: the last value set for each field since the last removal. That is
a running window over a key's changes. A key with more than ``hot`` changes is cut into slices at quantiles of
its times; slices are summarised, a window over the few summaries carries the state from slice to slice.

A change without key or time is not applied. A repeat has the same key, time and number and counts once (the one with
the smallest row number, nulls last, should its contents differ). A missing number comes before all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256
_FIRST = -(2**63)


def deduplicated(changes: DataFrame) -> DataFrame:
    """One row of each (did, time_us, seq)."""
    rest = ["row_no", "event_kind", "has_handle", "handle", "has_active", "active"]
    kept = changes.where("did IS NOT NULL AND time_us IS NOT NULL").select(
        "did", "time_us", F.coalesce(F.col("seq").cast("long"), F.lit(_FIRST)).alias("seq"),
        F.struct(F.coalesce(F.col("row_no").cast("long"), F.lit(2**63 - 1)).alias("row_no"), *rest[1:]).alias("change"),
    )
    return kept.groupBy("did", "time_us", "seq").agg(F.min("change").alias("change")).select("did", "time_us", "seq", *(f"change.{c}" for c in rest))


def _sliced(changes: DataFrame, hot: int) -> DataFrame:
    """Adds ``slice``: 0, but for keys with more than hot changes, which are cut by time."""
    sizes = changes.groupBy("did").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("did")
    cuts = (
        changes.join(sizes, "did", "left_semi")
        .groupBy("did")
        .agg(F.percentile_approx("time_us", [i / SLICES for i in range(1, SLICES)], 10_000).alias("cuts"))
    )
    return changes.join(cuts, "did", "left").withColumn(
        "slice", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("time_us"))), F.lit(0))
    ).drop("cuts")


def images(changes: DataFrame, base: DataFrame | None = None, hot: int = 200_000) -> DataFrame:
    """(did, handle, active, weight): before-images with -1 and after-images with +1 of all changes, and the base with +1."""
    rows = deduplicated(changes)
    if base is not None:
        rows = rows.unionByName(
            base.select(
                "did", F.lit(_FIRST).alias("time_us"), F.lit(_FIRST).alias("seq"), F.lit(_FIRST).alias("row_no"), F.lit("base").alias("event_kind"),
                F.lit(True).alias("has_handle"), "handle", F.lit(True).alias("has_active"), "active",
            )
        )
    at = F.struct("time_us", "seq")
    removal = F.col("event_kind").eqNullSafe("tombstone")
    rows = _sliced(rows, hot).select(
        "did", "slice", "time_us", "seq",
        F.struct(removal.alias("gone")).alias("any"),
        F.when(removal, at).alias("removed"),
        F.when(~removal & F.col("has_handle"), F.struct(at.alias("at"), F.col("handle").alias("value"))).alias("handle"),
        F.when(~removal & F.col("has_active"), F.struct(at.alias("at"), F.coalesce("active", F.lit(False)).alias("value"))).alias("active"),
    )
    tracked = ["any", "removed", "handle", "active"]
    slice_end = rows.groupBy("did", "slice").agg(
        F.max_by("any", at).alias("any"), F.max("removed").alias("removed"), F.max("handle").alias("handle"), F.max_by("active", F.when(F.col("active").isNotNull(), at)).alias("active")
    )
    earlier = Window.partitionBy("did").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slice_end.select("did", "slice", *(F.last(c, ignorenulls=True).over(earlier).alias(f"carried_{c}") for c in tracked)).where("slice > 0")
    rows = rows.join(carried, ["did", "slice"], "left")
    order = Window.partitionBy("did", "slice").orderBy("time_us", "seq")

    def image(frame) -> F.Column:
        seen = {c: F.coalesce(F.last(c, ignorenulls=True).over(frame), F.col(f"carried_{c}")) for c in tracked}
        newer = {c: seen["removed"].isNull() | (seen[c]["at"] > seen["removed"]) for c in ("handle", "active")}
        return F.when(
            ~seen["any"]["gone"],
            F.struct(
                F.when(newer["handle"], seen["handle"]["value"]).alias("handle"),
                F.coalesce(F.when(newer["active"], seen["active"]["value"]), F.lit(True)).alias("active"),
            ),
        )

    both = rows.select(
        "did",
        image(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        image(order.rowsBetween(Window.unboundedPreceding, 0)).alias("after"),
    )
    signed = both.select("did", F.explode(F.array(F.struct(F.col("before").alias("row"), F.lit(-1).alias("weight")), F.struct(F.col("after").alias("row"), F.lit(1).alias("weight")))).alias("x"))
    return signed.where("x.row IS NOT NULL").select("did", "x.row.handle", "x.row.active", "x.weight")


def current_state(changes: DataFrame, base: DataFrame | None = None, hot: int = 200_000) -> DataFrame:
    """(did, handle, is_active) of every account that exists after all changes; no handle is '', is_active 1 or 0."""
    total = images(changes, base, hot).groupBy("did", "handle", "active").agg(F.sum("weight").alias("copies"))
    return total.where("copies > 0").select("did", F.coalesce("handle", F.lit("")).alias("handle"), F.col("active").cast("int").alias("is_active"))
