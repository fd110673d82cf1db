"""Running values in the order of time within a key, of which one may hold any part of the rows.

A plain window sorts all rows of a key in one task. Here keys with more than ``hot`` rows are cut into slices at quantiles of time;
a window runs within each slice, and what a slice needs of those before it is carried over from summaries, one row a slice.
Where no key is hot, and that is counted first, it is the plain window and nothing is shuffled twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimscope.runtime import cut

HOT, SLICES = 200_000, 256
#: So many hot keys at most have their cuts broadcast, of 2 kB each.
BROADCAST_KEYS = 1000


def sliced(rows: DataFrame, keys: list[str], at: Column, hot: int = HOT) -> tuple[DataFrame, bool]:
    """(rows with ``slice``, whether any key is hot). Rows of equal ``at`` are in one slice; slices follow each other in time."""
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*keys))
    n = large.count()
    if not n:
        return rows.withColumn("slice", F.lit(0)), False
    cuts = rows.join(F.broadcast(large) if n <= BROADCAST_KEYS else large, keys, "left_semi").groupBy(*keys)
    cuts = cut(cuts.agg(F.percentile_approx(at, [i / SLICES for i in range(1, SLICES)], 10_000).alias("_cuts")))
    found = rows.join(F.broadcast(cuts) if n <= BROADCAST_KEYS else cuts, keys, "left")
    place = F.coalesce(F.size(F.filter("_cuts", lambda c: c < at)), F.lit(0))
    return found.withColumn("slice", place).drop("_cuts").repartition(*keys, "slice"), True


def previous(rows: DataFrame, keys: list[str], at: Column, order: list[Column | str], value: Column, to: str, hot: int = HOT) -> DataFrame:
    """The rows with a struct ``to`` of the ``value`` of the row before (null of the first). ``order`` begins with ``at``."""
    held, any_hot = sliced(rows.withColumn("_v", F.struct(value.alias("value"))), keys, at, hot)
    before = F.lag("_v").over(Window.partitionBy(*keys, "slice").orderBy(*order))
    if any_hot:
        rank = F.struct(*(F.col(c).alias(f"o{i}") if isinstance(c, str) else c.alias(f"o{i}") for i, c in enumerate(order)))
        ends = held.groupBy(*keys, "slice").agg(F.max_by("_v", rank).alias("_v"))
        ends = ends.select(*keys, "slice", F.lag("_v").over(Window.partitionBy(*keys).orderBy("slice")).alias("_carried"))
        held = held.join(ends, [*keys, "slice"], "left")  # keys that may be null aren't hot
        before = F.coalesce(before, F.col("_carried"))
    return held.withColumn(to, before).drop("_v", "_carried", "slice")


def latest(rows: DataFrame, keys: list[str], at: Column, value: Column, to: str, strictly: bool, hot: int = HOT) -> DataFrame:
    """The rows with ``to``: the greatest value among rows of the key that are not later, or with ``strictly`` earlier; nulls don't count.

    Nulls sort first, so of structs the one with the latest beginning is the greatest.
    """
    held, any_hot = sliced(rows.withColumn("_v", value), keys, at, hot)
    frame = Window.partitionBy(*keys, "slice").orderBy(at).rangeBetween(Window.unboundedPreceding, -1 if strictly else 0)
    found = F.max("_v").over(frame)
    if any_hot:
        ends = held.groupBy(*keys, "slice").agg(F.max("_v").alias("_v"))
        earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "slice", F.max("_v").over(earlier).alias("_carried"))
        held = held.join(ends, [*keys, "slice"], "left")
        found = F.greatest(found, F.col("_carried"))
    return held.withColumn(to, found).drop("_v", "_carried", "slice")


def previous_turn(rows: DataFrame, keys: list[str], at: Column, order: list[str], turn: str, to: str, hot: int = HOT) -> DataFrame:
    """The rows with ``to``: the last non-null ``turn`` in order, the row's own included. A turn begins with the order's values."""
    held, any_hot = sliced(rows, keys, at, hot)
    frame = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(turn, ignorenulls=True).over(frame)
    if any_hot:
        ends = held.groupBy(*keys, "slice").agg(F.max(turn).alias("_turn"))
        earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, "slice", F.max("_turn").over(earlier).alias("_carried"))
        held = held.join(ends, [*keys, "slice"], "left")
        found = F.coalesce(found, F.col("_carried"))
    return held.withColumn(to, found).drop("_carried", "slice")
