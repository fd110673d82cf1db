"""Distinct counts over huge identifier sets (problem 4): membership patterns.

Each identifier is reduced to the set of cells (day, group, ...) that hold it, and identifiers with the same set
are counted together. Any combination of groups is then answered from the pattern totals, exactly: the error bound is 0.

Parts can be joined: the (identifier, cell) rows of two parts, united and made distinct, are those of the whole, so
``memberships`` of new data need only be merged with those kept.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memberships(rows: DataFrame, identifier: Column, cell: dict[str, Column], within: dict[str, Column] | None = None) -> DataFrame:
    """(*within, id1, id2, cell): each identifier's cells, once each. Null identifiers are counted nowhere; null groups are a group.

    ``within`` names groups that no combination crosses: patterns are then of one such group, and no longer than it has cells.
    """
    ids = [F.xxhash64(identifier), F.xxhash64(F.lit(1), identifier)]
    return (
        rows.where(identifier.isNotNull())
        .select(*(c.alias(n) for n, c in (within or {}).items()), ids[0].alias("id1"), ids[1].alias("id2"), F.struct(*(c.alias(n) for n, c in cell.items())).alias("cell"))
        .distinct()
    )


def merge(*parts: DataFrame) -> DataFrame:
    """The memberships of several parts as those of the whole."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.distinct()


def patterns(members: DataFrame) -> DataFrame:
    """(*within, pattern, identifiers): how many identifiers lie in exactly these cells.

    A pattern is at most as long as there are cells, whatever the number of rows an identifier has.
    """
    within = [c for c in members.columns if c not in ("id1", "id2", "cell")]
    return (
        members.groupBy(*within, "id1", "id2")
        .agg(F.sort_array(F.collect_list("cell")).alias("pattern"))
        .groupBy(*within, "pattern")
        .agg(F.count("*").alias("identifiers"))
    )


def combination_counts(totals: DataFrame, groups: list[str]) -> DataFrame:
    """(*within, grouping, *groups, n): distinct identifiers for every combination of the groups, from pattern totals.

    grouping names the columns that are held fixed ('' for all rows together); the others are null in that row.
    """
    cell = totals.schema["pattern"].dataType.elementType
    kinds = {f.name: f.dataType for f in cell.fields}

    def view(kept: tuple[str, ...]) -> Column:
        return F.array_distinct(
            F.transform(
                "pattern",
                lambda c: F.struct(
                    F.lit("+".join(kept)).alias("grouping"), *((c[g] if g in kept else F.lit(None).cast(kinds[g])).alias(g) for g in groups)
                ),
            )
        )

    within = [c for c in totals.columns if c not in ("pattern", "identifiers")]
    views = [view(kept) for n in range(len(groups) + 1) for kept in combinations(groups, n)]
    return (
        totals.select(*within, F.explode(F.flatten(F.array(*views))).alias("v"), "identifiers")
        .groupBy(*within, "v")
        .agg(F.sum("identifiers").alias("n"))
        .select(*within, "v.grouping", *(F.col(f"v.{g}") for g in groups), "n")
    )


def union_count(totals: DataFrame, predicate) -> DataFrame:
    """(n): identifiers in any cell that the predicate (of a cell column) selects, counted once."""
    return totals.where(F.exists("pattern", predicate)).agg(F.coalesce(F.sum("identifiers"), F.lit(0)).alias("n"))


def overlap_count(totals: DataFrame, *predicates) -> DataFrame:
    """(n): identifiers that have, for each predicate, some cell that it selects."""
    for p in predicates:
        totals = totals.where(F.exists("pattern", p))
    return totals.agg(F.coalesce(F.sum("identifiers"), F.lit(0)).alias("n"))
