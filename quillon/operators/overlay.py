"""A base catalogue, what left it and what came: base minus removed, plus delta."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators.search import matching, order, parse_sort
from quillon.sources.catalog import COLUMNS, normalise

CAP = 200_000


@dataclass
class Overlay:
    """A batch replaces the one before whole. ``removed`` (path) hides rows of the base only, so a
    path in both sets shows its new row. More than CAP rows on a side: saturated, rebuild."""

    removed: DataFrame
    delta: DataFrame

    def saturated(self) -> bool:
        return any(x.limit(CAP + 1).count() > CAP for x in (self.removed, self.delta))


def merged(parts: list[Overlay]) -> Overlay:
    """The overlay of several volumes, whose paths have nothing in common."""
    return Overlay(reduce(DataFrame.unionByName, [p.removed for p in parts]), reduce(DataFrame.unionByName, [p.delta for p in parts]))


def then(before: Overlay | None, removed: DataFrame, delta: DataFrame) -> Overlay:
    """``before`` with a later batch: rows that it took away are no longer new, rows it brought are."""
    if before is None:
        return Overlay(removed, delta)
    return Overlay(before.removed.union(removed).distinct(), base_left(before.delta, removed).unionByName(delta))


def base_left(base: DataFrame, removed: DataFrame) -> DataFrame:
    gone = removed.select(paths.fold_path("path").alias("_gone")).distinct()
    return base.join(gone, paths.fold_path(base["path"]) == gone["_gone"], "left_anti")


def live(base: DataFrame, overlay: Overlay) -> DataFrame:
    """All entries now; ``side`` is 0 for the delta, 1 for the base."""
    new = normalise(overlay.delta).withColumn("side", F.lit(0))
    old = base_left(base, overlay.removed).select(*COLUMNS).withColumn("side", F.lit(1))
    return new.unionByName(old)


def page(base: DataFrame, overlay: Overlay, query: str, limit: int, sort: str | None = None, desc: bool = False, clock=None) -> tuple[DataFrame, DataFrame]:
    """(all that match, the page): without a sort key the delta comes first, each side by id."""
    found = matching(live(base, overlay), query, clock)
    key = parse_sort(sort)
    first = [F.col("side").asc()] if key is None else []
    return found, found.orderBy(*first, *order(key, desc)).limit(max(0, limit))
