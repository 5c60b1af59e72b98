"""Filter, order and page a catalogue; exact totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators.predicates import predicate
from quillon.operators.query import Clock, Query, QueryError, parse
from quillon.sources.catalog import HIT, with_derived

SORT_KEYS = ["name", "path", "size", "allocated", "mtime", "ctime"]
DEFAULT_LIMIT, MAX_LIMIT = 100, 10_000


def parse_sort(text: str | None) -> str | None:
    """A sort key in any case; blank: the order of ids."""
    key = (text or "").strip().lower()
    if key and key not in SORT_KEYS:
        raise QueryError(f"unknown sort key {text!r}")
    return key or None


def parse_flag(text: str | None) -> bool:
    word = (text or "").strip()
    if word in ("1", "true", "yes", "on"):
        return True
    if word in ("", "0", "false", "no", "off"):
        return False
    raise QueryError(f"true or false, not {text!r}")


def matching(catalog: DataFrame, query: str | Query, clock: Clock | None = None) -> DataFrame:
    """The entries a query finds, with name_l and path_ci."""
    q = query if isinstance(query, Query) else parse(query, clock)
    return with_derived(catalog).where(predicate(q))


def order(sort: str | None, desc: bool = False) -> list[Column]:
    """``desc`` turns the key only: ties are in ascending order of the path either way."""
    if sort is None:
        return [F.col("id").asc()]
    key = paths.fold_path(paths.basename("path")) if sort == "name" else paths.fold_path("path") if sort == "path" else F.col(sort)
    return [key.desc() if desc else key.asc(), F.col("path").asc()]


def page(found: DataFrame, limit: int = DEFAULT_LIMIT, sort: str | None = None, desc: bool = False) -> DataFrame:
    """The first ``limit`` entries of the whole order (a top-N, not a sort of N)."""
    return found.orderBy(*order(parse_sort(sort), desc)).limit(max(0, limit))


def search(catalog: DataFrame, query: str, limit: int = DEFAULT_LIMIT, sort: str | None = None, desc: bool = False, clock: Clock | None = None) -> tuple[int, DataFrame]:
    """(total without the limit, hits)."""
    found = matching(catalog, query, clock)
    return found.count(), page(found, limit, sort, desc).select("id", *HIT)


def find_path(catalog: DataFrame, path: str) -> DataFrame:
    """The first entry of this path, ASCII case aside."""
    return with_derived(catalog).where(F.col("path_ci") == paths.fold_path_text(path)).orderBy("id").limit(1)


def find_frn(catalog: DataFrame, frn: int, drive: str | None = None) -> DataFrame:
    """All names of a record, of one drive if given; record 0 is none."""
    hit = F.lit(False) if frn == 0 else F.col("frn") == frn
    return catalog.where(hit & paths.on_drive(F.col("path"), drive) if drive else hit)
