"""Terms to columns. One query becomes one column, cheap tests first, for Catalyst to push down."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import globs, paths
from quillon.operators.query import Query, Term

#: Order of evaluation: numbers and flags before text, patterns last.
_COST = ["type", "flag", "size", "mtime", "ctime", "suffix", "ext", "prefix", "name", "path", "skip", "name_glob", "path_glob", "regex"]


def _between(c: Column, bounds: tuple[int | None, int | None]) -> Column:
    least, below = bounds
    if least is not None and below is not None and least > below:
        return F.lit(False)
    parts = ([c >= least] if least is not None else []) + ([c < below] if below is not None else [])
    return reduce(and_, parts, F.lit(True))


def term_column(t: Term) -> Column:
    """Over the columns name_l and path_ci and those of an entry."""
    name, path, v = F.col("name_l"), F.col("path_ci"), t.value
    if t.kind == "name":
        return name.contains(v)
    if t.kind == "suffix":
        return name.endswith(v)
    if t.kind == "ext":
        return reduce(or_, [name.endswith("." + e) for e in v])
    if t.kind == "name_glob":
        return globs.matches(name, v, True)
    if t.kind == "path_glob":
        return globs.matches(path, v, False)
    if t.kind == "path":
        return path.contains(v)
    if t.kind == "prefix":
        return path.startswith(v)
    if t.kind == "skip":
        return reduce(or_, [paths.has_component(path, p) for p in v])
    if t.kind == "regex":
        return name.rlike(v)
    if t.kind == "type":
        return F.col("is_dir") if v else ~F.col("is_dir")
    if t.kind == "flag":
        return paths.has_flag(F.col("flags"), v[0]) == F.lit(v[1])
    return _between(F.col(t.kind), v)


def predicate(q: Query) -> Column:
    """All included terms and none of the excluded ones; no terms: every row."""
    terms = [(t, False) for t in q.include] + [(t, True) for t in q.exclude]
    terms.sort(key=lambda x: _COST.index(x[0].kind))
    return reduce(and_, [~term_column(t) if no else term_column(t) for t, no in terms], F.lit(True))
