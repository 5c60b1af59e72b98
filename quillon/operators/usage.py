"""Disk usage by directory, hard links counted once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators.query import QueryError
from quillon.sources.catalog import with_derived

TOP = 20
MAX_LONG = 2**63 - 1


@dataclass
class Usage:
    root: str
    total_bytes: int
    total_allocated: int
    files: int
    dirs: int
    entries: int
    truncated: bool
    children: DataFrame


def subtree(catalog: DataFrame, root: str) -> DataFrame:
    """Entries at or below ``root``; trailing separators and ASCII case do not matter."""
    ci = paths.fold_path_text(paths.trim_separators(root.strip()))
    if not ci:
        raise QueryError("an empty root")
    return with_derived(catalog).where(paths.starts_under(F.col("path_ci"), ci))


def unique_files(entries: DataFrame) -> DataFrame:
    """One row per record: of several names that with the lowest id. A partial minimum per task,
    so a record with very many names is no burden."""
    key = F.when(F.col("frn").isNotNull(), F.concat(F.lit("f"), paths.drive_of("path"), F.lit(":"), F.col("frn").cast("string"))).otherwise(
        F.concat(F.lit("i"), F.col("id").cast("string")))
    row = F.min_by(F.struct("id", "path", "path_ci", "size", "allocated"), "id")
    return entries.where(~F.col("is_dir")).groupBy(key.alias("_key")).agg(row.alias("_row")).select("_row.*")


def saturating(column: str):
    """The sum of sizes; the largest long if it is beyond that, 0 of none."""
    return F.coalesce(F.try_sum(column), F.when(F.count(column) > 0, F.lit(MAX_LONG)).otherwise(F.lit(0)).cast("long"))


def totals(catalog: DataFrame, root: str) -> DataFrame:
    """One row: total_bytes, total_allocated, files, dirs (the root left out), entries."""
    sub = subtree(catalog, root)
    ci = paths.fold_path_text(paths.trim_separators(root.strip()))
    files = unique_files(sub).agg(saturating("size").alias("total_bytes"), saturating("allocated").alias("total_allocated"), F.count("*").alias("files"))
    rest = sub.agg(
        (F.count_if("is_dir") - F.coalesce(F.max(F.when(F.col("is_dir") & (F.col("path_ci") == ci), 1)), F.lit(0))).cast("long").alias("dirs"), F.count("*").alias("entries"))
    return files.join(F.broadcast(rest))  # one row and one row


def directories(catalog: DataFrame, root: str) -> DataFrame:
    """path, size, allocated, files, depth of the directories below ``root`` that hold any file.

    Files are summed by parent first; only those sums go to the ancestors.
    """
    sub = subtree(catalog, root)
    clean = paths.trim_separators(root.strip())
    sums = [saturating("size").alias("size"), saturating("allocated").alias("allocated")]
    parents = unique_files(sub).groupBy(paths.dirname("path_ci").alias("parent")).agg(*sums, F.count("*").alias("files"))
    up = F.explode(F.array_append(paths.ancestors("parent"), F.col("parent")))
    rolled = parents.select(up.alias("path_ci"), "size", "allocated", "files").groupBy("path_ci").agg(*sums, F.sum("files").alias("files"))
    dirs = sub.where("is_dir").groupBy("path_ci").agg(F.min_by("path", "id").alias("path"))
    out = dirs.join(rolled, "path_ci").withColumn("depth", paths.depth_below(F.col("path"), clean).cast("int"))
    return out.where("depth > 0").select("path", "size", "allocated", "files", "depth")


def largest(children: DataFrame, depth: int | None = None, top: int = TOP, by_allocated: bool = False) -> DataFrame:
    kept = children if depth is None else children.where(F.col("depth") <= depth)
    return kept.orderBy(F.col("allocated" if by_allocated else "size").desc(), F.col("path").asc()).limit(top)


def usage(catalog: DataFrame, root: str, depth: int | None = None, top: int = TOP, by_allocated: bool = False) -> Usage:
    """``truncated`` tells whether there are more than ``top`` directories before the depth is looked at."""
    t, children = totals(catalog, root).first(), directories(catalog, root)
    more = children.limit(top + 1).count() > top
    return Usage(paths.trim_separators(root.strip()), t.total_bytes, t.total_allocated, t.files, t.dirs, t.entries, more, largest(children, depth, top, by_allocated))
