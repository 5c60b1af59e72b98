"""Paths from parent pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import durable

ROOT = 5


def directory_paths(records: DataFrame, root: int = ROOT, drive: str = "D:") -> DataFrame:
    """(at, path) of the root and of all directories that a chain of directories ties to it.

    By pointer doubling: what is known of a directory is a path from some ancestor; joined with what is known of
    that one it reaches twice as far. So the rounds go with the logarithm of the depth. A round that
    reaches the root from no further directory is the last: whatever is left is an orphan or a cycle.
    A directory with several parents takes its shortest path, ties the least.
    """
    spark = records.sparkSession
    name = F.concat(F.lit("\\"), "name")
    dirs = records.where(F.col("is_dir") & (F.col("frn") != root)).select("frn", F.col("parent_frn").alias("up"), name.alias("path")).groupBy("frn", "up").agg(F.min(F.struct(F.lit(1).alias("n"), "path")).alias("way"))
    known = durable(dirs.select("frn", "up", "way.*"), "tree-ways")
    here, reached = F.col("up") == root, -1
    while True:
        done, left = known.agg(F.count_if(here), F.count_if(~here)).first()
        if done == reached or not left:
            break
        reached = done
        far = known.select(F.col("frn").alias("up"), F.col("up").alias("_up"), F.col("n").alias("_n"), F.col("path").alias("_path"))
        longer = known.where(~here).join(far, "up").select("frn", F.col("_up").alias("up"), (F.col("n") + F.col("_n")).alias("n"), F.concat("_path", "path").alias("path"))
        both = known.where(here).select("frn", "up", "n", "path").union(longer).groupBy("frn", "up").agg(F.min(F.struct("n", "path")).alias("way"))
        known = durable(both.select("frn", "up", "way.*"), "tree-ways")
    found = known.where(here).select(F.col("frn").alias("at"), F.concat(F.lit(drive), "path").alias("path"))
    return found.union(spark.range(1).select(F.lit(root).cast("long").alias("at"), F.lit(drive).alias("path")))


def build(records: DataFrame, root: int = ROOT, drive: str = "D:") -> DataFrame:
    """records(frn, parent_frn, name, is_dir, ...) with path.

    One join gives every record its parent's path (:func:`directory_paths`), so a file with several names or
    parents has a row for each. Records that no chain of directories ties to the root (orphans, cycles,
    children of files) have no path.
    """
    return resolve(records, records, root, drive)


def resolve(records: DataFrame, wanted: DataFrame, root: int = ROOT, drive: str = "D:") -> DataFrame:
    """``wanted``, some of the records, with path."""
    parents = directory_paths(records, root, drive).withColumnRenamed("path", "_parent")
    named = wanted.where(F.col("frn") != root).join(parents, wanted["parent_frn"] == parents["at"])
    return named.withColumn("path", F.concat("_parent", F.lit("\\"), "name")).drop("at", "_parent")


def orphans(records: DataFrame, built: DataFrame, root: int = ROOT) -> DataFrame:
    """Records without a path."""
    return records.where(F.col("frn") != root).join(built.select("frn").distinct(), "frn", "left_anti")


def spilled_metadata(base: DataFrame, extension: DataFrame, columns: list[str], lists: DataFrame | None = None) -> DataFrame:
    """Base records with what extension records hold of them; without one the old value stays.

    ``lists`` (frn, owner) says in which record a base's attribute list places its data: what no
    extension record of the base itself gives is taken from the rows of that owner.
    """
    if lists is not None:
        held = extension.groupBy(F.col("frn").alias("owner")).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
        second = lists.join(held, "owner").groupBy("frn").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
        return spilled_metadata(spilled_metadata(base, second, columns), extension.select("frn", *columns), columns)
    got = extension.groupBy("frn").agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in columns])
    out = base.join(got, "frn", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])
