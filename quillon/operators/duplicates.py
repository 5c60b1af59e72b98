"""Files of equal content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.sources.scratch import durable

MIN_SIZE, LIMIT = 1024, 50
#: Bytes read of every candidate before any is read whole.
HEAD = 1 << 16


def candidates(catalog: DataFrame, min_size: int = MIN_SIZE, name: str | None = None) -> DataFrame:
    """Files that share their size with another, of this size at least and with ``name`` in theirs."""
    files = catalog.where(~F.col("is_dir") & (F.col("size") >= min_size))
    if name:
        files = files.where(paths.fold_name(paths.basename("path")).contains(name.lower()))
    shared = files.groupBy("size").agg(F.count("*").alias("_n")).where("_n > 1").select("size")
    return files.join(shared, "size", "left_semi")


def groups(catalog: DataFrame, contents: DataFrame, min_size: int = MIN_SIZE, name: str | None = None) -> DataFrame:
    """Rows (size, digest, path) of the files in groups of two or more.

    ``contents``: path and content (binary or string); files it lacks cannot be read and count as
    skipped. Contents are equal when size and SHA-256 are: only digests are shuffled. Membership is
    in rows, one per file, so a group of any size is no single value.
    """
    digests = contents.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    hashed = candidates(catalog, min_size, name).select("path", "size").join(digests, "path")
    big = hashed.groupBy("size", "digest").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return hashed.join(big, ["size", "digest"], "left_semi")


def staged(catalog: DataFrame, read: Callable[[DataFrame, int | None], DataFrame], min_size: int = MIN_SIZE, name: str | None = None, head: int = HEAD) -> tuple[DataFrame, int, int]:
    """(found, hashed, skipped): rows as of :func:`groups`, and how many files were read and could not be.

    ``read(paths, first)`` gives (path, digest) of the first bytes, or of everything for None, as
    :func:`quillon.sources.walk.digests` does. Only files that share their size are opened, and only those
    that share size and first ``head`` bytes are read whole; a file that fits in them is read once.
    Each stage is dealt anew by hash, as a task's work is not the rows it has but the bytes it reads.
    """
    tried = candidates(catalog, min_size, name).select("path", "size").distinct()
    wide = lambda df: df.select("path").repartition("path")
    heads = durable(tried.join(read(wide(tried), head), "path", "left"), "dupes-heads")
    counted = heads.agg(F.count("*").alias("n"), F.count_if(F.col("digest").isNull()).alias("bad")).first()
    shared = heads.groupBy("size", "digest").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    left = durable(heads.where("digest IS NOT NULL").join(shared, ["size", "digest"], "left_semi").select("path", "size", "digest"), "dupes-left")
    long = left.where(F.col("size") > head).select("path", "size")
    whole = durable(long.join(read(wide(long), None), "path", "left").select("path", "size", "digest"), "dupes-whole")
    gone = whole.where("digest IS NULL").count()
    every = left.where(F.col("size") <= head).union(whole.where("digest IS NOT NULL"))
    big = every.groupBy("size", "digest").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return every.join(big, ["size", "digest"], "left_semi"), counted.n, counted.bad + gone


def ranked(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(size, digest, files, wasted, first_path): most waste first, then size and path."""
    sums = found.groupBy("size", "digest").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))
    return sums.withColumn("wasted", F.col("size") * (F.col("files") - 1)).orderBy(F.desc("wasted"), F.desc("size"), "first_path").limit(limit)


def wasted(found: DataFrame) -> DataFrame:
    """One row: groups and wasted_bytes of all of them."""
    per = found.groupBy("size", "digest").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("size") * (F.col("n") - 1)), F.lit(0).cast("long")).alias("wasted_bytes"))


def summary(catalog: DataFrame, contents: DataFrame, min_size: int = MIN_SIZE, name: str | None = None) -> DataFrame:
    """One row: groups, wasted_bytes (of all groups, whatever the limit), files_hashed, skipped."""
    tried = candidates(catalog, min_size, name)
    waste = wasted(groups(catalog, contents, min_size, name))
    known = contents.select("path", F.lit(1).alias("_known"))
    seen = tried.join(known, "path", "left").agg(F.count("*").alias("files_hashed"), F.count_if(F.col("_known").isNull()).alias("skipped"))
    return waste.join(F.broadcast(seen))  # one row and one row
