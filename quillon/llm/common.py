"""Helpers shared by the training-data operators: durable tables, checked broadcasts, components.

Recovery from lost executors: whatever a later step reads more than once is written with
:func:`durable` to the folder that ``spark.checkpoint.dir`` names, which all executors share.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may be broadcast; rows are narrow (a few hundred bytes).
BROADCAST_ROWS = 100_000
#: Words are maximal runs of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows whose ``column`` has about ``limit`` bytes, so that Python
    objects exist for a few megabytes of texts at a time, however many rows a batch has."""
    for batch in batches:
        values = batch.column(column)
        if values.nbytes <= limit:
            yield batch
            continue
        lists = pa.types.is_list(values.type)
        lengths = pc.list_value_length(values) if lists else pc.binary_length(values)
        ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) * (4 if lists else 1)
        at = 0
        while at < len(values):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def scratch(spark: SparkSession) -> str:
    """The shared folder; one of our own only in local sessions that name none (tests, bench)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def public(df: DataFrame, *replaced: str) -> DataFrame:
    """``df`` without the columns an operator adds."""
    own = {c.lower() for c in replaced}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in own])


def keeps_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Names that begin with an underscore are the operators' own: inside one, such columns of its first
    argument bear other names, and their own again in the result, but those that it adds itself. Arguments that
    are columns are worked out before, under the names that the caller knows."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **more) -> DataFrame:
        taken, to = {c.lower() for c in df.columns}, {}
        for c in df.columns:
            if c.startswith("_"):
                k = next(k for k in range(len(taken) + 1) if f"own{k}{c}".lower() not in taken)
                to[c] = f"own{k}{c}"
                taken.add(to[c].lower())
        if not to:
            return operator(df, *args, **more)
        given = {}

        def named(x):
            if isinstance(x, Column):
                given[name := f"argument{len(given)}_{uuid.uuid4().hex[:8]}"] = x
                return F.col(name)
            return to.get(x, x) if isinstance(x, str) else x

        args, more = [*map(named, args)], {k: named(x) for k, x in more.items()}
        out = operator(df.withColumns(given).withColumnsRenamed(to), *args, **more).drop(*given)
        added = {c.lower() for c in out.columns}
        back = {new: old for old, new in to.items() if new in out.columns}
        return out.drop(*[new for new, old in back.items() if old.lower() in added]).withColumnsRenamed({new: old for new, old in back.items() if old.lower() not in added})

    return run


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a durable table that is usually small: broadcast if its count allows it.

    Beyond ``BROADCAST_ROWS`` it is an ordinary join, whose skewed keys Spark splits (AQE).
    """
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on, how)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (id, root), root the smallest id.

    Alternates large-star and small-star rounds until the edges stay the same. Each round
    pre-aggregates minima before its shuffle, so that a hub with very many neighbours is a
    partial minimum per task, never a collected group. Edges are cut to a durable table per round.
    """
    edges = durable(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        both = edges.union(edges.select("b", "a"))
        # durable, so that the join sees two plain exchanges and can split a hub's rows
        least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), f"{name}-least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        k += 1
        edges = durable(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), f"{name}-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).union(
        edges.select("b", F.col("b").alias("root")).distinct()
    )
