"""Sharding by histogram sort: exact byte counts below probes, refined until splitters fit.

Rows get a 126-bit sort key: 63 bits of a hash of the text, then 63 bits of a hash of the id.
Equal texts are therefore neighbours and a group of copies is only cut where a shard ends, yet
a group with a third of all rows still splits, by id; rows equal in both that weigh more than a
splitter may miss split by a number that is written with them. All steps are DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import durable, join_small, keeps_names, public

#: Bits that one round of probes adds to a boundary: 512 probes in each open interval.
ROUND_BITS = 9
KEY_BITS = 63
#: A splitter may miss its target by this share of a shard.
TOLERANCE = 0.0005
#: Bytes that one task sorts within a shard.
BIN_BYTES = 64 << 20
MAX_BIN_BITS = 20


def with_key(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Add _size (UTF-8 bytes + 1; null text: 1) and the key (_k1, _k2), both non-negative."""
    text_c, id_c = F.col(text), F.col(id_col)
    return df.select(
        "*",
        (F.coalesce(F.octet_length(text_c), F.lit(0)).cast("long") + 1).alias("_size"),
        F.shiftrightunsigned(F.xxhash64(F.coalesce(text_c, F.lit(""))), 1).alias("_k1"),
        F.shiftrightunsigned(F.xxhash64(id_c.cast("string"), F.lit("id")), 1).alias("_k2"),
    )


def with_runs_split(rows: DataFrame, keys: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """``rows`` of :func:`with_key` and their ``keys`` (_k1, _k2, _size), rows that share a key of more than ``limit`` bytes dealt over the keys of their text.

    Those get a hash of a number as the second half of their key. Numbers depend on partitions, so the rows are
    written with them; all others stay as they are. Keys so heavy are at most total / limit.
    """
    runs = keys.groupBy("_k1", "_k2").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > limit))
    runs = durable(runs.select("_k1", "_k2", F.lit(True).alias("_run")), "shard-runs")
    marked = lambda x: join_small(x, runs, ["_k1", "_k2"])
    light = lambda x: marked(x).where("_run IS NULL").drop("_run")
    dealt = marked(rows).where("_run").drop("_run").withColumn("_k2", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit("run")), 1))
    dealt = durable(dealt, "shard-dealt")
    return light(rows).unionByName(dealt), durable(light(keys).unionByName(dealt.select("_k1", "_k2", "_size")), "shard-keys")


def _prefix(bits: int) -> Column:
    """The leading ``bits`` bits of the key: a pair of longs."""
    if bits <= KEY_BITS:
        return F.struct(F.shiftright("_k1", KEY_BITS - bits).alias("p"), F.lit(0).cast("long").alias("q"))
    return F.struct(F.col("_k1").alias("p"), F.shiftright("_k2", 2 * KEY_BITS - bits).alias("q"))


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Keys at which shards 1.. begin, so that bytes are near equal.

    ``keys`` has _k1, _k2, _size. Each round counts exact bytes below the probes that divide
    the intervals still open: one aggregate of at most (shards - 1) * 2**ROUND_BITS groups,
    whatever the input. A boundary closes when a probe is within ``tolerance`` of its target
    or when its interval is a single key; :func:`with_runs_split` sees to it that no key is heavy.
    """
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    targets = {j: total * j / shards for j in range(1, shards)}
    found: dict[int, tuple[int, int]] = {}
    #: boundary -> (interval as a prefix, exact bytes below it)
    open_: dict[int, tuple[tuple[int, int], int]] = {j: ((0, 0), 0) for j in targets}
    bits = 0
    while open_ and total:
        nxt = min(bits + ROUND_BITS, KEY_BITS if bits < KEY_BITS else 2 * KEY_BITS)
        rows = keys
        if bits:
            parts = sorted({p for p, _ in open_.values()})
            inside = reduce(
                lambda a, b: a | b,
                [(_prefix(bits)["p"] == p) & (_prefix(bits)["q"] == q) for p, q in parts],
            )
            rows = keys.where(inside)
        counts = (
            rows.groupBy(_prefix(bits)["p"].alias("p0"), _prefix(bits)["q"].alias("q0"),
                         _prefix(nxt)["p"].alias("p"), _prefix(nxt)["q"].alias("q"))
            .agg(F.sum("_size").alias("n")).collect()
        )
        hist: dict[tuple[int, int], list] = {}
        for r in counts:
            hist.setdefault((r.p0, r.q0), []).append(((r.p, r.q), r.n))
        still = {}
        for j, (at, below) in open_.items():
            cells = sorted(hist[at])
            for k, (cell, n) in enumerate(cells):
                if below + n >= targets[j] or k == len(cells) - 1:
                    break
                below += n
            left, right = targets[j] - below, below + n - targets[j]
            if min(left, right) <= tolerance * total / shards or nxt == 2 * KEY_BITS:
                edge = cell if left <= right else (_next(cell, nxt))
                found[j] = _whole(edge, nxt)
            else:
                still[j] = (cell, below)
        open_, bits = still, nxt
    return [found.get(j, (0, 0)) for j in sorted(targets)]


def _next(cell: tuple[int, int], bits: int) -> tuple[int, int]:
    return (cell[0] + 1, 0) if bits <= KEY_BITS else (cell[0], cell[1] + 1)


def _whole(cell: tuple[int, int], bits: int) -> tuple[int, int]:
    """The smallest key with this prefix; one past the last key stays comparable."""
    if bits <= KEY_BITS:
        return cell[0] << (KEY_BITS - bits), 0
    return cell[0], cell[1] << (2 * KEY_BITS - bits)


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the row's key."""
    top = (1 << KEY_BITS) - 1
    out = F.lit(0)
    for p, q in bounds:
        if p > top:
            continue
        above = F.col("_k1") > F.lit(p).cast("long")
        tie = (F.col("_k1") == F.lit(p).cast("long")) & (F.col("_k2") >= F.lit(min(q, top)).cast("long"))
        out = out + F.when(above | tie, 1).otherwise(0)
    return out.cast("int")


@keeps_names
def shard_by_bytes(df: DataFrame, shards: int = 8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All rows of ``df`` with _size, _k1, _k2, shard and slot (gapless from 0 in each shard).

    Law: sizes of shards are near equal (see :func:`splitters`). Rows move once, by (shard, bin):
    a bin is a slice of the key space of about BIN_BYTES, so a shard is sorted by many tasks.
    A slice that is much heavier (many copies of one text) is sliced again by the second half
    of the key. Slots follow (slice, sub-slice, key). Which of several rows equal in text and id
    comes first is open; they share a shard unless they weigh more than a splitter may miss
    (:func:`with_runs_split`). Null text counts one byte, null id is a key of its own.
    An empty table gives no rows. Columns named like the added ones are replaced.
    """
    df = public(df, "shard", "slot")
    rows = with_key(df, text, id_col)
    keys = durable(rows.select("_k1", "_k2", "_size"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    rows, keys = with_runs_split(rows, keys, min(TOLERANCE * total / shards, BIN_BYTES))
    bounds = splitters(keys, shards)
    bits = min(MAX_BIN_BITS, max(0, (total // BIN_BYTES).bit_length()))
    slice_ = F.shiftright("_k1", KEY_BITS - bits)
    heavy = durable(
        keys.groupBy(slice_.alias("_slice")).agg(F.sum("_size").alias("n"))
        .where(F.col("n") > 2 * BIN_BYTES)
        .select("_slice", F.least(F.lit(20), F.ceil(F.log2(F.col("n") / BIN_BYTES))).cast("int").alias("_more")),
        "shard-heavy",
    )

    def binned(x: DataFrame) -> DataFrame:
        x = join_small(x.withColumn("shard", shard_of(bounds)).withColumn("_slice", slice_), heavy, ["_slice"])
        sub = F.when(F.col("_more").isNull(), F.lit(0).cast("long")).otherwise(
            F.expr(f"shiftright(_k2, {KEY_BITS} - _more)"))
        return x.withColumn("_sub", sub).drop("_more")

    at = ["shard", "_slice", "_sub"]
    sizes = binned(keys).groupBy(*at).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_slice", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(sizes.select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")), "shard-offsets")
    place = F.row_number().over(Window.partitionBy(*at).orderBy("_k1", "_k2"))
    placed = binned(rows).withColumn("_row", place)
    out = join_small(placed, offsets, at)
    return out.withColumn("slot", (F.col("_from") + F.col("_row") - 1).cast("long")).drop("_slice", "_sub", "_row", "_from")
