"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of five words. Signatures of MinHash values are banded; texts that
share a band value fall into one coarse component, which no true pair leaves. Inside a component
signatures are compared a few values at a time, and a pair is dropped as soon as the posterior
probability that it reaches the threshold is below EPSILON. Pairs that are left are verified exactly.

Texts with equal sets count as one with a weight, so exact copies never become pairs. Large
components are cut into blocks by set size and hash; pairs are counted block by block and only
sums and a spanning forest leave a block, never the pairs themselves.
"""

from __future__ import annotations

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import components, durable, join_small, keeps_names, public

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
#: 32 bands of 4 values: a pair at the threshold shares none with probability 5e-8.
HASHES, BANDS = 128, 32
#: Values compared at a time, and the posterior probability below which a pair is dropped.
STEP, EPSILON = 16, 1e-9
#: A block holds at most about so many texts and shingles.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 2_000_000
SEED = 20240229

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the prime and of its inverse; the latest are kept."""
    if len(_KEPT.get("powers", ((),))[0]) >= n:
        return _KEPT["powers"]
    up, down = np.full(n, _PRIME, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    _KEPT["powers"] = np.cumprod(up), np.cumprod(down)
    return _KEPT["powers"]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; of all words if there are fewer.

    Words are runs of anything but white space. No words, no shingles. Word hashes are differences
    of one running polynomial over the bytes, so cost is linear in the text.
    """
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.int8), [1]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(12, len(b).bit_length()))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
    words = _mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    k = min(size, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(_PRIME) + words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(out)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, HASHES, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """HASHES minima, 32 bits each, over the shingles, a few thousand at a time."""
    if "functions" not in _KEPT:
        _KEPT["functions"] = _functions()
    a, b = _KEPT["functions"]
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 2048):
        out = np.minimum(out, ((s[i : i + 2048, None] * a + b) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return out


def least_matches(n: int, threshold: float, epsilon: float) -> int:
    """The fewest matches among n values with which a pair is kept.

    With a uniform prior the similarity given m matches is Beta(m + 1, n - m + 1); the
    probability that it reaches t is that of at most m successes in n + 1 trials of chance t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= epsilon:
            return m
    return n


def surviving(left: np.ndarray, right: np.ndarray, threshold: Fraction = THRESHOLD, epsilon: float = EPSILON, same: bool = False):
    """Index pairs of signatures that incremental comparison does not drop (i < j if same)."""
    t = float(threshold)
    matches = np.zeros((len(left), len(right)), np.uint8)
    for k in range(STEP):
        matches += left[:, k, None] == right[None, :, k]
    alive = matches >= least_matches(STEP, t, epsilon)
    if same:
        alive &= np.tri(len(left), k=-1, dtype=bool).T
    i, j = np.nonzero(alive)
    m = matches[i, j].astype(np.int64)
    for n in range(2 * STEP, HASHES + 1, STEP):
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            m[part] += (left[i[part], n - STEP : n] == right[j[part], n - STEP : n]).sum(axis=1)
        keep = m >= least_matches(n, t, epsilon)
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs (left[i], right[j])."""
    if len(i) <= 2000:
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    values, counts = np.unique(np.concatenate([np.concatenate(left), np.concatenate(right)]), return_counts=True)
    shared = values[counts > 1]

    def dense(sets, low, high):
        out = np.zeros((len(sets), high - low), np.float32)
        for k, s in enumerate(sets):
            at = np.searchsorted(shared, s)
            at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == s)]
            out[k, at[(at >= low) & (at < high)] - low] = 1
        return out

    total = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(shared), 4096):
        high = min(low + 4096, len(shared))
        total += dense(left, low, high) @ dense(right, low, high).T
    return total[i, j].astype(np.int64)


def links_in(sig: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, threshold: Fraction = THRESHOLD, same: bool = True):
    """For one pair of blocks (side 0 and 1; ``same``: one block with itself, all 0): the weight linked to
    each text, and for each text the least text of its group (a spanning forest)."""
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    b = a if same else b
    links, root = np.zeros(len(sig), np.int64), np.arange(len(sig))
    if not len(a) or not len(b):
        return links, root
    i, j = surviving(sig[a], sig[b], threshold, same=same)
    if len(i):
        sizes = np.array([len(s) for s in sets])
        common = overlaps([sets[x] for x in a], [sets[x] for x in b], i, j)
        p, q = threshold.numerator, threshold.denominator
        good = common * (p + q) >= p * (sizes[a[i]] + sizes[b[j]])
        i, j = a[i[good]], b[j[good]]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return links, root


def digest_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _texts(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with _digest, which stands for the text's set of shingles (null without words)."""
    schema = T.StructType([*df.schema.fields, T.StructField("_digest", T.BinaryType())])

    def run(batches):
        for batch in batches:
            d = [digest_of(shingles(t)) for t in _texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d, pa.binary())], names=[*batch.schema.names, "_digest"])

    return df.mapInArrow(run, schema)


def _signed(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [shingles(t) for t in _texts(batch, "_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["_id", "_digest", "_n", "_sig"],
            )

    return rows.mapInArrow(run, "_id long, _digest binary, _n long, _sig binary")


def _with_sets(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for text, want, *rest in zip(*[_texts(batch, c) for c in ("_text", "_digest", "root", "_n", "w", "_sig")], strict=True):
                s = shingles(text)
                if digest_of(s) == want:
                    out.append((want, *rest, s.tobytes()))
            cols = zip(*out, strict=True) if out else ((),) * 6
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_digest", "root", "_n", "w", "_sig", "_set"])

    return rows.mapInArrow(run, "_digest binary, root binary, _n long, w long, _sig binary, _set binary")


def _blocks(members: DataFrame) -> DataFrame:
    """One row per text and pair of blocks it takes part in: g, h, g2, h2 name the pair, side its place.

    A component that fits is one block. Others are cut by the logarithm of the set size (texts
    at the threshold differ by one class at most) and, within a class, by hash.
    """
    size_class = F.floor(F.log("_n") / math.log(float(1 / THRESHOLD))).cast("int")
    fits = (F.col("rows") <= BLOCK_ROWS) & (F.col("total") <= 2 * BLOCK_SHINGLES)
    whole = durable(members.groupBy("root").agg(F.count("*").alias("rows"), F.sum("_n").alias("total")).select("root", fits.alias("fits")), "jaccard-sizes")
    rows = durable(join_small(members, whole, ["root"]).withColumn("g", F.when(F.col("fits"), 0).otherwise(size_class)), "jaccard-members")
    zero = F.lit(0)
    small = rows.where("fits").select("*", zero.alias("h"), zero.alias("g2"), zero.alias("h2"), zero.alias("side"))
    large = rows.where("NOT fits")
    cut = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("_n") / BLOCK_SHINGLES)).cast("int")
    cuts = durable(large.groupBy("root", "g").agg(cut.alias("cut")), "jaccard-cuts")
    for name, shift in (("cut", 0), ("cut_up", -1), ("cut_down", 1)):
        large = join_small(large, cuts.select("root", (F.col("g") + shift).alias("g"), F.col("cut").alias(name)), ["root", "g"])
    large = large.withColumn("k", F.pmod(F.xxhash64("_digest"), "cut").cast("int"))
    to = lambda n: F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda g, h, g2, h2, side: F.struct(g.alias("pg"), h.alias("h"), g2.alias("g2"), h2.alias("h2"), side.alias("side"))
    g, k = F.col("g"), F.col("k")
    pairs = F.concat(
        F.transform(to("cut"), lambda x: pair(g, F.least(k, x), g, F.greatest(k, x), F.when(k > x, 1).otherwise(0))),
        F.transform(to("cut_up"), lambda x: pair(g, k, g + 1, x, F.lit(0))),
        F.transform(to("cut_down"), lambda x: pair(g - 1, x, g, k, F.lit(1))),
    )
    large = large.select("_digest", "root", "_n", "w", "_sig", "_set", F.inline(pairs))
    names = ["_digest", "root", "_n", "w", "_sig", "_set"]
    return small.select(*names, "g", "h", "g2", "h2", "side").union(large.select(*names, "pg", "h", "g2", "h2", "side"))


def _count_links(pdf: pd.DataFrame) -> pd.DataFrame:
    sig = np.frombuffer(b"".join(pdf["_sig"]), np.uint32).reshape(-1, HASHES)
    sets = [np.frombuffer(x, np.uint64) for x in pdf["_set"]]
    same = (pdf["g"].iloc[0], pdf["h"].iloc[0]) == (pdf["g2"].iloc[0], pdf["h2"].iloc[0])
    links, root = links_in(sig, sets, pdf["w"].to_numpy(), pdf["side"].to_numpy(), same=same)
    some = links > 0
    ids = pdf["_digest"].to_numpy()
    return pd.DataFrame({"id": ids[some], "links": links[some], "to": ids[root[some]]})


def classes(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, sets): rows has _id and _digest for each row of ``df``; sets has _digest, class_id, links.

    Links of a set: the rows of other sets at or above the threshold, plus its own copies. class_id
    is the least id of the connected group. Texts below five words count as one shingle of all
    their words; texts without words link to nothing.
    """
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text"))
    signed = durable(_signed(rows), "jaccard-signed")
    known = signed.where("_digest IS NOT NULL")
    sets = known.groupBy("_digest").agg(F.min("_id").alias("_id"), F.count("*").alias("w"), F.first("_n").alias("_n"), F.first("_sig").alias("_sig"))
    sets = durable(sets, "jaccard-sets")
    width = 4 * HASHES // BANDS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("_sig", 1 + b * width, width)) for b in range(BANDS)])
    buckets = sets.select("_digest", F.explode(bands).alias("k"))
    least = buckets.groupBy("k").agg(F.min("_digest").alias("m"), F.count("*").alias("c")).where("c > 1").drop("c")
    edges = buckets.join(least, "k").select(F.col("_digest").alias("a"), F.col("m").alias("b"))
    coarse = durable(components(edges, "jaccard-coarse"), "jaccard-coarse-roots")
    members = sets.join(coarse, sets["_digest"] == coarse["id"]).drop("id")
    members = durable(members, "jaccard-wanted")
    names = ["_text", "_digest", "root", "_n", "w", "_sig"]
    with_text = join_small(rows.where("_id IS NOT NULL"), members.where("_id IS NOT NULL"), ["_id"], "inner").select(*names)
    unnamed = members.where("_id IS NULL")
    if unnamed.limit(1).count():  # sets that stand under no id: by the digest, as all of these would meet all rows without an id
        marked = with_digest(rows.where("_id IS NULL").select("_text"), "_text")
        with_text = with_text.union(join_small(marked, unnamed, ["_digest"], "inner").dropDuplicates(["_digest"]).select(*names))
    full = durable(_with_sets(with_text), "jaccard-texts").dropDuplicates(["_digest"])
    counted = _blocks(durable(full, "jaccard-full")).groupBy("root", "g", "h", "g2", "h2").applyInPandas(_count_links, "id binary, links long, to binary")
    counted = durable(counted, "jaccard-links")
    groups = durable(components(counted.select(F.col("id").alias("a"), F.col("to").alias("b")), "jaccard-groups"), "jaccard-roots")
    sums = counted.groupBy("id").agg(F.sum("links").alias("links"))
    tied = sets.select("_digest", "_id", "w").join(groups.withColumnRenamed("id", "_digest"), "_digest", "left").join(sums.withColumnRenamed("id", "_digest"), "_digest", "left")
    tied = durable(tied.withColumn("root", F.coalesce("root", "_digest")), "jaccard-tied")
    least_id = tied.groupBy("root").agg(F.min("_id").alias("class_id"))
    out = tied.join(least_id, "root").select("_digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    return signed.select("_id", "_digest"), durable(out, "jaccard-classes")


@keeps_names
def join(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: the id, class_id and n_links.

    n_links counts the other rows whose sets reach the threshold, copies included. Null and empty
    texts, and texts of white space, are alone: class_id is their own id and n_links 0. Null ids
    never name a class unless all its ids are null. An empty table gives no rows.
    """
    rows, sets = classes(df, text, id_col)
    out = join_small(rows, sets, ["_digest"])
    return out.select(F.col("_id").alias(id_col), F.when(F.col("_digest").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


@keeps_names
def one_of_each(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with one row of each class, that of the least id; rows without words all stay."""
    df = public(df)
    rows, sets = classes(df, text, id_col)
    full = durable(join_small(rows, sets, ["_digest"]).where("_digest IS NOT NULL"), "jaccard-rows")
    # one text of the class under its least id; several texts can bear that id
    best = full.where(F.col("_id").eqNullSafe(F.col("class_id"))).join(sets.select("_digest"), "_digest", "left_semi")
    roots = full.select("_id", "_digest", "class_id")
    keep = best.groupBy("class_id").agg(F.min("_digest").alias("_digest"))
    lost = roots.join(keep.withColumnRenamed("_digest", "_best"), roots["class_id"].eqNullSafe(keep["class_id"]), "left")
    lost = lost.where(~(F.col("_id").eqNullSafe(roots["class_id"]) & (F.col("_digest") == F.col("_best"))))
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    lost = durable(lost.select(key(F.col("_id")).alias("_key"), "_digest").distinct(), "jaccard-lost")
    marked = with_digest(df, text).withColumn("_key", key(F.col(id_col).cast("long")))
    left = join_small(marked, lost, ["_key", "_digest"], "left_anti")
    again = full.groupBy(key(F.col("_id")).alias("_key"), "_digest").agg(F.count("*").alias("c")).where("c > 1")
    again = durable(again.join(lost, ["_key", "_digest"], "left_anti").drop("c").withColumn("_again", F.lit(True)), "jaccard-again")
    if again.limit(1).count():  # repeated rows of one id and text: one of them stays
        seen = join_small(left, again, ["_key", "_digest"])
        left = seen.where("_again IS NULL").union(seen.where("_again").dropDuplicates(["_key", "_digest"]))
    return left.select(*df.columns)
