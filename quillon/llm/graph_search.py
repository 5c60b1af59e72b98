"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard.

Vectors are dealt to bands of length, a doubling each, and within a band to shards by hash. A shard
builds a graph over its different vectors: greedy searches from the middle propose neighbours, and a
neighbour is left out when one that is kept is closer to it by the factor ALPHA. Queries run a beam
search in every shard, in blocks, and the best of all shards are scored exactly. Inner products become
distances by one more coordinate, which makes all vectors of a shard equally long; as lengths in a band
are alike, that coordinate never outweighs the others, and neighbours in the graph are neighbours
for queries. Shards hold vectors scaled by their band and queries are scaled to length 1, which changes
no order, so single precision serves vectors of any size. There are at most some 2,000 bands.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillon.llm.common import durable, join_small

#: Different vectors in a shard, about; and queries that search a shard in one task.
SHARD_ROWS, QUERY_BLOCK = 8192, 2048
#: Out-degree, beam widths while building and searching, and the factor of relaxed pruning.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 64, 96, 1.2
#: Nodes inserted together; nodes that the first ones are linked with directly.
BATCH = 512


def longer(x: np.ndarray) -> np.ndarray:
    """Float32 vectors with one more coordinate that makes their lengths equal."""
    n = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(0, n.max(initial=0.0) - n))]).astype(np.float32)


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of rows q[b] to x[ids[b, :]]; infinite where the id is -1."""
    near = x[np.maximum(ids, 0)]
    d = np.einsum("brk,brk->br", near, near) - 2 * np.einsum("brk,bk->br", near, q)
    return np.where(ids < 0, np.inf, d)


def beam_search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For all rows of q together: the ``width`` nearest ids found (-1: none) and their distances.

    Distances lack the constant |q|^2. Each step expands every row's nearest unexpanded id.
    """
    b = len(q)
    ids = np.full((b, width), -1, np.int64)
    dist = np.full((b, width), np.inf)
    done = np.zeros((b, width), bool)
    n = min(width, len(start))
    ids[:, :n] = start[:n]
    dist[:, :n] = _distances(x, q, ids[:, :n])
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    rows = np.arange(b)
    while len(rows):
        open_ = ~done[rows] & (ids[rows] >= 0)
        rows = rows[open_.any(axis=1)]
        if not len(rows):
            break
        at = np.argmax(~done[rows] & (ids[rows] >= 0), axis=1)
        done[rows, at] = True
        new = graph[ids[rows, at]]
        seen = (new[:, :, None] == ids[rows][:, None, :]).any(axis=2)
        new = np.where(seen, -1, new)
        d = _distances(x, q[rows], new)
        all_ids, all_d = np.concatenate([ids[rows], new], 1), np.concatenate([dist[rows], d], 1)
        all_done = np.concatenate([done[rows], np.zeros(new.shape, bool)], 1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(v, order, 1) for v in (all_ids, all_d, all_done))
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For all nodes together: up to ``degree`` diverse neighbours out of cand[node, :] (-1: none)."""
    cand = np.where(cand == nodes[:, None], -1, np.sort(cand, axis=1))
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    own = np.einsum("bk,bk->b", x[nodes], x[nodes])
    d = np.maximum(0, _distances(x, x[nodes], cand) + own[:, None])
    d[cand < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    vectors = x[np.maximum(cand, 0)]
    squares = np.einsum("brk,brk->br", vectors, vectors)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = np.argmin(d, axis=1)
        good = np.isfinite(d[rows, best])
        if not good.any():
            break
        out[:, k] = np.where(good, cand[rows, best], -1)
        v = vectors[rows, best]
        between = np.maximum(0, squares + squares[rows, best][:, None] - 2 * np.einsum("brk,bk->br", vectors, v))
        d[(alpha * alpha * between <= d) & good[:, None]] = np.inf
        d[rows, best] = np.inf
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(graph, start): out-neighbours of every row of x, and ids that searches begin at.

    Rows are inserted in batches: each searches what is there, is pruned, and its neighbours get
    the edge back, being pruned again when they have more than DEGREE.
    """
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    order = np.random.default_rng(n).permutation(n)
    middle = np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)) if n else 0
    order = np.concatenate([[middle], order[order != middle]]) if n else order
    start = order[: min(n, 8)]
    at = 0
    while at < n:
        batch = order[at : at + min(BATCH, max(32, at))]
        near, _ = beam_search(x, graph, start, x[batch], BUILD_BEAM) if at else (np.empty((len(batch), 0), np.int64), None)
        together = np.broadcast_to(batch, (len(batch), len(batch))) if at == 0 else batch[np.random.default_rng(at).integers(0, len(batch), (len(batch), 8))]
        found = robust_prune(x, batch, np.concatenate([near, together], 1))
        graph[batch] = found
        source, target = np.repeat(batch, DEGREE), found.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(nodes), 2048):
            part, f, c = nodes[low : low + 2048], first[low : low + 2048], count[low : low + 2048]
            width = int(c.max())
            place = f[:, None] + np.arange(width)
            back = np.where(np.arange(width) < c[:, None], source[np.minimum(place, len(source) - 1)], -1)
            both = np.concatenate([graph[part], back], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            crowded = (both >= 0).sum(axis=1) > DEGREE
            both = -np.sort(-both, axis=1)
            fit = both[:, :DEGREE]
            graph[part[~crowded], : fit.shape[1]] = fit[~crowded]
            if crowded.any():
                graph[part[crowded]] = robust_prune(x, part[crowded], both[crowded])
        at += len(batch)
    return graph, start


def _log_length(vector: str) -> Column:
    """The logarithm (base 2) of a vector's length, for components of any finite size."""
    most = F.array_max(F.transform(vector, F.abs))
    squares = F.aggregate(F.transform(vector, lambda x: F.pow(x / most, F.lit(2))), F.lit(0.0), lambda s, x: s + x)
    return F.log2(most) + F.log2(squares) / 2


def scaled(raw: np.ndarray, band: int) -> np.ndarray:
    """Float32 vectors of a band, their lengths between 0.7 and 1.5."""
    return np.ldexp(raw, -band).astype(np.float32)


def unit(q: np.ndarray) -> np.ndarray:
    """Float32 vectors of length 1 in the directions of q, with the coordinate that :func:`longer` adds."""
    q = q / np.abs(q).max(axis=1, initial=0.0, keepdims=True)
    q = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
    return np.column_stack([q, np.zeros(len(q))]).astype(np.float32)


_INDEX = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("band", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("n", T.IntegerType()),
                       T.StructField("keys", T.BinaryType()), T.StructField("vectors", T.BinaryType()), T.StructField("graph", T.BinaryType()), T.StructField("start", T.BinaryType())])


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    raw = scaled(np.array(pdf["vector"].tolist(), np.float64), int(pdf["band"].iloc[0]))
    graph, start = build(longer(raw))
    return pd.DataFrame({
        "dim": [int(pdf["dim"].iloc[0])], "band": [int(pdf["band"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "n": [len(raw)], "keys": [pdf["key"].to_numpy(np.int64).tobytes()],
        "vectors": [raw.tobytes()], "graph": [graph.astype(np.int32).tobytes()], "start": [start.astype(np.int32).tobytes()],
    })


def build_index(vectors: DataFrame) -> DataFrame:
    """One row per shard with its vectors and graph, from vectors(dim, key, vector), all different."""
    rows = durable(vectors.withColumn("band", F.floor(_log_length("vector") + 0.5).cast("int")), "graph-bands")
    shards = durable(rows.groupBy("dim", "band").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("shards")), "graph-shards")
    rows = join_small(rows, shards, ["dim", "band"], "inner").withColumn("shard", F.pmod(F.xxhash64("key"), "shards").cast("int"))
    return durable(rows.groupBy("dim", "band", "shard").applyInPandas(_build_shard, _INDEX), "graph-index")


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, key): for each of queries(qid, dim, vector) the k nearest keys of every shard.

    Queries get the numbers of their shards from one row a dimension and band, not from a join with all shards,
    and meet a shard by (dim, band, shard, block).
    """
    shards = durable(index.groupBy("dim", "band").agg((F.max("shard") + 1).alias("shards")), "graph-shards")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.select("qid", "dim", "vector", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"))
    asked = join_small(asked, shards, ["dim"], "inner").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": np.empty(0, np.int64), "key": np.empty(0, np.int64)})
        r = right.iloc[0]
        raw = np.frombuffer(r["vectors"], np.float32).reshape(r["n"], r["dim"])
        graph = np.frombuffer(r["graph"], np.int32).reshape(r["n"], DEGREE).astype(np.int64)
        x, keys = longer(raw), np.frombuffer(r["keys"], np.int64)
        start = np.frombuffer(r["start"], np.int32).astype(np.int64)
        q = unit(np.array(left["vector"].tolist(), np.float64))
        out = []
        for at in range(0, len(q), 256):
            ids, _ = beam_search(x, graph, start, q[at : at + 256], max(BEAM, 2 * k))
            some = ids[:, :k]
            good = some >= 0
            out.append(pd.DataFrame({"qid": np.repeat(left["qid"].to_numpy()[at : at + 256], good.sum(axis=1)), "key": keys[some[good]]}))
        return pd.concat(out)

    at = ["dim", "band", "shard", "block"]
    return asked.groupBy(*at).cogroup(held.groupBy(*at)).applyInPandas(run, "qid long, key long")


def nearest(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score for each row where ``is_query`` holds: the k rows of
    largest inner product that the search finds, over all rows but the query's own id.

    Equal vectors are one node of the graph, so that copies crowd out nothing; its rows come
    back in order of their ids, as many as can be among the k. Rows without id, and vectors
    that are null, empty, zero or hold a null or non-finite component, take no part. Vectors of
    different lengths are not compared. Components may have any finite size. Rows repeated whole count once. Ties go to the smaller
    id. An empty table gives no rows.
    """
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), is_query.alias("asks"))
    # x + 0.0 makes the two zeros one
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("dim", F.size("vector"))
    rows = durable(rows.withColumn("key", F.xxhash64("vector")), "graph-rows")
    # of one vector at most k + 1 rows can be among the k (the query's own is left out)
    place = Window.partitionBy("key").orderBy("id")
    ids = rows.groupBy("key", "id").agg(F.lit(1)).select("key", "id").withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1).drop("r")
    ids = durable(ids, "graph-ids")
    vectors = durable(rows.groupBy("dim", "key").agg(F.first("vector").alias("vector")), "graph-vectors")
    asked = rows.where("asks").groupBy("id", "key").agg(F.first("dim").alias("dim"))
    # equal queries search once: the key stands for the vector
    asked = durable(asked, "graph-asked")
    unique = vectors.join(asked.select("key").distinct(), "key", "left_semi").select(F.col("key").alias("qid"), "dim", "vector")
    found = durable(search(build_index(vectors), durable(unique, "graph-queries"), k + 1), "graph-found")
    pair = found.join(vectors.select("key", "vector"), "key").join(vectors.select(F.col("key").alias("qid"), F.col("vector").alias("q")), "qid")
    product = F.aggregate(F.zip_with("vector", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pair.select("qid", "key", product.alias("score"))
    # keys beyond the k + 1 best of a query cannot be among its k
    best = Window.partitionBy("qid").orderBy(F.desc("score"))
    scored = durable(scored.withColumn("r", F.rank().over(best)).where(F.col("r") <= k + 1).drop("r"), "graph-scored")
    rowed = scored.join(ids, "key").withColumnRenamed("id", "found_id")
    per_query = asked.select(F.col("key").alias("qid"), F.col("id").alias("query_id")).join(rowed, "qid").where("found_id <> query_id")
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "found_id")
    ranked = per_query.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("found_id").alias(id_col), "score")
