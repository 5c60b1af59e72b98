"""Vector code compression: product codes by Lloyd's rounds over heaps.

Vectors become integers and are cut into equal parts; each part position has a codebook. Rows lie in
blocks of at most ``BLOCK`` rows, and a block keeps, for each part position and entry, a heap of the
parts assigned to it. A heap's key is the slack of a part (a lower bound of the distance to any other
entry less an upper bound of that to its own) plus the drift of the entry when it was pushed. When
entries move, an entry's drift grows by its own step and the longest step of the others; only parts
whose key the drift has reached can have a nearer entry. They are popped and compared with all entries
exactly; a heap whose least key is beyond the drift is not touched. Bounds are rounded to the safe
side, distances are exact integers, so codes equal those of plain rounds.

A round is one pass over blocks in the shared folder. What leaves a block are sums and counts of the
parts that moved; the driver sees codebooks only.

Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of
another length than that of the least id. Components are floor(scale * x), saturating at the longs'
range; an error beyond a long is the largest long. Null ids come last among the rows that give the first entries, ties
go by vector. Repeated rows count as often as they stand there. Columns other than id, vector and label
are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import durable, join_small

BLOCK = 4096
#: Bounds are off by less than this share.
SLIP = 1e-9
MOST = (1 << 63) - 1


def whole_numbers(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows with finite vectors only, with _v, the components as longs."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(x.isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("_v", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def exact(*arrays: np.ndarray) -> type:
    """int64 if no squared distance between rows of these can pass it, else Python's integers."""
    most = max((max(-int(a.min()), int(a.max())) for a in arrays if a.size), default=0)
    return np.int64 if arrays[0].shape[-1] * (2 * most) ** 2 <= MOST else object


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties: the lower) and its slack, rounded down."""
    kind = exact(v, book)
    v, book = v.astype(kind), book.astype(kind)
    code, slack = np.empty(len(v), np.int64), np.empty(len(v))
    for a in range(0, len(v), 1024):
        d = ((v[a : a + 1024, None, :] - book[None]) ** 2).sum(-1)
        rows, own = np.arange(len(d)), d.argmin(1)
        first = d[rows, own].astype(float)
        code[a : a + 1024] = own
        if len(book) == 1:
            slack[a : a + 1024] = np.inf
            continue
        d[rows, own] = d.max(1) + 1 if kind is object else MOST
        slack[a : a + 1024] = np.sqrt(d.min(1).astype(float)) * (1 - SLIP) - np.sqrt(first) * (1 + SLIP)
    return code, slack


def _down(key: np.ndarray) -> np.ndarray:
    """As 32-bit floats, none larger than before."""
    small = key.astype(np.float32)
    return np.where(small > key, np.nextafter(small, np.float32(-np.inf)), small).astype(np.float32)


class Block:
    """Rows of vectors with a heap for each part position and entry; ``moved`` counts what changed entries."""

    def __init__(self, v: np.ndarray, parts: int, entries: int):
        self.v, self.parts, self.entries = v, parts, entries
        self.width = v.shape[1] // parts
        #: heaps[part][entry]: arrays of keys and rows in heap order, or a list of pairs once it was touched
        self.heaps: list[list] = []
        self.moved: dict[tuple[int, int], list] = {}

    def part(self, q: int) -> np.ndarray:
        return self.v[:, q * self.width : (q + 1) * self.width]

    def _count(self, q: int, code: np.ndarray, rows: np.ndarray, sign: int) -> None:
        own = self.part(q)[rows].astype(exact(self.v))
        for e in np.unique(code):
            at = own[code == e]
            n, *sums = self.moved.setdefault((q, int(e)), [0] * (self.width + 1))
            self.moved[q, int(e)] = [n + sign * len(at), *(a + sign * int(b) for a, b in zip(sums, at.sum(0), strict=True))]

    def assign(self, books: np.ndarray) -> None:
        """All parts, compared with all entries; the heaps begin with no drift. Sorted arrays are heaps."""
        for q in range(self.parts):
            code, slack = nearest(self.part(q), books[q])
            key = _down(slack)
            order = np.lexsort((key, code))
            ends = np.searchsorted(code[order], np.arange(self.entries + 1))
            self.heaps.append([(key[order[a:b]], order[a:b]) for a, b in zip(ends, ends[1:], strict=False)])
            self._count(q, code, np.arange(len(code)), 1)

    def settle(self, books: np.ndarray, drift: np.ndarray) -> int:
        """Parts whose bounds the drift has violated, compared again; how many there were."""
        scanned = 0
        for q in range(self.parts):
            heaps, popped, left = self.heaps[q], [], []
            for e in range(self.entries):
                heap = heaps[e]
                if not len(heap[1] if isinstance(heap, tuple) else heap) or (heap[0][0] if isinstance(heap, tuple) else heap[0][0]) > drift[q, e]:
                    continue
                heap = heaps[e] = self._listed(heap)
                while heap and heap[0][0] <= drift[q, e]:
                    popped.append(heapq.heappop(heap)[1])
                    left.append(e)
            if not popped:
                continue
            rows, old = np.array(popped), np.array(left)
            code, slack = nearest(self.part(q)[rows], books[q])
            key = _down(slack + drift[q, code])
            for k, e, r in zip(key.tolist(), code.tolist(), popped, strict=True):
                heap = heaps[e] = self._listed(heaps[e])
                heapq.heappush(heap, (k, r))
            changed = code != old
            self._count(q, old[changed], rows[changed], -1)
            self._count(q, code[changed], rows[changed], 1)
            scanned += len(rows)
        return scanned

    @staticmethod
    def _listed(heap):
        return list(zip(heap[0].tolist(), heap[1].tolist(), strict=True)) if isinstance(heap, tuple) else heap

    def codes(self) -> np.ndarray:
        out = np.zeros((len(self.v), self.parts), np.int64)
        for q, heaps in enumerate(self.heaps):
            for e, heap in enumerate(heaps):
                out[heap[1] if isinstance(heap, tuple) else [r for _, r in heap], q] = e
        return out

    def stored(self) -> dict:
        """Plain values for a row of a table; vectors as small integers as hold them."""
        flat = [h if isinstance(h, tuple) else (np.array([k for k, _ in h], np.float32), np.array([r for _, r in h], np.int64)) for heaps in self.heaps for h in heaps]
        most = max((-int(self.v.min()), int(self.v.max()))) if self.v.size else 0
        width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
        changes = [{"part": q, "entry": e, "n": x[0], "sums": [str(s) for s in x[1:]]} for (q, e), x in self.moved.items() if any(x)]
        return {"bytes": width, "vectors": self.v.astype(f"<i{width}").tobytes(), "keys": np.concatenate([k for k, _ in flat]).astype("<f4").tobytes(), "rows": np.concatenate([r for _, r in flat]).astype("<i4").tobytes(),
                "sizes": np.array([len(r) for _, r in flat], "<i4").tobytes(), "changes": changes}

    @classmethod
    def loaded(cls, x: dict, n: int, parts: int, entries: int) -> Block:
        out = cls(np.frombuffer(x["vectors"], f"<i{x['bytes']}").reshape(n, -1).astype(np.int64), parts, entries)
        ends = np.cumsum(np.frombuffer(x["sizes"], "<i4"))[:-1]
        pairs = list(zip(np.split(np.frombuffer(x["keys"], "<f4"), ends), np.split(np.frombuffer(x["rows"], "<i4").astype(np.int64), ends), strict=True))
        out.heaps = [pairs[q * entries : (q + 1) * entries] for q in range(parts)]
        return out


def steps(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each part position and entry: how far it moved and the longest move of another entry, together, rounded up."""
    kind = exact(old, new)
    d = np.sqrt(((new.astype(kind) - old.astype(kind)) ** 2).sum(-1).astype(float)) * (1 + SLIP)
    order = np.sort(d, axis=1)
    other = np.where(d == order[:, -1:], order[:, -2:-1] if d.shape[1] > 1 else 0.0, order[:, -1:])
    return (d + other) * (1 + SLIP)


def _renewed(books: list, found: list) -> list:
    """Each entry by its parts' floored mean; unused entries stay."""
    out = [[list(e) for e in book] for book in books]
    for q, e, n, sums in found:
        if n:
            out[q][e] = [s // n for s in sums]
    return out


def compress(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list]:
    """(rows, codebooks): id, label, code (hex digits, two a part), error (squared distance of the vector from
    its code) of each row, and the final codebooks as lists by part, entry and position."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    base = whole_numbers(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")), "vector", scale).drop("vector")
    first = [r["_v"] for r in base.orderBy(F.col("id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()]  # one codebook
    rows_type = T.StructType([T.StructField(id_col, base.schema["id"].dataType), T.StructField(label, base.schema["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        return spark.createDataFrame([], rows_type), []
    dims = len(first[0])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    first, width = [v for v in first if len(v) == dims], dims // parts
    books = [[v[q * width : (q + 1) * width] for v in first] for q in range(parts)]
    k = len(first)
    change = T.ArrayType(T.StructType().add("part", "integer").add("entry", "integer").add("n", "long").add("sums", T.ArrayType(T.StringType())))
    kept = T.StructType([T.StructField("ids", T.ArrayType(base.schema["id"].dataType)), T.StructField("labels", T.ArrayType(base.schema["label"].dataType)), *(T.StructField(c, T.BinaryType()) for c in ("vectors", "keys", "rows", "sizes")), T.StructField("bytes", T.IntegerType()), T.StructField("changes", change)])

    def array(books):
        return np.array(books, dtype=object).reshape(parts, k, width)

    def packed(ids, labels, block):
        x = block.stored()
        own = {"ids": pa.array([ids], pa.list_(ids.type)), "labels": pa.array([labels], pa.list_(labels.type))}
        kinds = {"changes": pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])), "bytes": pa.int32()}
        return pa.RecordBatch.from_pydict({c: own[c] if c in own else pa.array([x[c]], kinds.get(c, pa.binary())) for c in kept.names})

    def begin(batches):
        at = array(books)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                v = part.column("_v")
                block = Block(v.flatten().to_numpy().reshape(len(v), dims), parts, k)
                block.assign(at)
                yield packed(part.column("id"), part.column("label"), block)

    def opened(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, labels = row.column("ids").flatten(), row.column("labels").flatten()
                x = {c: row.column(c)[0].as_py() for c in ("vectors", "keys", "rows", "sizes", "bytes")}
                yield ids, labels, Block.loaded(x, len(ids), parts, k)

    blocks = durable(base.where(F.size("_v") == dims).mapInArrow(begin, kept), "codes-0")
    totals: dict[tuple[int, int], list] = {}
    drift = np.zeros((parts, k))
    for turn in range(rounds):
        wide = F.col("c.sums")
        sums = blocks.select(F.explode("changes").alias("c")).groupBy("c.part", "c.entry").agg(F.sum("c.n").alias("n"), *[F.sum(wide[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
        for r in sums.collect():  # one row an entry
            old = totals.get((r.part, r.entry), [0] * (width + 1))
            totals[r.part, r.entry] = [old[0] + r.n, *(old[1 + i] + int(r[f"s{i}"]) for i in range(width))]
        new = _renewed(books, [(q, e, x[0], x[1:]) for (q, e), x in totals.items()])
        drift = (drift + steps(array(books), array(new))) * (1 + SLIP)
        books = new

        def again(batches, books=books, drift=drift):
            for ids, labels, block in opened(batches):
                block.settle(array(books), drift)
                yield packed(ids, labels, block)

        blocks = durable(blocks.drop("changes").mapInArrow(again, kept), f"codes-{turn + 1}")

    def coded(batches):
        at = array(books)
        for ids, labels, block in opened(batches):
            code, kind = block.codes(), exact(block.v, at.reshape(1, -1))
            total = sum(((block.part(q).astype(kind) - at[q].astype(kind)[code[:, q]]) ** 2).sum(-1).astype(object) for q in range(parts))
            error = pa.array([min(int(x), MOST) for x in total], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([r.tobytes().hex() for r in code.astype(np.uint8)]), error], names=rows_type.names)

    return blocks.select("ids", "labels", "vectors", "keys", "rows", "sizes", "bytes").mapInArrow(coded, rows_type), books


def with_label_errors(rows: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """``rows``, a table that can be read twice, with label_error: the error summed over equal labels, nulls together."""
    key = [F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_label"), F.col(label).isNull().alias("_none")]
    sums = rows.groupBy(*key).agg(F.least(F.sum(F.col(error).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    return join_small(rows.select("*", *key), durable(sums, "codes-labels"), ["_label", "_none"]).drop("_label", "_none")


def codebooks_sha256(books: list) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
