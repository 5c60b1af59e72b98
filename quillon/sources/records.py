"""Binary records of NTFS volumes, decoded in batches by tasks: file records and journal records."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.scratch import durable

FRN_MASK = 0xFFFFFFFFFFFF
#: Attribute types (fixed values).
STANDARD, LIST, FILE_NAME, DATA, END = 0x10, 0x20, 0x30, 0x80, 0xFFFFFFFF
#: Bytes of an attribute list beyond which it counts as corrupt (fixed value).
MOST_LIST = 64 << 20
#: A task holds so many decoded rows at a time, however many a batch of its input has.
HELD_ROWS = 10_000
EPOCH = 11_644_473_600
JOURNAL = "frn long, parent_frn long, name string, is_dir boolean, usn long, reason long"
FILES = "frn long, parent_frn long, name string, is_dir boolean, size long, allocated long, mtime long, ctime long, flags int, base_frn long"


def journal_records(data: bytes) -> Iterator[tuple]:
    """Records of versions 2 and 3 of a journal buffer without its leading position.

    Other versions are skipped; a record that is cut off ends the buffer.
    """
    at = 0
    while at + 8 <= len(data):
        length, major = struct.unpack_from("<IH", data, at)
        ids = {2: 8, 3: 16}.get(major)
        fixed = 44 + 2 * (ids or 8)
        if length < 8 or at + length > len(data):
            return
        if ids and length >= fixed:
            frn, parent = (struct.unpack_from("<Q", data, at + 8 + k * ids)[0] & FRN_MASK for k in (0, 1))
            rest = at + 8 + 2 * ids
            usn, _, reason, _, _, attributes, n, offset = struct.unpack_from("<qqIIIIHH", data, rest)
            if offset + n > length:
                return
            name = data[at + offset : at + offset + n].decode("utf-16-le", "replace")
            yield frn, parent, name, bool(attributes & 0x10), usn, reason
        at += length


_EVENT = pa.schema([("frn", pa.int64()), ("parent_frn", pa.int64()), ("name", pa.string()), ("is_dir", pa.bool_()), ("usn", pa.int64()), ("reason", pa.int64())])
_LISTED = pa.schema([(c, pa.int64()) for c in ("frn", "kind", "vcn", "owner")])


def _in_pieces(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of HELD_ROWS, each made as it is asked for."""
    rows = iter(rows)
    while some := list(islice(rows, HELD_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def _events(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_pieces((r for batch in batches for b in batch.column(0) if b.is_valid for r in journal_records(b.as_py())), _EVENT)


def decode_journal(buffers: DataFrame, column: str = "data", mask: int | None = None) -> DataFrame:
    """Events of a table of binary buffers; those whose reason misses ``mask`` are left out."""
    out = buffers.select(column).mapInArrow(_events, JOURNAL)
    return out if mask is None else out.where(F.col("reason").bitwiseAND(mask) != 0)


def fixed_up(record: bytes, sector: int = 512) -> bytes | None:
    """Restore the last two bytes of each sector; None if the record is torn."""
    at, n = struct.unpack_from("<HH", record, 4)
    out, mark = bytearray(record), record[at : at + 2]
    for k in range(1, n):
        end = k * sector
        if end > len(out) or out[end - 2 : end] != mark:
            return None
        out[end - 2 : end] = record[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


def attributes(record: bytes) -> Iterator[tuple[int, int, int]]:
    """(type, offset, length) of each attribute."""
    at = struct.unpack_from("<H", record, 20)[0]
    while at + 8 <= len(record):
        kind, length = struct.unpack_from("<II", record, at)
        if kind == END or length < 16 or at + length > len(record):
            return
        yield kind, at, length
        at += length


def run_list(data: bytes) -> list[tuple[int | None, int]]:
    """(first cluster or None for a hole, clusters) of a mapping; places are relative to the one before."""
    out, at, cluster = [], 0, 0
    while at < len(data) and data[at]:
        n_len, n_off = data[at] & 15, data[at] >> 4
        if not n_len or at + 1 + n_len + n_off > len(data):
            break
        length = int.from_bytes(data[at + 1 : at + 1 + n_len], "little")
        move = int.from_bytes(data[at + 1 + n_len : at + 1 + n_len + n_off], "little", signed=True)
        cluster += move
        out.append((cluster if n_off else None, length))
        at += 1 + n_len + n_off
    return out


def _unix(t: int) -> int:
    return max(t // 10_000_000 - EPOCH, 0)


def held(record: bytes, number: int, sector: int = 512, cluster: int = 4096) -> dict | None:
    """What a record in use holds itself, fields of :data:`HELD`; None for torn, free or foreign ones.

    Short alias names are left out. Sizes come from the unnamed stream's first extent. What the record does not hold
    is None. ``clusters`` are those of an attribute list that lies outside, in order; one with holes, too long or
    longer than its clusters is left out.
    """
    if len(record) < 48 or record[:4] != b"FILE":
        return None
    fixed = fixed_up(record, sector)
    if fixed is None:
        return None
    use = struct.unpack_from("<H", fixed, 22)[0]
    if not use & 1:
        return None
    base = struct.unpack_from("<Q", fixed, 32)[0] & FRN_MASK
    out = dict.fromkeys(("size", "allocated", "mtime", "ctime", "flags", "list", "list_bytes", "clusters"))
    out |= {"frn": number, "base_frn": base or None, "is_dir": bool(use & 2), "names": []}
    for kind, at, length in attributes(fixed):
        away, n_name = fixed[at + 8], fixed[at + 9]
        if kind == DATA and not n_name:
            if not away:
                out["size"], out["allocated"] = struct.unpack_from("<I", fixed, at + 16)[0], 0
            elif length >= 64 and struct.unpack_from("<Q", fixed, at + 16)[0] == 0:
                out["allocated"], out["size"] = struct.unpack_from("<QQ", fixed, at + 40)
                if struct.unpack_from("<H", fixed, at + 12)[0] & 0x8001 and length >= 72:
                    out["allocated"] = struct.unpack_from("<Q", fixed, at + 64)[0]  # compressed or sparse: clusters in use
        elif kind == LIST and away and length >= 64:
            n = struct.unpack_from("<Q", fixed, at + 48)[0]
            if 0 < n <= MOST_LIST:
                places = [None if c is None else c + k for c, m in run_list(fixed[at + struct.unpack_from("<H", fixed, at + 32)[0] : at + length]) for k in range(min(m, MOST_LIST // cluster))]
                need = -(-n // cluster)
                if len(places) >= need and None not in places[:need]:
                    out["list_bytes"], out["clusters"] = n, places[:need]
        elif kind in (STANDARD, LIST, FILE_NAME) and not away and length >= 24:
            n, offset = struct.unpack_from("<IH", fixed, at + 16)
            value = fixed[at + offset : at + min(offset + n, length)]
            if kind == STANDARD and len(value) >= 36:
                out["ctime"], out["mtime"] = (_unix(t) for t in struct.unpack_from("<QQ", value, 0))
                bits = struct.unpack_from("<I", value, 32)[0]
                out["flags"] = (bits & 2) // 2 | (bits & 4) // 2 | (bits & 1) << 2 | (bits & 0x400) >> 7
            elif kind == LIST:
                out["list"], out["list_bytes"] = value, len(value)
            elif kind == FILE_NAME and len(value) >= 66 and value[65] != 2:
                out["names"].append({"parent_frn": struct.unpack_from("<Q", value, 0)[0] & FRN_MASK, "name": value[66 : 66 + 2 * value[64]].decode("utf-16-le", "replace")})
    return out


HELD = ("frn long, base_frn long, is_dir boolean, size long, allocated long, mtime long, ctime long, flags int, names array<struct<parent_frn: long, name: string>>, "
        "list binary, list_bytes long, clusters array<long>")


def decode_held(records: DataFrame, number: str = "number", data: str = "data", cluster: int = 4096) -> DataFrame:
    """One row (:data:`HELD`) per record in use of a table of numbered binary file records."""
    names = ["frn", "base_frn", "is_dir", "size", "allocated", "mtime", "ctime", "flags", "names", "list", "list_bytes", "clusters"]

    def run(batches):
        for pdf in batches:
            found = (held(bytes(b), int(n), cluster=cluster) for n, b in zip(pdf[number], pdf[data], strict=True) if b is not None)
            out = pd.DataFrame([r for r in found if r], columns=names)
            yield out.astype({c: "Int64" for c in ("frn", "base_frn", "size", "allocated", "mtime", "ctime", "flags", "list_bytes")})

    return records.select(number, data).mapInPandas(run, HELD)


def list_entries(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(type, first cluster in the stream, record that holds it) of an attribute list's unnamed attributes;
    an entry that is cut off ends the list."""
    at = 0
    while at + 26 <= len(data):
        kind, length, n_name = struct.unpack_from("<IHB", data, at)
        if length < 26 or at + length > len(data):
            return
        if not n_name:
            vcn, owner = struct.unpack_from("<QQ", data, at + 8)
            if vcn < 1 << 63:
                yield kind, vcn, owner & FRN_MASK
        at += length


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
    return _in_pieces(((row["frn"], *e) for row in rows for e in list_entries(b"".join(x["part"] for x in row["parts"])[: row["list_bytes"]])), _LISTED)


def decode_lists(found: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """(frn, kind, vcn, owner) of the attribute lists of :func:`decode_held`.

    Lists outside their record are put together from ``clusters`` (cluster, data), by a join on the
    clusters they name; a list of which a cluster is missing has no rows. One list is at most
    ``MOST_LIST`` bytes, so its parts fit a row.
    """
    parts = found.where("list IS NOT NULL").select("frn", "list_bytes", F.array(F.struct(F.lit(0).alias("at"), F.col("list").alias("part"))).alias("parts"))
    if clusters is not None:
        asked = found.where("clusters IS NOT NULL").select("frn", "list_bytes", F.posexplode("clusters").alias("at", "cluster"))
        got = asked.join(clusters.groupBy("cluster").agg(F.first("data").alias("part")), "cluster", "left").groupBy("frn", "list_bytes")
        whole = got.agg(F.count_if(F.col("part").isNull()).alias("missing"), F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
        parts = parts.union(whole.where("missing = 0").select("frn", "list_bytes", "parts"))

    return parts.select("frn", "list_bytes", "parts").mapInArrow(_listed, "frn long, kind long, vcn long, owner long")


def entries(records: DataFrame, clusters: DataFrame | None = None, cluster: int = 4096) -> DataFrame:
    """(frn, parent_frn, name, is_dir, size, allocated, mtime, ctime, flags), a row per name of a file, out of
    numbered binary records (number, data) and, for lists outside their records, ``clusters`` (cluster, data).

    Names may lie in any record of a file, its base one or one that continues it. Size, times and flags are those of the base
    record; what that does not hold comes from the record in which its attribute list places the stream's begin
    or the times, if that continues this file. What neither holds is 0, as sizes of directories are.
    Names whose base record is not in use have no row; a name found twice has one.
    """
    found = durable(decode_held(records, cluster=cluster), "file-records")
    owner = found.where("base_frn IS NOT NULL").select(F.col("frn").alias("owner"), F.col("base_frn").alias("frn"), "size", "allocated", "mtime", "ctime", "flags")
    spilled = found.where("base_frn IS NULL AND (size IS NULL OR mtime IS NULL)")
    told = decode_lists(spilled, clusters).where(F.col("kind").isin(DATA, STANDARD) & (F.col("vcn") == 0)).join(owner, ["frn", "owner"])
    pick = lambda c, kind: F.min_by(F.when(F.col("kind") == kind, F.col(c)), F.when((F.col("kind") == kind) & F.col(c).isNotNull(), F.col("owner"))).alias(f"_{c}")
    of = {"size": DATA, "allocated": DATA, "mtime": STANDARD, "ctime": STANDARD, "flags": STANDARD}
    told = told.groupBy("frn").agg(*[pick(c, kind) for c, kind in of.items()])
    value = lambda c: F.when(F.col("is_dir") & F.lit(c in ("size", "allocated")), 0).otherwise(F.coalesce(c, f"_{c}", F.lit(0))).alias(c)
    base = found.where("base_frn IS NULL").join(told, "frn", "left").select("frn", "is_dir", *[value(c) for c in of])
    names = found.select(F.coalesce("base_frn", "frn").alias("frn"), F.explode("names").alias("n")).select("frn", "n.*").distinct()
    return names.join(base, "frn").select("frn", "parent_frn", "name", "is_dir", *of)


def file_rows(record: bytes, number: int, sector: int = 512) -> list[tuple]:
    """One row per name of a record in use (:func:`held`), 0 for what it does not hold; a record without a
    name that continues another has one row. base_frn is the record it continues."""
    r = held(record, number, sector)
    if r is None:
        return []
    size, allocated = (0, 0) if r["is_dir"] else (r["size"] or 0, r["allocated"] or 0)
    rest = (r["is_dir"], size, allocated, r["mtime"] or 0, r["ctime"] or 0, r["flags"] or 0, r["base_frn"])
    rows = [(number, n["parent_frn"], n["name"], *rest) for n in r["names"]]
    return rows or ([(number, None, None, *rest)] if r["base_frn"] else [])


def decode_files(records: DataFrame, number: str = "number", data: str = "data") -> DataFrame:
    """Rows of a table of numbered binary file records."""
    names = [f.split()[0] for f in FILES.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [r for n, b in zip(pdf[number], pdf[data], strict=True) if b is not None for r in file_rows(bytes(b), int(n))]
            yield pd.DataFrame(rows, columns=names).astype({"parent_frn": "Int64", "base_frn": "Int64"})

    return records.select(number, data).mapInPandas(run, FILES)


def decode_enumeration(buffers: DataFrame, column: str = "data") -> DataFrame:
    """Records of enumeration buffers, which begin with the position to go on from; short buffers have none."""
    return decode_journal(buffers.where(F.length(column) > 8).select(F.expr(f"substring({column}, 9)").alias("data")))
