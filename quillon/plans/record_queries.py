"""Binary records of volumes over the given tables, with SQL.

Suppliers are files in the folders of their nations. Their records are packed into the layout of a volume: every
third one keeps its data, and every fifth its times, in a record that continues it and that an attribute list names;
every second list lies outside its record, in a cluster. Events are records of journal buffers. Every query decodes
what was packed, so its work grows with the tables.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import tree
from quillon.sources import records, walk
from quillon.sources.records import DATA, END, EPOCH, FILE_NAME, LIST, STANDARD

#: First record numbers of folders and files, and of the records that continue files; bytes of a record.
DIR, FILE, MORE, RECORD = 1000, 100_000, 1 << 40, 1024
TICKS = 10_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _inside(kind: int, value: bytes) -> bytes:
    length = (24 + len(value) + 7) // 8 * 8
    return (struct.pack("<IIBBHHHIHH", kind, length, 0, 0, 24, 0, 0, len(value), 24, 0) + value).ljust(length, b"\0")


def _outside(kind: int, size: int, allocated: int, runs: bytes) -> bytes:
    length = (64 + len(runs) + 8) // 8 * 8
    head = struct.pack("<IIBBHHH", kind, length, 1, 0, 64, 0, 0) + struct.pack("<QQHHIQQQ", 0, 0, 64, 0, 0, allocated, size, size)
    return (head + runs).ljust(length, b"\0")


def _record(parts: list[bytes], base: int = 0) -> bytes:
    """A file record with its sector marks."""
    head = bytearray(56)
    head[:4] = b"FILE"
    struct.pack_into("<HH", head, 4, 48, 1 + RECORD // 512)
    struct.pack_into("<HH", head, 20, 56, 1)
    struct.pack_into("<Q", head, 32, base)
    out = bytearray((bytes(head) + b"".join(parts) + struct.pack("<I", END)).ljust(RECORD, b"\0"))
    out[48:50] = b"\x01\x00"
    for k in range(1, 1 + RECORD // 512):
        out[48 + 2 * k : 50 + 2 * k], out[512 * k - 2 : 512 * k] = out[512 * k - 2 : 512 * k], b"\x01\x00"
    return bytes(out)


def _file(s: int, nation: int) -> list[tuple[str, int, bytes]]:
    """(table, number, data) of one supplier: its records, and the cluster of its list."""
    name, number, more = f"s{s}", FILE + s, MORE + s
    times = _inside(STANDARD, struct.pack("<QQQQI", *((EPOCH + t) * TICKS for t in (s, 2 * s, 0, 0)), s % 8) + b"\0" * 12)
    data = _outside(DATA, 7 * s, 8 * s, b"")
    label = _inside(FILE_NAME, struct.pack("<Q", DIR + nation) + b"\0" * 56 + bytes([len(name), 1]) + name.encode("utf-16-le"))
    away = ([(STANDARD, times)] if s % 5 == 0 else []) + ([(DATA, data)] if s % 3 == 0 else [])
    here = [x for k, x in ((0, times), (1, label), (2, data)) if k == 1 or (k == 0 and s % 5) or (k == 2 and s % 3)]
    if not away:
        return [("record", number, _record(here))]
    entries = b"".join(struct.pack("<IHBBQQHHI", kind, 32, 0, 26, 0, (1 << 48) | more, 0, 0, 0) for kind, _ in away)
    out = [("record", more, _record([x for _, x in away], (1 << 48) | number))]
    if s % 2:
        return [*out, ("record", number, _record([_inside(LIST, entries), *here]))]
    run = b"\x41\x01" + struct.pack("<i", s) + b"\0"
    return [*out, ("cluster", s, entries), ("record", number, _record([_outside(LIST, len(entries), 4096, run), *here]))]


def volume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The records and the clusters of a volume that holds the suppliers."""
    def pack(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([r for s, n in zip(pdf["s_suppkey"], pdf["s_nationkey"], strict=True) for r in _file(int(s), int(n))], columns=["table", "number", "data"])

    packed = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").where("s_suppkey IS NOT NULL AND s_nationkey IS NOT NULL").mapInPandas(pack, "table string, number long, data binary")
    return packed.where("table = 'record'").drop("table"), packed.where("table = 'cluster'").select(F.col("number").alias("cluster"), "data")


def record_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, sizes and times out of the records and their lists."""
    return records.entries(*volume(spark, sf_dir))


def record_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the paths of their folders."""
    folders = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + DIR).cast("long").alias("frn"), F.lit(tree.ROOT).cast("long").alias("parent_frn"), F.col("n_name").alias("name"), F.lit(True).alias("is_dir"), *[F.lit(0).cast("long").alias(c) for c in ("size", "allocated", "mtime", "ctime")], F.lit(0).alias("flags"))
    built = tree.build(folders.unionByName(records.entries(*volume(spark, sf_dir))))
    return built.select("path", "size", "mtime")


def _journal(frn: int, parent: int, name: str, usn: int, reason: int, is_dir: bool, major: int) -> bytes:
    raw, ids = name.encode("utf-16-le"), 8 if major == 2 else 16
    head = 44 + 2 * ids
    length = (head + len(raw) + 7) // 8 * 8
    body = struct.pack("<IHH", length, major, 0) + frn.to_bytes(ids, "little") + parent.to_bytes(ids, "little") + struct.pack("<qqIIIIHH", usn, 0, reason, 0, 0, 16 * is_dir, len(raw), head)
    return (body + raw).ljust(length, b"\0")


def _buffers(rows: DataFrame, position: bool = False) -> DataFrame:
    """Buffers (data) of rows (frn, parent_frn, name, usn, reason, is_dir), records of both versions in turn."""
    def pack(batches):
        import pandas as pd

        for pdf in batches:
            some = [_journal(int(r.frn), int(r.parent_frn), r.name, int(r.usn), int(r.reason), bool(r.is_dir), 2 + int(r.frn) % 2) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"data": [(b"\x01" + b"\0" * 7 if position else b"") + b"".join(some[k : k + 500]) for k in range(0, len(some), 500)]})

    return rows.select("frn", "parent_frn", "name", "usn", "reason", "is_dir").mapInPandas(pack, "data binary")


def journal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events out of journal buffers, those of two kinds of reasons."""
    e = _table(spark, sf_dir, "events").where("event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL")
    k = F.col("event_id")
    rows = e.select((k + DIR).alias("frn"), F.col("user_id").alias("parent_frn"), F.concat("event_type", F.lit("é"), k.cast("string")).alias("name"), (k * 80).alias("usn"), F.pow(F.lit(2), k % 8).cast("long").alias("reason"), (k % 4 == 0).alias("is_dir"))
    return records.decode_journal(_buffers(rows), mask=0x22)


def _enumerated(spark: SparkSession, sf_dir: str) -> walk.Part:
    n = _table(spark, sf_dir, "nation").select((F.col("n_nationkey") + DIR).cast("long").alias("frn"), F.lit(tree.ROOT).cast("long").alias("parent_frn"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("usn"), F.lit(0).cast("long").alias("reason"), F.lit(True).alias("is_dir"))
    s = F.col("s_suppkey")
    # every eleventh lies in a folder that is not there
    parent = F.when(s % 11 == 0, 7).otherwise(F.col("s_nationkey") + DIR).cast("long")
    files = _table(spark, sf_dir, "supplier").select((s + FILE).alias("frn"), parent.alias("parent_frn"), F.concat(F.lit("s"), s.cast("string")).alias("name"), (s * 3).alias("usn"), F.lit(0).cast("long").alias("reason"), F.lit(False).alias("is_dir"))
    return walk.enumerated("D", _buffers(n.union(files), True))


def enumeration_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of a volume out of enumeration buffers."""
    return _enumerated(spark, sf_dir).entries.select("path", "is_dir", "frn")


def enumeration_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was counted on the way: entries, records without a path, and the greatest usn."""
    part = _enumerated(spark, sf_dir)
    return part.entries.agg(F.count("*").alias("entries")).withColumns({"skipped": F.lit(part.skipped).cast("long"), "max_usn": F.lit(part.max_usn).cast("long")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"record_entries": record_entries, "record_paths": record_paths, "journal_decode": journal_decode, "enumeration_paths": enumeration_paths, "enumeration_totals": enumeration_totals}


def oracle_sql() -> dict[str, str]:
    return {
        "record_entries": f"""SELECT s_suppkey + {FILE} AS frn, CAST(s_nationkey + {DIR} AS BIGINT) AS parent_frn, 's' || s_suppkey AS name, false AS is_dir, 7 * s_suppkey AS size, 8 * s_suppkey AS allocated,
            2 * s_suppkey AS mtime, s_suppkey AS ctime, CAST((s_suppkey % 8 & 2) // 2 | (s_suppkey % 8 & 4) // 2 | (s_suppkey % 8 & 1) * 4 AS INT) AS flags FROM supplier""",
        "record_paths": r"""SELECT 'D:\' || n_name || '\s' || s_suppkey AS path, 7 * s_suppkey AS size, 2 * s_suppkey AS mtime FROM supplier JOIN nation ON n_nationkey = s_nationkey
            UNION ALL SELECT 'D:\' || n_name, 0, 0 FROM nation""",
        "journal_decode": f"""SELECT event_id + {DIR} AS frn, user_id AS parent_frn, event_type || 'é' || event_id AS name, event_id % 4 = 0 AS is_dir, event_id * 80 AS usn, CAST(2 ** (event_id % 8) AS BIGINT) AS reason
            FROM events WHERE event_id % 8 IN (1, 5)""",
        "enumeration_paths": rf"""SELECT 'D:\' || n_name || '\s' || s_suppkey AS path, false AS is_dir, s_suppkey + {FILE} AS frn FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 11 <> 0
            UNION ALL SELECT 'D:\' || n_name, true, n_nationkey + {DIR} FROM nation""",
        "enumeration_totals": """SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 11 <> 0) + (SELECT count(*) FROM nation) AS entries, (SELECT count(*) FROM supplier WHERE s_suppkey % 11 = 0) AS skipped,
            CAST(greatest((SELECT max(s_suppkey) * 3 FROM supplier), (SELECT max(n_nationkey) FROM nation)) AS BIGINT) AS max_usn""",
    }
