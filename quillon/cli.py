"""Command line over a snapshot folder: volumes, index, search, du, dupes, stats, upgrade, serve, monitor, flush, rebuild."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon import http
from quillon.functions import paths
from quillon.operators.query import QueryError, parse_bytes
from quillon.service import Service
from quillon.sources import journals, snapshots, walk
from quillon.streaming import journal, pending
from quillon.streaming.monitor import Monitor, request


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("--db", required=True, help="folder of snapshots")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("index", help="read volumes into a new snapshot")
    x.add_argument("root", nargs="*", help="a directory tree to walk, or LETTER=tree")
    x.add_argument("--records", action="append", default=[], help="LETTER=table of entries read from file records (Parquet)")
    x.add_argument("--journal", action="append", default=[], help="LETTER=table of entries enumerated by a journal (Parquet)")
    x.add_argument("--volumes", default="", help="letters, comma-separated; all if empty")
    x.add_argument("--method", default="auto", choices=["auto", "mft", "usn", "walk"])
    x.add_argument("--force-degrade", action="store_true")
    x = sub.add_parser("search")
    x.add_argument("query")
    x.add_argument("--limit", type=int, default=100)
    x.add_argument("--sort")
    x.add_argument("--desc", action="store_true")
    x.add_argument("--count-only", action="store_true")
    x = sub.add_parser("du")
    x.add_argument("path")
    x.add_argument("--depth", type=int)
    x.add_argument("--top", type=int, default=20)
    x.add_argument("--allocated", action="store_true")
    x = sub.add_parser("dupes")
    x.add_argument("root", nargs="?", default="", help="only below this folder; a URL of a store is read through Spark, as whole values")
    x.add_argument("--mount", action="append", default=[], help="LETTER=folder where executors find the volume")
    x.add_argument("--min-size", default="1kb")
    x.add_argument("--name")
    x.add_argument("--limit", type=int, default=50)
    x = sub.add_parser("serve", help="answer over HTTP until stopped")
    x.add_argument("--addr", default="127.0.0.1:19876")
    x.add_argument("--no-warm", action="store_true")
    x.add_argument("--no-watch", action="store_true")
    x = sub.add_parser("monitor", help="fold a folder of journal events into the snapshot until stopped")
    x.add_argument("events", nargs="?", help="where Parquet files of events arrive")
    x.add_argument("--journals", help="a folder of journals to follow instead, one a volume; gaps are healed")
    x.add_argument("--checkpoint", required=True)
    x.add_argument("--volume", default="", help="letters: a stream each; one stream of all if empty")
    x.add_argument("--mount", action="append", default=[], help="LETTER=folder where executors find the volume")
    x.add_argument("--interval-secs", type=float, default=5)
    x.add_argument("--flush-secs", type=float, default=60)
    x.add_argument("--once", action="store_true", help="take what is there and end")
    for name in ("volumes", "stats", "upgrade", "flush", "rebuild"):
        x = sub.add_parser(name)
        if name in ("flush", "rebuild"):
            x.add_argument("--running", action="store_true", help="leave it to the monitor that runs")
            x.add_argument("--mount", action="append", default=[])
    return p


def _pairs(items: list[str]) -> dict[str, str]:
    return {k.strip().rstrip(":").upper(): v for k, _, v in (x.partition("=") for x in items)}


def _walked(spark: SparkSession, drive: str, root: str) -> walk.Part:
    """A mounted volume by its tree, paths under its letter; without a letter paths stay."""
    entries, skipped = walk.tree(spark, root)
    if len(drive) == 1:
        below = F.translate(F.substring("path", len(root.rstrip("/")) + 1, 1 << 30), "/", "\\")
        entries = entries.withColumn("path", F.concat(F.lit(f"{drive}:"), below))
    return walk.Part(drive, "walk", entries, skipped)


def _parts(spark: SparkSession, a: argparse.Namespace) -> list[walk.Part]:
    out = [walk.Part(k, m, spark.read.parquet(v)) for m, given in (("mft", a.records), ("usn", a.journal)) for k, v in _pairs(given).items()]
    for text in a.root:
        drive, mark, root = text.partition("=")
        out.append(_walked(spark, drive.upper(), root) if mark else _walked(spark, text, text))
    return out


def _monitor(spark: SparkSession, a: argparse.Namespace, flush_secs: float = 60.0) -> Monitor:
    mounts = _pairs(a.mount)

    def rescan(letters: list[str]):
        return walk.union_of_volumes([_walked(spark, d, mounts[d]).entries for d in letters])

    return Monitor(spark, a.db, lambda wanted: walk.probe(wanted, mounts), flush_secs, rescan)


def _watch(spark: SparkSession, a: argparse.Namespace) -> dict:
    if not a.events and not a.journals:
        raise ValueError("monitor: events or --journals")
    m = _monitor(spark, a, a.flush_secs)
    if a.journals:
        m.watch(a.journals, walk.drives(a.volume) or [r.drive for r in journals.bounds(spark, a.journals).collect()], a.checkpoint, f"{a.interval_secs} seconds")
    else:
        events = spark.readStream.schema(journal.EVENT).parquet(a.events)
        every = {d: events.where(F.upper("drive") == d) for d in walk.drives(a.volume)}
        how = {"available_now": a.once, "interval": f"{a.interval_secs} seconds"}
        if every:
            m.start_volumes(every, a.checkpoint, **how)
        else:
            m.start(events, a.checkpoint, **how)
    if a.once:
        for query, _ in m.streams.values():
            if a.journals:
                query.processAllAvailable()
                query.stop()
            else:
                query.awaitTermination()
    else:
        try:
            while True:
                time.sleep(a.interval_secs)
                m.tick()
        except KeyboardInterrupt:
            for query, _ in m.streams.values():
                query.stop()
    return {"ok": not m.down} | m.status()


def _serve(spark: SparkSession, a: argparse.Namespace) -> dict:
    s = Service(spark, a.db, watch=not a.no_watch)
    if not a.no_warm:
        s.warm()
    host, _, port = a.addr.rpartition(":")
    with http.server(s, host, int(port), rescan=lambda: None, rebuild=lambda: request(spark, a.db, "rebuild")) as server:
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
    return s.health()


def _volumes(spark: SparkSession, db: str) -> dict:
    by = snapshots.load(spark, db).groupBy(paths.drive_of("path").alias("drive"))
    rows = by.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"), F.sum("size").alias("bytes")).where(F.length("drive") == 1).orderBy("drive").collect()
    at = pending.read(spark, db)["positions"]
    return {"ok": True, "volumes": [r.asDict() | {"position": at.get(r.drive)} for r in rows]}


def answer(spark: SparkSession, a: argparse.Namespace) -> dict:
    if a.command == "index":
        entries, report = walk.build(_parts(spark, a), a.volumes, a.method)
        version = snapshots.save(entries, a.db, report.method, report.volumes, report.skipped, a.force_degrade)
        if report.max_usn:
            snapshots.write_positions(spark, a.db, report.max_usn)
        return {"ok": True, "version": version} | (snapshots.read_meta(spark, a.db) or {})
    if a.command == "volumes":
        return _volumes(spark, a.db)
    if a.command == "serve":
        return _serve(spark, a)
    if a.command == "monitor":
        return _watch(spark, a)
    if a.command in ("flush", "rebuild"):
        if a.running:
            request(spark, a.db, a.command)
            return {"ok": True, "requested": a.command}
        m = _monitor(spark, a)
        return {"ok": True, "version": m.flush() if a.command == "flush" else m.rebuild(sorted(_pairs(a.mount)))}
    if a.command == "upgrade":
        return {"ok": True, "rewritten": snapshots.upgrade(spark, a.db)}
    s = Service(spark, a.db)
    if a.command == "search":
        out = s.search(a.query, 0 if a.count_only else a.limit, a.sort, "1" if a.desc else None)
        return {k: out[k] for k in ("ok", "total")} if a.count_only and out["ok"] else out
    if a.command == "du":
        return s.du(a.path, a.depth, a.top, a.allocated)
    if a.command == "dupes":
        if "://" not in a.root:
            return s.staged_dupes(a.root, _pairs(a.mount), parse_bytes(a.min_size), a.name, a.limit)
        contents = walk.contents(spark, a.root)
        return s.dupes(contents.withColumn("path", _local(contents["path"])), parse_bytes(a.min_size), a.name, a.limit)
    return s.stats()


def _local(path):
    return F.regexp_replace(path, "^file:/+", "/")


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillon").getOrCreate()
    try:
        out = answer(spark, a)
    except (QueryError, snapshots.DegradeError, FileNotFoundError, ValueError) as e:
        out = {"ok": False, "error": str(e)}
    if a.json or "hits" not in out:
        print(json.dumps(out, ensure_ascii=False))
    else:
        print("\n".join(h["path"] for h in out["hits"]))
    return 0 if out["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
