"""Catalogues of directory trees and volumes."""

from __future__ import annotations

import hashlib
import os
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators import tree as tree_of
from quillon.sources import records
from quillon.sources.catalog import normalise, numbered
from quillon.sources.scratch import durable
from quillon.sources.snapshots import rank


def drives(text: str) -> list[str]:
    """The letters of a comma list, each once: ``c:, D,c`` is C and D."""
    return list(dict.fromkeys(x.strip().rstrip(":\\/").upper() for x in text.split(",") if x.strip(" :\\/")))


def volumes(rows: DataFrame, wanted: str = "") -> DataFrame:
    """volumes(drive, label, fs) of a comma list of letters; all if it is empty."""
    letters = drives(wanted)
    return rows.where(F.upper("drive").isin(letters)) if letters else rows


def files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root`` in any store Spark lists, with size and time; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    rows = found.select(F.col("path"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return normalise(numbered(rows, ["path"]))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")


def tree(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """(entries, skipped) of a local tree: the fallback without journals. Links are not followed,
    the root is left out, and what cannot be read is counted. All listing is done by tasks: one lists up to
    ``FOLDERS`` folders of its branch and hands the rest back, and each round deals what is left anew, so a
    branch of any size becomes many tasks. The tree must be mounted on every executor."""
    top = spark.range(1).select(F.lit(root).alias("path"))
    found, round_ = [], 0
    while True:
        step = durable(top.repartition(_tasks(spark, round_)).mapInPandas(_listed, WALK), "walk")
        found.append(step)
        left = step.where("kind = 'todo'").select("path")
        round_ = left.count()
        if not round_:
            break
        top = left
    every = reduce(DataFrame.union, found)
    skipped = every.where("kind = 'skipped'").count()
    entries = numbered(every.where("kind = 'entry'").drop("kind").withColumn("allocated", F.lit(0)), ["path"])
    return normalise(entries), skipped


WALK = "kind string, path string, is_dir boolean, size long, mtime long, ctime long"
#: Folders that a task lists before it hands the rest of its branch back.
FOLDERS = 2000


def _tasks(spark: SparkSession, n: int) -> int:
    return max(1, min(n, 4 * spark.sparkContext.defaultParallelism))


def _listed(batches):
    """Rows of :data:`WALK`: what the folders of a partition hold, and those that are left to list (todo)."""
    import pandas as pd

    for pdf in batches:
        out, todo, listed = [], list(pdf["path"]), 0
        while todo and listed < FOLDERS:
            folder, listed = todo.pop(), listed + 1
            try:
                with os.scandir(folder) as it:
                    inside = sorted(it, key=lambda e: e.name)
            except OSError:
                out.append(("skipped", folder, True, 0, 0, 0))
                continue
            for e in inside:
                try:
                    s, is_dir = e.stat(follow_symlinks=False), e.is_dir(follow_symlinks=False)
                except OSError:
                    out.append(("skipped", e.path, False, 0, 0, 0))
                    continue
                out.append(("entry", e.path, is_dir, 0 if is_dir else s.st_size, int(s.st_mtime), int(getattr(s, "st_birthtime", s.st_ctime))))
                if is_dir:
                    todo.append(e.path)
        out += [("todo", p, True, 0, 0, 0) for p in todo]
        yield pd.DataFrame(out, columns=["kind", "path", "is_dir", "size", "mtime", "ctime"])


def union_of_volumes(parts: list[DataFrame]) -> DataFrame:
    """One catalogue of several, ids renewed."""
    return normalise(numbered(reduce(DataFrame.unionByName, [normalise(p) for p in parts]), ["path"]))


def method_of(methods: list[str]) -> str:
    return methods[0] if len(set(methods)) == 1 else "mixed"


@dataclass
class Part:
    """What one way of reading a volume found."""

    drive: str
    method: str
    entries: DataFrame
    skipped: int = 0
    max_usn: int | None = None


@dataclass
class Report:
    method: str
    volumes: list[str] = field(default_factory=list)
    files: int = 0
    dirs: int = 0
    skipped: int = 0
    elapsed_ms: int = 0
    max_usn: dict[str, int] = field(default_factory=dict)


def build(parts: list[Part], wanted: str = "", method: str = "auto") -> tuple[DataFrame, Report]:
    """(catalogue, report) of the wanted volumes (empty: all): of several ways to read one, that of
    ``method``, or with ``auto`` the most complete there is. The entries come out numbered anew."""
    began, letters, chosen = time.monotonic(), drives(wanted), {}
    for p in parts:
        drive = p.drive.rstrip(":").upper() if len(p.drive) < 3 else p.drive
        fits = (not letters or drive in letters) and method in ("auto", p.method)
        if fits and (drive not in chosen or rank(p.method) > rank(chosen[drive].method)):
            chosen[drive] = p
    if not chosen:
        raise ValueError(f"no volume of {wanted or 'any letter'} can be read by {method}")
    found = list(chosen.values())
    entries = durable(union_of_volumes([p.entries for p in found]), "built")
    n = entries.agg(F.count("*").alias("all"), F.count_if("is_dir").alias("dirs")).first()
    most = {d: p.max_usn for d, p in chosen.items() if p.max_usn is not None}
    report = Report(method_of([p.method for p in found]), sorted(chosen), n["all"] - n.dirs, n.dirs, sum(p.skipped for p in found), int(1000 * (time.monotonic() - began)), most)
    return entries, report


def enumerated(drive: str, buffers: DataFrame, root: int = tree_of.ROOT) -> Part:
    """A volume out of enumeration buffers (data): names and places only, sizes and times 0.

    The greatest usn, from where a journal is followed afterwards, is observed while the records are written,
    without a second pass; records without a path to the root count as skipped.
    """
    seen = Observation()
    rows = records.decode_enumeration(buffers).observe(seen, F.count("*").alias("records"), F.max("usn").alias("max_usn"))
    rows = durable(rows.select("frn", "parent_frn", "name", "is_dir"), "enumerated")
    return Part(drive, "usn", *_placed(rows, root, drive), seen.get["max_usn"])


def recorded(drive: str, table: DataFrame, clusters: DataFrame | None = None, max_usn: int | None = None, root: int = tree_of.ROOT) -> Part:
    """A volume out of its binary file records (number, data), see :func:`quillon.sources.records.entries`."""
    return Part(drive, "mft", *_placed(durable(records.entries(table, clusters), "recorded"), root, drive), max_usn)


def _placed(rows: DataFrame, root: int, drive: str) -> tuple[DataFrame, int]:
    """(entries, skipped) of records with parents."""
    rows = rows.where(F.col("frn") != root)
    built = durable(tree_of.build(rows, root, drive.rstrip(":").upper() + ":"), "placed")
    skipped = rows.select("frn").distinct().count() - built.select("frn").distinct().count()
    return normalise(numbered(built, ["path"])), skipped


def digests(wanted: DataFrame, first: int | None = None, mounts: dict[str, str] | None = None, block: int = 1 << 20) -> DataFrame:
    """(path, digest) of the files of ``wanted`` (path): SHA-256 of the first ``first`` bytes, or of everything,
    read by blocks, so that files of any size take the memory of one. Digest is null for what cannot be read.
    ``mounts`` as in :func:`probe`."""
    place = _place(mounts)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p in pdf["path"]:
                digest, left = hashlib.sha256(), first
                try:
                    with open(place(p), "rb") as f:
                        while left is None or left > 0:
                            part = f.read(block if left is None else min(block, left))
                            if not part:
                                break
                            digest.update(part)
                            left = None if left is None else left - len(part)
                    out.append((p, digest.hexdigest()))
                except OSError:
                    out.append((p, None))
            yield pd.DataFrame(out, columns=["path", "digest"])

    return wanted.select("path").where("path IS NOT NULL").mapInPandas(run, "path string, digest string")


def _place(mounts: dict[str, str] | None):
    """Where a path lies on executors."""
    at = {k.rstrip(":").upper(): v.rstrip("/") for k, v in (mounts or {}).items()}
    return lambda p: at[p[:1].upper()] + p[2:].replace("\\", "/") if p[1:2] == ":" and p[:1].upper() in at else p


def probe(wanted: DataFrame, mounts: dict[str, str] | None = None) -> DataFrame:
    """The state of the paths of ``wanted`` (path), as :func:`quillon.streaming.journal.apply` reads it:
    those that are there as ok, those that cannot be read as unknown; what is gone has no row.

    ``mounts`` says where a drive's letter is mounted, on every executor. Links report themselves.
    """
    place_of = _place(mounts)

    def look(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p in pdf["path"]:
                place = place_of(p)
                try:
                    s = os.lstat(place)
                except (FileNotFoundError, NotADirectoryError):
                    continue
                except OSError:
                    out.append((p, "unknown", 0, 0, 0, 0, 0))
                    continue
                plain = not os.path.isdir(place) or os.path.islink(place)
                out.append((p, "ok", s.st_size if plain else 0, s.st_blocks * 512 if plain else 0, int(s.st_mtime), int(getattr(s, "st_birthtime", s.st_ctime)), 0))
            yield pd.DataFrame(out, columns=["path", "status", "size", "allocated", "mtime", "ctime", "flags"])

    return wanted.select("path").where("path IS NOT NULL").mapInPandas(look, "path string, status string, size long, allocated long, mtime long, ctime long, flags int")


def on_drives(catalog: DataFrame, drives: list[str]) -> DataFrame:
    return catalog.where(paths.drive_of("path").isin([d.upper().rstrip(":") for d in drives]))
