"""Changes that wait beside a snapshot, and how far the journals were read.

``monitor.json`` names everything at once and is replaced in one step: the version the changes
belong to, a folder of changes per stream, positions and batch numbers. So a batch is taken in
whole or not at all, and is known when it is run again. Changes of another version than the
current one count as folded in.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.operators.overlay import Overlay, merged
from quillon.sources import snapshots

WAITING = "drive string, frn long, old string"
#: Seconds for which folders that nothing names are left to readers.
KEEP = 600
EMPTY = {"pending": {}, "waiting": {}, "positions": {}, "floors": {}, "journals": {}, "batches": {}, "sizes": {}, "counters": {}, "flushed": None, "left": []}


def read(spark: SparkSession, root: str) -> dict:
    s = snapshots.read_json(spark, f"{root}/monitor.json")
    s = EMPTY | (s if s is not None else {"positions": snapshots.read_positions(spark, root)})
    version = snapshots.read_text(spark, f"{root}/current")
    return s if s.get("base") == version else s | {"base": version, "pending": {}}


def write(spark: SparkSession, root: str, s: dict, before: dict | None = None) -> None:
    """Replace the state; folders that ``before`` named and ``s`` does not go after KEEP seconds, and not while
    the manifest of the version lists files in them."""
    names = lambda x: {x.get("base"), *x["pending"].values(), *x["waiting"].values()}
    now = time.time()
    left = s["left"] + [[n, now] for n in sorted(names(before) - names(s) - {None})] if before else s["left"]
    over = [n for n, at in left if now - at > KEEP and n not in names(s)]
    used = snapshots.folders(spark, root, s.get("base")) if over else set()
    over = [n for n in over if n not in used]
    snapshots.write_text(spark, f"{root}/monitor.json", json.dumps(s | {"left": [x for x in left if x[0] not in over]}))
    for n in over:
        snapshots.delete(spark, f"{root}/{n}")
        snapshots.delete(spark, f"{root}/{n}.manifest")


def save(overlay: Overlay, waiting: DataFrame, root: str) -> tuple[str, dict[str, int]]:
    """Write one stream's changes and half renames; the name of their folder and the rows of each part, observed on the way."""
    name, sizes = f"pending_{uuid.uuid4().hex}", {}
    for part, df in (("removed", overlay.removed), ("delta", overlay.delta), ("waiting", waiting.select("drive", "frn", "old"))):
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{root}/{name}/{part}")
        sizes[part] = seen.get["n"]
    return name, sizes


def sizes(spark: SparkSession, root: str, s: dict) -> dict[str, int]:
    """Rows removed and changed of all streams (which share no volume), as stored with the state; a state
    of before they were stored is counted."""
    parts = ("removed", "delta")
    if set(s["pending"]) <= set(s["sizes"]):
        return {p: sum(s["sizes"][x][p] for x in s["pending"]) for p in parts}
    changes = every(spark, root, s)
    return {p: getattr(changes, p).count() for p in parts}


def of(spark: SparkSession, root: str, name: str) -> Overlay:
    return Overlay(spark.read.parquet(f"{root}/{name}/removed"), spark.read.parquet(f"{root}/{name}/delta"))


def every(spark: SparkSession, root: str, s: dict) -> Overlay | None:
    """The changes of all streams together; None if there are none."""
    parts = [of(spark, root, n) for n in s["pending"].values()]
    return merged(parts) if parts else None


def half_renames(spark: SparkSession, root: str, s: dict, stream: str) -> DataFrame:
    if stream not in s["waiting"]:
        return spark.createDataFrame([], WAITING)
    return spark.read.schema(WAITING).parquet(f"{root}/{s['waiting'][stream]}/waiting")
