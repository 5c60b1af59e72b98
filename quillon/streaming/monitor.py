"""Streams of journal events folded into the current snapshot, batch by batch."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators import overlay
from quillon.sources import journals, snapshots
from quillon.sources.catalog import COLUMNS
from quillon.sources.scratch import durable, passing
from quillon.sources.walk import union_of_volumes
from quillon.streaming import journal, pending
from quillon.streaming.progress import Progress

INTERVAL = "5 seconds"
#: Seconds between two folds of the changes, and before a stream that failed starts again.
FLUSH, RETRY = 60.0, 60.0


class Monitor:
    """Keeps a snapshot live. ``state`` gives the file system's table for a table of paths;
    ``rescan`` gives the entries of volumes anew.

    A batch writes only what it changed, beside the snapshot (:mod:`quillon.streaming.pending`);
    readers see both. The changes are folded into a new version (``snapshots.fold``: only files in whose
    range one falls are written anew) after ``flush_secs``, or at once when a side has more than ``overlay.CAP`` rows. A stream per volume may run; one that fails
    stops no other and starts again. Streams share no volume. ``bounds`` gives what the journals hold
    (drive, first, following, and journal, if known); with it, :meth:`tick` heals volumes by itself.
    """

    def __init__(self, spark: SparkSession, root: str, state: Callable[[DataFrame], DataFrame], flush_secs: float = FLUSH, rescan: Callable[[list[str]], DataFrame] | None = None, bounds: Callable[[], DataFrame] | None = None):
        self.spark, self.root, self.state, self.flush_secs, self.rescan, self.bounds = spark, root, state, flush_secs, rescan, bounds
        self.lock = threading.RLock()
        self.streams: dict[str, tuple] = {}
        self.down: dict[str, tuple[float, str]] = {}
        self.progress: Progress | None = None
        #: what went wrong between batches: a request or a healing, and its message
        self.faults: dict[str, str] = {}

    def live(self, s: dict | None = None) -> DataFrame:
        """The snapshot with its pending changes."""
        s = s or pending.read(self.spark, self.root)
        base, changes = snapshots.load(self.spark, self.root, s["base"]), pending.every(self.spark, self.root, s)
        return (overlay.live(base, changes) if changes else base).select(*COLUMNS)

    def apply_batch(self, events: DataFrame, batch: int, stream: str = "all", run: str = "") -> dict[str, int]:
        """Fold one batch in; a batch of the same ``run`` (checkpoint) that was folded in changes nothing. The
        batch's own tables are deleted once its changes are stored."""
        with self.lock, passing(self.spark):
            s, key = pending.read(self.spark, self.root), f"{stream}|{run}"
            if batch <= s["batches"].get(key, -1):
                return {}
            drive = F.upper("drive")
            for d, floor in s["floors"].items():
                events = events.where((drive != d) | (F.col("usn") >= floor))
            events = durable(events, "monitor-events")
            if events.isEmpty():
                return {}
            out = journal.apply(self.live(s), events, self.state, pending.half_renames(self.spark, self.root, s, stream))
            mine = pending.of(self.spark, self.root, s["pending"][stream]) if stream in s["pending"] else None
            name, sizes = pending.save(overlay.then(mine, out.removed, out.delta), out.dir_old, self.root)
            ends = events.groupBy(drive.alias("drive")).agg(F.max("usn").alias("usn"), F.count("*").alias("n")).collect()
            last, more = {r.drive: r.usn for r in ends}, out.stats | {"batches": 1, "events": sum(r.n for r in ends)}
            told = s["counters"].get(stream, {})
            told = {k: told.get(k, 0) + more.get(k, 0) for k in told | more}
            after = s | {"pending": s["pending"] | {stream: name}, "waiting": s["waiting"] | {stream: name}, "positions": s["positions"] | last,
                         "batches": s["batches"] | {key: batch},
                         "sizes": s["sizes"] | {stream: sizes}, "counters": s["counters"] | {stream: told}, "flushed": s["flushed"] or time.time()}
            pending.write(self.spark, self.root, after, s)
            self.flush_if_due()
            return out.stats

    def flush(self) -> str:
        """Write all entries, with the pending changes, as a new version, ids renewed; positions beside it come
        last. Changes that are due are folded into the files they touch alone (:meth:`flush_if_due`)."""
        with self.lock:
            s = pending.read(self.spark, self.root)
            return self._replace(s, self.live(s)) if s["pending"] else self._stamp(s, s)

    def flush_if_due(self) -> bool:
        with self.lock:
            s = pending.read(self.spark, self.root)
            if not s["pending"]:
                return False
            full = max(pending.sizes(self.spark, self.root, s).values()) > overlay.CAP
            if time.time() - (s["flushed"] or 0) < self.flush_secs and not full:
                return False
            changes = pending.every(self.spark, self.root, s)
            with passing(self.spark):
                version = snapshots.fold(self.spark, self.root, changes.removed, changes.delta)
            self._stamp(s | {"base": version, "pending": {}}, s)
            return True

    def _replace(self, s: dict, entries: DataFrame) -> str:
        meta = snapshots.read_meta(self.spark, self.root) or {}
        with passing(self.spark):
            version = snapshots.save(union_of_volumes([entries]), self.root, meta.get("method", "mft"), meta.get("volumes"), meta.get("skipped", 0), force=True)
        return self._stamp(s | {"base": version, "pending": {}}, s)

    def _stamp(self, after: dict, before: dict) -> str:
        pending.write(self.spark, self.root, after | {"flushed": time.time()}, before)
        snapshots.write_positions(self.spark, self.root, after["positions"])
        return after["base"]

    def rebuild(self, volumes: list[str], rescanned: DataFrame | None = None, positions: dict[str, int] | None = None) -> str:
        """Replace the entries of rescanned volumes; the others are carried over with their changes.

        ``positions`` are the ends of the journals from before the scan, where reading goes on, so
        that what changed during the scan is seen again.
        """
        with self.lock:
            s, letters = pending.read(self.spark, self.root), [v.upper().rstrip(":") for v in volumes]
            if rescanned is None:
                if self.rescan is None:
                    raise ValueError(f"nothing can scan {', '.join(letters)}")
                rescanned = self.rescan(letters)
            kept = self.live(s).where(~paths.drive_of("path").isin(letters))
            at = {k.upper().rstrip(":"): v for k, v in (positions or {}).items()}
            return self._replace(s | {"positions": s["positions"] | at, "floors": s["floors"] | at}, union_of_volumes([kept, rescanned]))

    def heal(self, bounds: DataFrame) -> dict[str, str]:
        """What each volume of bounds(drive, first, following[, journal]) needs. Volumes whose journal lost records
        since they were read (gap), or is another than it was (new), are rebuilt; reading goes on where the
        journal ended before the scan. Without a way to scan, a new journal is read from its first record."""
        s = pending.read(self.spark, self.root)
        held, known = s["positions"], s["journals"]
        found = {r.drive.upper().rstrip(":"): r for r in bounds.collect()}  # a row a volume
        ids = {d: r.journal for d, r in found.items()} if "journal" in bounds.columns else {}
        status = {d: "new" if d in ids and known.get(d, ids[d]) != ids[d] else journal.replay_status(held[d], r.first, r.following) for d, r in found.items() if d in held}
        if any(known.get(d) != j for d, j in ids.items()):
            with self.lock:
                s = pending.read(self.spark, self.root)
                pending.write(self.spark, self.root, s | {"journals": s["journals"] | ids}, s)
        torn = [d for d, x in status.items() if x == "gap" or (x == "new" and self.rescan)]
        if torn:
            self.rebuild(torn, positions={d: found[d].following for d in torn})
        for d, x in status.items():
            if x == "new" and d not in torn:
                self.resync(d, found[d].first)
        return status

    def resync(self, drive: str, following: int) -> None:
        """A journal that was made anew under a running stream: go on at its end, drop what came before."""
        with self.lock:
            s, d = pending.read(self.spark, self.root), drive.upper().rstrip(":")
            pending.write(self.spark, self.root, s | {"positions": s["positions"] | {d: following}, "floors": s["floors"] | {d: following}}, s)

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False, stream: str = "all", interval: str = INTERVAL):
        """A streaming query over ``events`` (columns of :data:`journal.EVENT`)."""
        def again():
            writer = events.writeStream.queryName(f"monitor-{stream}-{id(self)}").foreachBatch(lambda df, k: self.apply_batch(df, k, stream, checkpoint) and None)
            writer = writer.option("checkpointLocation", checkpoint)
            return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

        self._listen()
        query = again()
        self.streams[stream] = (query, again)
        return query

    def start_volumes(self, events: dict[str, DataFrame], checkpoint: str, **more) -> None:
        """One query per volume."""
        for drive, df in events.items():
            d = drive.upper().rstrip(":")
            self.start(df, f"{checkpoint.rstrip('/')}/{d}", stream=d, **more)

    def watch(self, folder: str, drives: list[str], checkpoint: str, interval: str = INTERVAL) -> None:
        """A stream for each volume whose journal is in ``folder`` (:mod:`quillon.sources.journals`). Each start reads
        on from the stored position, which the changes' own step has advanced, with a checkpoint of its own."""
        def begin(d: str):
            place = f"{checkpoint.rstrip('/')}/{d}/{uuid.uuid4().hex}"
            events = journals.stream(self.spark, folder, d, pending.read(self.spark, self.root)["positions"].get(d))
            writer = events.writeStream.queryName(f"monitor-{d}-{uuid.uuid4().hex[:8]}").foreachBatch(lambda df, k: self.apply_batch(df, k, d, place) and None)
            return writer.option("checkpointLocation", place).trigger(processingTime=interval).start()

        self._listen()
        self.bounds = self.bounds or (lambda: journals.bounds(self.spark, folder))
        self._guarded("heal", lambda: self.heal(self.bounds()))
        for drive in drives:
            d = drive.upper().rstrip(":")
            self.streams[d] = (begin(d), lambda d=d: begin(d))

    def _listen(self) -> None:
        if self.progress is None:
            self.progress = Progress()
            self.spark.streams.addListener(self.progress)

    def _guarded(self, name: str, run: Callable[[], object]) -> None:
        """What fails is noted under its name and tried again when it is due again."""
        try:
            run()
            self.faults.pop(name, None)
        except Exception as e:  # whatever it is, the other volumes go on
            self.faults[name] = str(e).splitlines()[0] if str(e) else type(e).__name__

    def revive(self, now: float | None = None) -> list[str]:
        """Note streams that failed; start those anew that have been down for RETRY seconds."""
        now, started = time.monotonic() if now is None else now, []
        for name, (query, again) in list(self.streams.items()):
            fault = None if query.isActive else query.exception()
            if fault is None:
                self.down.pop(name, None)
                continue
            since = self.down.setdefault(name, (now, str(fault).splitlines()[0]))[0]
            # a gap was healed before, there is nothing to wait for
            if now - since >= RETRY or journals.GAP in str(fault):
                self.streams[name] = (again(), again)
                self.down.pop(name)
                started.append(name)
        return started

    def tick(self) -> str | None:
        """What is due between batches: torn journals, failed streams, a request, a flush. The request that was
        taken up, if any; one that fails is noted in ``faults``."""
        if self.bounds:
            self._guarded("heal", lambda: self.heal(self.bounds()))
        self.revive()
        where = f"{self.root}/request"
        word = (snapshots.read_text(self.spark, where) or "").strip()
        if word:
            snapshots.delete(self.spark, where)
        if word == "flush":
            self._guarded("flush", self.flush)
        elif word == "rebuild":
            self._guarded("rebuild", self._rebuild_all)
        else:
            self._guarded("flush", self.flush_if_due)
        return word or None

    def _rebuild_all(self) -> None:
        """All volumes that were read, from where their journals ended before the scan."""
        found = {r.drive.upper().rstrip(":"): r.following for r in self.bounds().collect()} if self.bounds else {}
        self.rebuild(sorted(pending.read(self.spark, self.root)["positions"]), positions=found)

    def status(self, bounds: DataFrame | None = None) -> dict:
        """Position of each volume (and how far its journal is ahead), sizes of the changes, counters of all batches a stream (stored in
        one step with what they count), the last batch of each run, streams that are down. No table of changes is counted."""
        s = pending.read(self.spark, self.root)
        ahead = {r.drive.upper().rstrip(":"): r.following for r in bounds.collect()} if bounds is not None else {}
        drives = {d: {"position": p} | ({"lag": max(0, ahead[d] - p)} if d in ahead else {}) for d, p in sorted(s["positions"].items())}
        n = pending.sizes(self.spark, self.root, s)
        runs = {x: self.progress.runs[str(q.runId)] for x, (q, _) in sorted(self.streams.items()) if self.progress and str(q.runId) in self.progress.runs}
        return {"version": s["base"], "drives": drives, "pending": n, "counters": s["counters"], "progress": runs, "flushed": s["flushed"], "watching": sorted(set(self.streams) - set(self.down)), "down": {k: v[1] for k, v in self.down.items()}} | ({"faults": dict(self.faults)} if self.faults else {})


def request(spark: SparkSession, root: str, word: str) -> None:
    """Ask the monitor of this folder to ``flush`` or ``rebuild`` at its next tick."""
    if word not in ("flush", "rebuild"):
        raise ValueError(f"flush or rebuild, not {word!r}")
    snapshots.write_text(spark, f"{root}/request", word)
