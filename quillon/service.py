"""Answers as plain values: what the command line prints and a server would send."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths
from quillon.operators import duplicates, overlay, search, stats, usage
from quillon.operators.query import Clock, QueryError
from quillon.sources import snapshots, walk
from quillon.sources.catalog import HIT, with_derived
from quillon.sources.scratch import durable, passing
from quillon.streaming import pending


class Service:
    """Search over the current snapshot with the changes that wait beside it; roll-ups over the
    snapshot alone.

    Answers are kept for TTL seconds, CACHE at most, and dropped when the data change. With
    ``watch`` the pointers are looked at before an answer, every POLL seconds at most.
    """

    CACHE, TTL, POLL = 256, 3.0, 2.0

    def __init__(self, spark: SparkSession, root: str, watch: bool = False):
        self.spark, self.root, self.watch, self.overlay, self.generation = spark, root, watch, None, 0
        self.saturated, self.names, self.looked = False, {}, time.monotonic()
        self.kept: dict[tuple, tuple[float, dict]] = {}
        self.reload()

    def reload(self) -> None:
        s = pending.read(self.spark, self.root)
        self.base, self.version = snapshots.load(self.spark, self.root, s["base"]), s["base"]
        self.overlay, self.saturated, self.names, self.generation = None, False, {}, self.generation + 1
        self.kept.clear()
        self._take(s)

    def _take(self, s: dict) -> None:
        changes = pending.every(self.spark, self.root, s)
        if changes is not None:
            self.changed(changes.removed, changes.delta)
        self.names = dict(s["pending"])

    def refresh(self) -> bool:
        """Load the snapshot anew if the pointer has moved, the changes if there are others."""
        s = pending.read(self.spark, self.root)
        if s["base"] != self.version:
            self.reload()
            return True
        if s["pending"] == self.names:
            return False
        self._take(s)
        return True

    def poll(self) -> None:
        if self.watch and time.monotonic() - self.looked >= self.POLL:
            self.refresh()
            self.looked = time.monotonic()

    def warm(self) -> None:
        """Read the snapshot once before the first question."""
        self.stats()

    def changed(self, removed: DataFrame, delta: DataFrame) -> None:
        """A batch of changes; it replaces the one before. Answers stay right beyond the cap on rows,
        but a fold is due: the feed says so."""
        self.overlay = overlay.Overlay(removed, delta)
        self.saturated = self.overlay.saturated()
        self.kept.clear()

    def search(self, q: str, limit: int | None = None, sort: str | None = None, desc: str | None = None, clock: Clock | None = None) -> dict:
        self.poll()
        key, now = (q, limit, sort, desc), time.monotonic()
        if key in self.kept and now - self.kept[key][0] < self.TTL:
            return self.kept[key][1] | {"took_ms": 0}
        try:
            n = search.DEFAULT_LIMIT if limit is None else max(0, min(int(limit), search.MAX_LIMIT))
            order, down = search.parse_sort(sort), search.parse_flag(desc)
            if self.overlay:
                found, page = overlay.page(self.base, self.overlay, q, n, order, down, clock)
            else:
                found = search.matching(self.base, q, clock)
                page = search.page(found, n, order, down)
            hits = [r.asDict() for r in page.select(*HIT).collect()]
            out = {"ok": True, "query": q, "engine": "spark", "count": len(hits), "total": found.count(), "took_ms": int(1000 * (time.monotonic() - now)), "hits": hits}
        except QueryError as e:
            return {"ok": False, "query": q, "error": str(e)}
        if len(self.kept) >= self.CACHE:
            self.kept.pop(next(iter(self.kept)))
        self.kept[key] = (now, out)
        return out

    def du(self, path: str, depth: int | None = None, top: int = usage.TOP, allocated: str | bool = False) -> dict:
        try:
            by = allocated if isinstance(allocated, bool) else search.parse_flag(allocated)
            u = usage.usage(self.base, path, depth, top, by)
        except QueryError as e:
            return {"ok": False, "error": str(e)}
        children = [r.asDict() for r in u.children.collect()]
        return {"ok": True} | {k: getattr(u, k) for k in ("root", "total_bytes", "total_allocated", "files", "dirs", "entries", "truncated")} | {"children": children}

    def stats(self) -> dict:
        return {"ok": True, "meta": snapshots.read_meta(self.spark, self.root)} | stats.counts(self.base).first().asDict()

    def dupes(self, contents: DataFrame, min_size: int = duplicates.MIN_SIZE, name: str | None = None, limit: int = duplicates.LIMIT) -> dict:
        found = duplicates.groups(self.base, contents, min_size, name)
        top = [r.asDict() for r in duplicates.ranked(found, limit).collect()]
        return {"ok": True} | duplicates.summary(self.base, contents, min_size, name).first().asDict() | {"largest": top}

    def staged_dupes(self, root: str = "", mounts: dict[str, str] | None = None, min_size: int = duplicates.MIN_SIZE, name: str | None = None, limit: int = duplicates.LIMIT) -> dict:
        """As :meth:`dupes`, of files (below ``root``, if given) that executors open where they are mounted, read in stages and by blocks."""
        base = with_derived(self.base).where(paths.starts_under(F.col("path_ci"), paths.fold_path_text(paths.trim_separators(root)))) if root else self.base
        with passing(self.spark):
            found, hashed, skipped = duplicates.staged(base, lambda df, first: walk.digests(df, first, mounts), min_size, name)
            found = durable(found, "dupes-found")
            top = [r.asDict() for r in duplicates.ranked(found, limit).collect()]
            sums = duplicates.wasted(found).first().asDict()
        return {"ok": True} | sums | {"files_hashed": hashed, "skipped": skipped, "largest": top}

    def health(self) -> dict:
        return {"ok": True, "generation": self.generation, "overlay": self.overlay is not None}

    def feed(self) -> dict:
        """The changes that answers include."""
        self.poll()
        n = {"removed": self.overlay.removed.count(), "delta": self.overlay.delta.count()} if self.overlay else {"removed": 0, "delta": 0}
        return {"ok": True, "watching": self.watch, "generation": self.generation, "version": self.version, "saturated": self.saturated} | n
