"""Batches that use names again, against a small model of a file system."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.sources.catalog import normalise
from quillon.streaming import journal as J

from .test_journal import STATE


class Files:
    """Nodes with parents and names; every change is noted as a journal notes it."""

    def __init__(self):
        self.dirs, self.links, self.events, self.usn, self.next = {}, [], [], 0, 100

    def note(self, frn, parent, name, is_dir, reason):
        self.usn += 1
        self.events.append((frn, parent, name, is_dir, self.usn, reason))

    def where(self, frn):
        out = []
        while frn != 5:
            parent, name = self.dirs[frn]
            out.append(name)
            frn = parent
        return "\\".join(["D:", *reversed(out)])

    def taken(self, parent):
        return {n for p, n in self.dirs.values() if p == parent} | {n for _, p, n in self.links if p == parent}

    def below(self, frn):
        own = [k for k, (p, _) in self.dirs.items() if p == frn]
        return [*own, *(x for k in own for x in self.below(k))]

    def all(self):
        out = {(self.where(k), True, k) for k in self.dirs}
        return out | {(self.where(p) + "\\" + n, False, f) for f, p, n in self.links}

    def mkdir(self, parent, name):
        self.next += 1
        self.dirs[self.next] = (parent, name)
        self.note(self.next, parent, name, True, J.FILE_CREATE)
        return self.next

    def make(self, parent, name):
        self.next += 1
        self.links.append((self.next, parent, name))
        self.note(self.next, parent, name, False, J.FILE_CREATE)
        return self.next

    def move_dir(self, frn, parent, name):
        self.note(frn, *self.dirs[frn], True, J.RENAME_OLD)
        self.dirs[frn] = (parent, name)
        self.note(frn, parent, name, True, J.RENAME_NEW)

    def move(self, k, parent, name):
        frn, p, n = self.links[k]
        self.note(frn, p, n, False, J.RENAME_OLD)
        self.links[k] = (frn, parent, name)
        self.note(frn, parent, name, False, J.RENAME_NEW)

    def link(self, k, parent, name):
        self.links.append((self.links[k][0], parent, name))
        self.note(self.links[k][0], parent, name, False, J.HARD_LINK)

    def unlink(self, k):
        frn, p, n = self.links.pop(k)
        self.note(frn, p, n, False, J.HARD_LINK if any(f == frn for f, _, _ in self.links) else J.FILE_DELETE)

    def rmdir(self, frn):
        p, n = self.dirs.pop(frn)
        self.note(frn, p, n, True, J.FILE_DELETE)

    def step(self, r, names):
        """Some change; a name is free where it is used."""
        spots = [5, *self.dirs]
        parent, kind = r.choice(spots), r.randrange(10)
        free = sorted(set(names) - self.taken(parent))
        name = r.choice(free) if free else None
        if kind == 0 and name and len(self.dirs) < 25:
            self.mkdir(parent, name)
        elif kind in (1, 2) and name:
            self.make(parent, name)
        elif kind in (3, 4, 5) and name and self.dirs:
            frn = r.choice(list(self.dirs))
            if parent != frn and parent not in self.below(frn):
                self.move_dir(frn, parent, name)
        elif kind == 6 and name and self.links:
            self.move(r.randrange(len(self.links)), parent, name)
        elif kind == 7 and name and self.links:
            self.link(r.randrange(len(self.links)), parent, name)
        elif kind == 8 and self.links:
            self.unlink(r.randrange(len(self.links)))
        elif kind == 9 and self.dirs:
            empty = [k for k in self.dirs if not self.taken(k)]
            if empty:
                self.rmdir(r.choice(empty))
        elif self.links:
            frn, p, n = r.choice(self.links)
            self.note(frn, p, n, False, J.DATA_EXTEND)


def catalogue(spark, files):
    return normalise(spark.createDataFrame([(k, p, d, f) for k, (p, d, f) in enumerate(sorted(files.all()))] or [(0, "D:\\none", False, 1)], "id long, path string, is_dir boolean, frn long"))


def fold(spark, live, files, events, waiting=()):
    state = spark.createDataFrame([(p, "ok", 1, 1, 1, 1, 0) for p, _, _ in files.all()] or [("D:\\x", "ok", 1, 1, 1, 1, 0)], STATE)
    e = spark.createDataFrame([("D", *x) for x in events], J.EVENT)
    return J.apply(live, e, state, spark.createDataFrame(list(waiting), "drive string, frn long, old string"))


def held(out):
    return sorted((r.path, r.is_dir, r.frn) for r in out.live.collect())


def two(spark):
    f = Files()
    dist, tmp = f.mkdir(5, "dist"), f.mkdir(5, "dist.tmp")
    f.make(dist, "a.txt")
    f.make(tmp, "b.txt")
    f.make(f.mkdir(tmp, "sub"), "deep.txt")
    live = catalogue(spark, f)
    f.events.clear()
    return f, dist, tmp, live


def test_a_name_that_is_handed_on(spark):
    f, dist, tmp, live = two(spark)
    f.move_dir(dist, 5, "dist.bak")
    f.move_dir(tmp, 5, "dist")
    f.make(tmp, "new.txt")
    out = fold(spark, live, f, f.events)
    assert held(out) == sorted(f.all()) and ("D:\\dist\\sub\\deep.txt", False) in {(p, d) for p, d, _ in held(out)}
    assert out.stats["stat_gone"] == 0 and out.stats["resolve_fail"] == 0


def test_a_name_that_a_new_directory_takes(spark):
    f, dist, _, live = two(spark)
    f.move_dir(dist, 5, "dist.bak")
    f.make(f.mkdir(5, "dist"), "c.txt")
    out = fold(spark, live, f, f.events)
    assert held(out) == sorted(f.all()) and out.stats["stat_gone"] == 0


def test_names_that_are_swapped(spark):
    f, dist, tmp, live = two(spark)
    f.move_dir(dist, 5, "x")
    f.move_dir(tmp, 5, "dist")
    f.move_dir(dist, 5, "dist.tmp")
    out = fold(spark, live, f, f.events)
    assert held(out) == sorted(f.all()) and out.stats["subtree_moved"] == 4


def test_a_name_taken_between_the_halves_of_a_rename(spark):
    f, dist, tmp, live = two(spark)
    f.move_dir(dist, 5, "dist.bak")
    f.move_dir(tmp, 5, "dist")
    first, last = [f.events[0], *f.events[2:]], [f.events[1]]
    half = fold(spark, live, f, first)
    wait = [tuple(x) for x in half.dir_old.select("drive", "frn", "old").collect()]
    assert [x[:2] for x in wait] == [("D", dist)] and {p for p, d, _ in held(half) if d} == {"D:\\dist", "D:\\dist\\sub"}
    out = fold(spark, half.live, f, last, wait)
    assert held(out) == sorted(f.all()) and out.dir_old.isEmpty()


def test_spans_and_paths_at_the_time_of_events(spark):
    f, dist, tmp, live = two(spark)
    told = []
    for change in (lambda: f.make(dist, "one"), lambda: f.move_dir(dist, tmp, "in"), lambda: f.make(dist, "two"), lambda: f.move_dir(tmp, 5, "out"), lambda: f.make(dist, "three"), lambda: f.make(f.mkdir(dist, "kid"), "four")):
        before = len(f.events)
        change()
        told += [(x, f.where(x[1]) + "\\" + x[2]) for x in f.events[before:]]
    e = spark.createDataFrame([("D", *x) for x in f.events], J.EVENT)
    spans = J.names(e)
    assert {(r.name, r.from_usn is not None, r.to_usn is None) for r in spans.collect()} == {(n, True, True) for n in ("one", "in", "two", "out", "three", "kid", "four")}
    got = {r.usn: r.path_then for r in J.as_of(e, spans, J.directories(live)).collect()}
    olds = {x[4] for x in f.events if x[5] == J.RENAME_OLD}
    assert {u: p for u, p in got.items() if u not in olds} == {x[4]: p for x, p in told if x[4] not in olds}
    assert got[min(olds)] == "D:\\dist" and got[max(olds)] == "D:\\dist.tmp"


@pytest.mark.parametrize("seed,steps,batches", [(1, 500, 2), (2, 250, 5), (3, 250, 1)])
def test_random_replay(spark, seed, steps, batches):
    """A thousand events in all, with few names, so that most are used again; files, links and directories."""
    r, f = random.Random(seed), Files()
    for _ in range(60):
        f.step(r, "abcde")
    live = catalogue(spark, f)
    for _ in range(batches):
        f.events.clear()
        for _ in range(steps // batches):
            f.step(r, "abcde")
        out = fold(spark, live, f, f.events)
        assert held(out) == sorted(f.all()) and out.dir_old.isEmpty()
        live = spark.createDataFrame(out.live.collect(), out.live.schema)
    assert out.live.select("id").distinct().count() == out.live.count() and out.live.where(F.col("path").contains(J.PARKED)).isEmpty()
