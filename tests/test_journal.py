import time

import pytest
from pyspark.sql import functions as F

from quillon.operators import overlay
from quillon.service import Service
from quillon.sources import snapshots, walk
from quillon.sources.catalog import normalise
from quillon.streaming import journal as J
from quillon.streaming import pending
from quillon.streaming.monitor import Monitor, request

STATE = "path string, status string, size long, allocated long, mtime long, ctime long, flags int"


@pytest.fixture(scope="module")
def base(spark):
    rows = [(r"D:\links", True, 0, 60), (r"D:\links\h1.bin", False, 7, 70), (r"D:\links\h2.bin", False, 7, 70), (r"D:\links\other.bin", False, 9, 71), (r"D:\old", True, 0, 80), (r"D:\old\kid.txt", False, 5, 81)]
    return normalise(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, path string, is_dir boolean, size long, frn long"))


def run(spark, base, events, there, waiting=()):
    e = spark.createDataFrame([("D", *x) for x in events], J.EVENT)
    s = spark.createDataFrame([(p, "ok", n, n, 1, 1, 0) if n >= 0 else (p, "unknown", None, None, None, None, None) for p, n in there.items()], STATE)
    w = spark.createDataFrame(list(waiting), "drive string, frn long, old string")
    out = J.apply(base, e, s, w)
    return {r.path: r.size for r in out.live.where(~F.col("is_dir")).collect()}, {r.path for r in out.live.where("is_dir").collect()}, out


FILES = {r"D:\links\h1.bin": 7, r"D:\links\h2.bin": 7, r"D:\links\other.bin": 9, r"D:\old\kid.txt": 5}


def test_delete_of_one_link_keeps_the_other(spark, base):
    files, _, _ = run(spark, base, [(70, 60, "h1.bin", False, 1, J.FILE_DELETE)], {r"D:\links\h2.bin": 7})
    assert set(files) == set(FILES) - {r"D:\links\h1.bin"}


def test_delete_of_all_links(spark, base):
    files, _, _ = run(spark, base, [(70, 60, "h1.bin", False, 1, J.FILE_DELETE)], {})
    assert set(files) == {r"D:\links\other.bin", r"D:\old\kid.txt"}


def test_create_unknown_and_gone(spark, base):
    events = [(90, 60, "new.txt", False, 1, J.FILE_CREATE), (91, 60, "locked.txt", False, 2, J.FILE_CREATE), (92, 60, "ghost.txt", False, 3, J.FILE_CREATE), (93, 12345, "lost.txt", False, 4, J.FILE_CREATE)]
    files, _, out = run(spark, base, events, {r"D:\links\new.txt": 11, r"D:\links\locked.txt": -1})
    assert files == FILES | {r"D:\links\new.txt": 11, r"D:\links\locked.txt": 0}
    assert out.stats["resolve_fail"] == 1 and out.stats["stat_gone"] == 1
    assert out.live.where("frn = 90").first().id > 5


def test_refresh_and_rename(spark, base):
    events = [(71, 60, "other.bin", False, 1, J.DATA_EXTEND), (71, 60, "other.bin", False, 2, J.DATA_EXTEND), (999, 60, "unknown.bin", False, 3, J.DATA_EXTEND)]
    files, _, _ = run(spark, base, events, {r"D:\links\other.bin": 900, r"D:\links\unknown.bin": 3})
    assert files == FILES | {r"D:\links\other.bin": 900}
    events = [(71, 60, "other.bin", False, 1, J.RENAME_OLD), (71, 60, "renamed.bin", False, 2, J.RENAME_NEW)]
    files, _, _ = run(spark, base, events, {r"D:\links\renamed.bin": 9})
    assert set(files) == set(FILES) - {r"D:\links\other.bin"} | {r"D:\links\renamed.bin"}


def test_directory_rename_in_one_batch_and_across_two(spark, base):
    there = {r"D:\moved": 0, r"D:\moved\kid.txt": 5}
    old, new = (80, 5, "old", True, 1, J.RENAME_OLD), (80, 5, "moved", True, 2, J.RENAME_NEW)
    files, dirs, out = run(spark, base, [old, new], there)
    assert r"D:\moved\kid.txt" in files and r"D:\moved" in dirs and r"D:\old" not in dirs and out.stats["subtree_moved"] == 1
    _, _, half = run(spark, base, [old], {r"D:\old": 0})
    files, dirs, _ = run(spark, half.live, [new], there, [tuple(r) for r in half.dir_old.select("drive", "frn", "old").collect()])
    assert r"D:\moved\kid.txt" in files and r"D:\old\kid.txt" not in files


def test_parents_made_or_renamed_in_the_batch(spark, base):
    events = [(100, 5, "new", True, 1, J.FILE_CREATE), (101, 100, "sub", True, 2, J.FILE_CREATE), (102, 101, "f.txt", False, 3, J.FILE_CREATE)]
    files, dirs, out = run(spark, base, events, {r"D:\new": 0, r"D:\new\sub": 0, r"D:\new\sub\f.txt": 3} | FILES)
    assert files == FILES | {r"D:\new\sub\f.txt": 3} and {r"D:\new", r"D:\new\sub"} <= dirs and out.stats["resolve_fail"] == 0
    events = [(80, 5, "old", True, 1, J.RENAME_OLD), (80, 5, "moved", True, 2, J.RENAME_NEW), (103, 80, "g.txt", False, 3, J.FILE_CREATE)]
    files, dirs, out = run(spark, base, events, {r"D:\moved": 0, r"D:\moved\kid.txt": 5, r"D:\moved\g.txt": 4} | {p: n for p, n in FILES.items() if "old" not in p})
    assert files[r"D:\moved\g.txt"] == 4 and r"D:\moved\kid.txt" in files and r"D:\old\kid.txt" not in files and r"D:\old" not in dirs


def test_many_nested_moves_in_one_batch(spark):
    rows = [(k, rf"D:\d{k}", True, 0, 1000 + k) for k in range(1100)] + [(2000 + k, rf"D:\d{k}\kid.txt", False, 1, 5000 + k) for k in range(1100)]
    rows += [(4000, r"D:\d1\in", True, 0, 9000), (4001, r"D:\d1\in\deep.txt", False, 2, 9001), (4002, r"D:\d2\stay", True, 0, 9002)]
    live = normalise(spark.createDataFrame(rows, "id long, path string, is_dir boolean, size long, frn long"))
    events = [e for k in range(1100) for e in ((1000 + k, 5, f"d{k}", True, 2 * k, J.RENAME_OLD), (1000 + k, 5, f"m{k}", True, 2 * k + 1, J.RENAME_NEW))]
    # a directory inside one that moved is renamed into another that moved, below a live directory of it
    events += [(9000, 1001, "in", True, 5000, J.RENAME_OLD), (9000, 9002, "out", True, 5001, J.RENAME_NEW), (9003, 9000, "new.txt", False, 5002, J.FILE_CREATE)]
    want = {rf"D:\m{k}\kid.txt": 1 for k in range(1100)} | {r"D:\m2\stay\out\deep.txt": 2, r"D:\m2\stay\out\new.txt": 7}
    there = want | {rf"D:\m{k}": 0 for k in range(1100)} | {r"D:\m2\stay": 0, r"D:\m2\stay\out": 0}
    files, dirs, out = run(spark, live, events, there)
    assert files == want and out.stats["subtree_moved"] >= 1102 and r"D:\m2\stay\out" in dirs and r"D:\d1\in" not in dirs


def test_replay_status():
    assert [J.replay_status(*x) for x in ((5, 10, 20), (20, 10, 20), (15, 10, 20), (10, 10, 20))] == ["gap", "current", "replayable", "replayable"]


def test_stream(spark, base, tmp_path):
    root, inbox = str(tmp_path / "db"), tmp_path / "in"
    snapshots.save(base, root, "mft", ["D"])
    event = lambda *x: spark.createDataFrame([("D", *x)], J.EVENT).coalesce(1).write.mode("append").parquet(str(inbox))
    event(90, 60, "new.txt", False, 1, J.FILE_CREATE)
    state = spark.createDataFrame([(r"D:\links\new.txt", "ok", 4, 4, 1, 1, 0), (r"D:\links\h2.bin", "ok", 7, 7, 1, 1, 0)], STATE)
    m = Monitor(spark, root, lambda paths: state, flush_secs=0)
    for step in range(2):
        q = m.start(spark.readStream.schema(J.EVENT).parquet(str(inbox)), str(tmp_path / "ckpt"), available_now=True)
        q.awaitTermination()
        got = {r.path for r in snapshots.load(spark, root).where(~F.col("is_dir")).collect()}
        assert r"D:\links\new.txt" in got and (r"D:\links\h1.bin" in got) == (step == 0)
        if not step:
            event(70, 60, "h1.bin", False, 2, J.FILE_DELETE)
    assert snapshots.read_positions(spark, root)["D"] == 2


def table(spark, there):
    return spark.createDataFrame([(p, "ok", n, n, 1, 1, 0) for p, n in there.items()], STATE)


def events_of(spark, *rows):
    return spark.createDataFrame([r if isinstance(r[0], str) else ("D", *r) for r in rows], J.EVENT)


def test_changes_wait_beside_the_snapshot(spark, base, tmp_path):
    root, there = str(tmp_path / "db"), dict(FILES)
    snapshots.save(base, root, "mft", ["D"])
    first = snapshots.read_text(spark, f"{root}/current")
    asked = []

    def state(paths):
        asked.append({r.path for r in paths.collect()})
        return table(spark, there)

    m, s = Monitor(spark, root, state, flush_secs=3600), Service(spark, root)
    there |= {r"D:\moved": 0, r"D:\moved\kid.txt": 5}
    del there[r"D:\old\kid.txt"]
    m.apply_batch(events_of(spark, (80, 5, "old", True, 1, J.RENAME_OLD), (80, 5, "moved", True, 2, J.RENAME_NEW)), 0)
    assert asked[0] == {r"D:\old", r"D:\moved"} or asked[0] == {r"D:\moved"}
    there[r"D:\moved\new.txt"] = 4
    del there[r"D:\moved\kid.txt"]
    stats = m.apply_batch(events_of(spark, (81, 80, "kid.txt", False, 3, J.FILE_DELETE), (95, 80, "new.txt", False, 4, J.FILE_CREATE)), 1)
    want = {r"D:\links", r"D:\links\h1.bin", r"D:\links\h2.bin", r"D:\links\other.bin", r"D:\moved", r"D:\moved\new.txt"}
    assert {r.path for r in m.live().collect()} == want and stats["retired"] == 1
    assert m.apply_batch(events_of(spark, (81, 80, "again.txt", False, 5, J.FILE_CREATE)), 1) == {}
    assert snapshots.read_text(spark, f"{root}/current") == first and r"D:\old\kid.txt" in {r.path for r in snapshots.load(spark, root).collect()}
    assert s.refresh() and {h["path"] for h in s.search("")["hits"]} == want and not s.refresh()
    assert s.feed()["delta"] == 2 and not s.feed()["saturated"]
    assert m.status(spark.createDataFrame([("d", 0, 10)], "drive string, first long, following long"))["drives"] == {"D": {"position": 4, "lag": 6}}
    assert not m.flush_if_due() and snapshots.read_positions(spark, root) == {}
    # a monitor of another process takes up where this one stood
    Monitor(spark, root, state).flush()
    flushed = snapshots.load(spark, root)
    assert {r.path for r in flushed.collect()} == want and sorted(r.id for r in flushed.collect()) == list(range(6))
    assert snapshots.read_positions(spark, root) == {"D": 4} and s.refresh() and s.overlay is None and s.search("")["total"] == 6


def test_changes_of_a_replaced_snapshot_are_dropped(spark, base, tmp_path):
    root = str(tmp_path / "db")
    snapshots.save(base, root, "mft", ["D"])
    m = Monitor(spark, root, lambda paths: table(spark, {r"D:\links\new.txt": 1}))
    m.apply_batch(events_of(spark, (90, 60, "new.txt", False, 1, J.FILE_CREATE)), 0)
    assert m.live().count() == 7
    snapshots.save(base, root, "mft", ["D"])
    assert m.live().count() == 6 and m.status()["pending"] == {"removed": 0, "delta": 0}


def test_status_tells_progress_without_counting(spark, base, tmp_path, monkeypatch):
    root, inbox = str(tmp_path / "db"), str(tmp_path / "in")
    snapshots.save(base, root, "mft", ["D"])
    m = Monitor(spark, root, lambda paths: table(spark, {r"D:\links\new.txt": 1, r"D:\links\more.txt": 2}))
    events_of(spark, (90, 60, "new.txt", False, 1, J.FILE_CREATE)).write.parquet(inbox)
    events = spark.readStream.schema(J.EVENT).parquet(inbox)
    m.start(events, str(tmp_path / "ckpt"), available_now=True, stream="D").awaitTermination()
    events_of(spark, (91, 60, "more.txt", False, 2, J.FILE_CREATE), (92, 60, "gone.txt", False, 3, J.FILE_CREATE)).write.mode("append").parquet(inbox)
    query = m.start(events, str(tmp_path / "ckpt"), available_now=True, stream="D")
    query.awaitTermination()
    for _ in range(100):
        if str(query.runId) in m.progress.runs:
            break
        time.sleep(0.1)
    monkeypatch.setattr(pending, "every", None)  # the tables of changes are not looked at
    s = m.status()
    counters = s["counters"]["D"]
    assert (counters["batches"], counters["events"], counters["applied"], counters["stat_gone"]) == (2, 3, 2, 1)
    assert s["pending"]["delta"] == 2 and (s["progress"]["D"]["rows"] > 0, s["progress"]["D"]["batches"]) == (True, 1)
    assert not m.flush_if_due()


def test_many_changes_are_folded_at_once(spark, base, tmp_path, monkeypatch):
    root = str(tmp_path / "db")
    snapshots.save(base, root, "mft", ["D"])
    monkeypatch.setattr(overlay, "CAP", 1)
    m = Monitor(spark, root, lambda paths: table(spark, {rf"D:\links\n{k}": 1 for k in range(3)}), flush_secs=3600)
    m.apply_batch(events_of(spark, *[(90 + k, 60, f"n{k}", False, k, J.FILE_CREATE) for k in range(3)]), 0)
    assert snapshots.load(spark, root).count() == 9


def test_gaps_resyncs_and_rebuilds(spark, base, tmp_path):
    root = str(tmp_path / "db")
    other = normalise(spark.createDataFrame([(9, r"E:\keep.txt", 3)], "id long, path string, size long"))
    snapshots.save(base.unionByName(other), root, "mft", ["D", "E"])
    snapshots.write_positions(spark, root, {"D": 5, "E": 15})
    scanned = []

    def rescan(letters):
        scanned.append(letters)
        return normalise(spark.createDataFrame([(0, r"D:\only.txt", 8)], "id long, path string, size long"))

    m = Monitor(spark, root, lambda paths: table(spark, {r"D:\late.txt": 1}), rescan=rescan)
    bounds = spark.createDataFrame([("D:", 10, 20), ("E", 10, 20), ("F", 0, 1)], "drive string, first long, following long")
    assert m.heal(bounds) == {"D": "gap", "E": "replayable"} and scanned == [["D"]]
    assert {r.path for r in m.live().collect()} == {r"D:\only.txt", r"E:\keep.txt"} and snapshots.read_positions(spark, root) == {"D": 20, "E": 15}
    # the scan has seen what came before its start
    assert m.apply_batch(events_of(spark, (1, 5, "late.txt", False, 19, J.FILE_CREATE)), 0) == {}
    assert m.apply_batch(events_of(spark, (1, 5, "late.txt", False, 20, J.FILE_CREATE)), 1)["applied"] == 1
    m.resync("d:", 1000)
    assert m.apply_batch(events_of(spark, (1, 5, "late.txt", False, 21, J.FILE_DELETE)), 2) == {}
    assert m.status()["drives"]["D"]["position"] == 1000
    with pytest.raises(ValueError):
        Monitor(spark, root, m.state).rebuild(["D"])


def test_a_dead_volume_stops_no_other(spark, base, tmp_path):
    root, inbox = str(tmp_path / "db"), tmp_path / "in"
    snapshots.save(base, root, "mft", ["D"])
    events_of(spark, ("D", 90, 60, "new.txt", False, 1, J.FILE_CREATE), ("E", 1, 5, "bad.txt", False, 1, J.FILE_CREATE)).coalesce(1).write.parquet(str(inbox))
    broken = [True]

    def state(paths):
        if broken[0] and paths.where("path LIKE 'E:%'").count():
            raise OSError("volume is gone")
        return table(spark, {r"D:\links\new.txt": 4, r"E:\bad.txt": 2})

    m = Monitor(spark, root, state, flush_secs=0)
    source = spark.readStream.schema(J.EVENT).parquet(str(inbox))
    m.start_volumes({d: source.where(F.col("drive") == d) for d in "DE"}, str(tmp_path / "ckpt"), available_now=True)
    for q, _ in m.streams.values():
        try:
            q.awaitTermination()
        except Exception:
            pass
    assert m.revive(now=0) == [] and set(m.down) == {"E"} and r"D:\links\new.txt" in {r.path for r in m.live().collect()}
    broken[0] = False
    assert m.revive(now=59) == [] and m.revive(now=61) == ["E"]
    m.streams["E"][0].awaitTermination()
    assert r"E:\bad.txt" in {r.path for r in m.live().collect()} and m.revive() == [] and m.down == {}
    request(spark, root, "flush")
    assert m.tick() == "flush" and m.tick() is None
    with pytest.raises(ValueError):
        request(spark, root, "format")


def test_probe(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.txt").write_text("xyz")
    asked = spark.createDataFrame([(r"D:\a",), (r"d:\a\b.txt",), (r"D:\none",), (r"D:\a\b.txt\c",), (None,)], "path string")
    got = {r.path: (r.status, r["size"]) for r in walk.probe(asked, {"D": str(tmp_path)}).collect()}
    assert got == {r"D:\a": ("ok", 0), r"d:\a\b.txt": ("ok", 3)}
