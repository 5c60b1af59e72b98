import json
import struct
import threading
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
import pytest

from quillon import cli, http
from quillon.operators import search
from quillon.service import Service
from quillon.sources import records, snapshots, walk
from quillon.sources.catalog import normalise
from quillon.streaming import journal as J


def journal(major, frn, parent, name, usn, reason, attributes=0):
    raw, ids = name.encode("utf-16-le"), 8 if major == 2 else 16
    head = 8 + 2 * ids + 36
    length = (head + len(raw) + 7) // 8 * 8
    body = struct.pack("<IHH", length, major, 0) + frn.to_bytes(ids, "little") + parent.to_bytes(ids, "little")
    body += struct.pack("<qqIIIIHH", usn, 0, reason, 0, 0, attributes, len(raw), head) + raw
    return body.ljust(length, b"\0")


def test_journal_records(spark):
    buffer = journal(2, (3 << 48) | 7, 5, "a.txt", 10, 0x100) + journal(9, 1, 1, "skip", 11, 1) + journal(3, 8, 7, "目录", 12, 0x2000, 0x10) + b"\x40\0\0\0\2\0\0\0"
    rows = records.decode_journal(spark.createDataFrame([(bytearray(buffer),), (None,)], "data binary")).collect()
    assert [tuple(r) for r in rows] == [(7, 5, "a.txt", False, 10, 0x100), (8, 7, "目录", True, 12, 0x2000)]
    assert records.decode_journal(spark.createDataFrame([(bytearray(buffer),)], "data binary"), mask=0x2000).count() == 1


def test_records_are_decoded_in_pieces():
    """However many records buffers or lists hold, so many rows at most exist at a time."""
    n = 2 * records.HELD_ROWS + 1
    buffer = b"".join(journal(2 + k % 2, k, 5, f"f{k}", k, 1) for k in range(n))
    pieces = list(records._events([pa.record_batch({"data": pa.array([buffer, None, buffer], pa.binary())})]))
    assert max(x.num_rows for x in pieces) == records.HELD_ROWS and [r["usn"] for x in pieces for r in x.to_pylist()] == [*range(n)] * 2
    kinds = pa.list_(pa.struct([("at", pa.int32()), ("part", pa.binary())]))
    entries = struct.pack("<IHBBQQHHI", 0x80, 32, 0, 26, 0, 9, 0, 0, 0) * n
    batch = pa.record_batch({"frn": [7], "list_bytes": [len(entries) - 32], "parts": pa.array([[{"at": 0, "part": entries[:100]}, {"at": 1, "part": entries[100:]}]], kinds)})
    pieces = list(records._listed([batch]))
    assert max(x.num_rows for x in pieces) == records.HELD_ROWS and sum(x.num_rows for x in pieces) == n - 1
    assert pieces[0].slice(0, 1).to_pylist() == [{"frn": 7, "kind": 0x80, "vcn": 0, "owner": 9}]


def attribute(kind, value, name_length=0):
    length = (24 + len(value) + 7) // 8 * 8
    return (struct.pack("<IIBBHHH", kind, length, 0, name_length, 24, 0, 0) + struct.pack("<IHH", len(value), 24, 0) + value).ljust(length, b"\0")


def name_value(parent, name, space=1):
    return struct.pack("<Q", parent) + b"\0" * 56 + bytes([len(name), space]) + name.encode("utf-16-le")


def record(attributes, use=1, base=0):
    body = b"".join(attributes) + struct.pack("<I", 0xFFFFFFFF)
    head = bytearray(56)
    head[:4] = b"FILE"
    struct.pack_into("<HH", head, 4, 48, 3)
    struct.pack_into("<HH", head, 20, 56, use)
    struct.pack_into("<Q", head, 32, base)
    out = bytearray((bytes(head) + body).ljust(1024, b"\0"))
    out[48:50] = b"\x01\x00"
    for k in (1, 2):
        out[48 + 2 * k : 50 + 2 * k] = out[512 * k - 2 : 512 * k]
        out[512 * k - 2 : 512 * k] = b"\x01\x00"
    return bytes(out)


def test_file_records(spark):
    standard = attribute(0x10, struct.pack("<QQQQI", 116444736000000000, 116444736000000000 + 50_000_000, 0, 0, 0x2 | 0x1) + b"\0" * 12)
    r = record([standard, attribute(0x30, name_value(5, "a.txt")), attribute(0x30, name_value(6, "link.txt")), attribute(0x30, name_value(5, "A~1.TXT", 2)), attribute(0x80, b"hello")])
    torn = bytearray(r)
    torn[511] = 9
    df = spark.createDataFrame([(40, bytearray(r)), (41, torn), (42, bytearray(record([], use=0))), (43, bytearray(b"nope"))], "number long, data binary")
    rows = records.decode_files(df).collect()
    assert [(x.frn, x.parent_frn, x.name, x.size, x.allocated, x.mtime, x.ctime, x.flags) for x in rows] == [(40, 5, "a.txt", 5, 0, 5, 0, 5), (40, 6, "link.txt", 5, 0, 5, 0, 5)]
    assert records.run_list(b"\x21\x18\x34\x56\x11\x05\xfe\x01\x07\x00") == [(0x5634, 0x18), (0x5632, 5), (None, 7)]


def outside(kind, size, runs, vcn=0):
    length = (64 + len(runs) + 8) // 8 * 8
    return (struct.pack("<IIBBHHH", kind, length, 1, 0, 64, 0, 0) + struct.pack("<QQHHIQQQ", vcn, 0, 64, 0, 0, size + 1, size, size) + runs).ljust(length, b"\0")


def listed(kind, owner, vcn=0, name=""):
    raw = name.encode("utf-16-le")
    length = (26 + len(raw) + 7) // 8 * 8
    return (struct.pack("<IHBBQQH", kind, length, len(name), 26, vcn, (2 << 48) | owner, 0) + raw).ljust(length, b"\0")


def test_attribute_lists(spark):
    times = lambda t: attribute(0x10, struct.pack("<QQQQI", *[116444736000000000 + t * 10_000_000] * 4, 2) + b"\0" * 12)
    label = lambda n: attribute(0x30, name_value(5, n))
    inside = attribute(0x20, listed(0x80, 99, name="other") + listed(0x80, 98, vcn=4) + listed(0x80, 60))
    long = b"".join(listed(0x80, 70 + k, vcn=k) for k in range(1, 300)) + listed(0x80, 61)
    away = outside(0x20, len(long), b"\x11\x02\x07\x11\x01\x02\x00")  # clusters 7, 8 and 9
    rows = [
        (40, record([times(4), label("a"), inside])), (60, record([outside(0x80, 1000, b"")], base=40)), (98, record([outside(0x80, 5, b"", 4)], base=40)),
        (41, record([label("b"), away])), (61, record([outside(0x80, 2000, b""), times(9), label("b2")], base=41)),
        (42, record([times(1), label("foreign"), attribute(0x20, listed(0x80, 60))])),  # 60 continues another file
        (43, record([times(1), label("torn"), outside(0x20, 9000, b"\x11\x01\x07\x00")])),  # longer than its clusters
        (44, record([times(1), label("lost"), outside(0x20, 40, b"\x11\x01\x30\x00")])),  # its cluster is not there
        (45, record([times(1), label("holes"), outside(0x20, 40, b"\x01\x01\x00")])), (46, record([label("own"), attribute(0x80, b"xyz"), attribute(0x20, listed(0x80, 60))])),
        (47, record([label("freed")], use=0)), (62, record([label("of freed")], base=47)), (48, record([times(3), label("dir"), label("dir")], use=3)), (49, None),
    ]
    table = spark.createDataFrame([(n, bytearray(b) if b else None) for n, b in rows], "number long, data binary")
    blocks = [long[k : k + 4096] for k in range(0, len(long), 4096)]
    assert len(blocks) == 3
    clusters = spark.createDataFrame([(7 + k, bytearray(b)) for k, b in enumerate(blocks)], "cluster long, data binary")
    got = {r.name: (r.frn, r.is_dir, r.size, r.allocated, r.mtime, r.flags) for r in records.entries(table, clusters).collect()}
    assert got == {"a": (40, False, 1000, 1001, 4, 1), "b": (41, False, 2000, 2001, 0, 0), "b2": (41, False, 2000, 2001, 0, 0), "foreign": (42, False, 0, 0, 1, 1), "torn": (43, False, 0, 0, 1, 1),
                   "lost": (44, False, 0, 0, 1, 1), "holes": (45, False, 0, 0, 1, 1), "own": (46, False, 3, 0, 0, 0), "dir": (48, True, 0, 0, 3, 1)}
    assert {r.name: r.size for r in records.entries(table).where("frn < 42").collect()} == {"a": 1000, "b": 0, "b2": 0}
    assert records.entries(table.where("false"), clusters).count() == 0
    part = walk.recorded("d", table, clusters, 9)
    assert (part.method, part.skipped, part.max_usn) == ("mft", 0, 9) and {r.path for r in part.entries.where("frn < 42").collect()} == {r"D:\a", r"D:\b", r"D:\b2"}


def test_enumeration_is_a_part(spark):
    pack = lambda *rows: (bytearray(b"\x09" + b"\0" * 7 + b"".join(journal(2 + k % 2, *r) for k, r in enumerate(rows))),)
    buffers = spark.createDataFrame([pack((5, 5, ".", 1, 0, 16), (40, 5, "dev", 70, 0, 16)), pack((50, 40, "m.rs", 20, 0), (51, 666, "orphan", 30, 0)), (bytearray(8),), (None,)], "data binary")
    part = walk.enumerated("D:", buffers)
    assert {(r.path, r.is_dir, r.frn) for r in part.entries.collect()} == {(r"D:\dev", True, 40), (r"D:\dev\m.rs", False, 50)} and (part.skipped, part.max_usn) == (1, 70)
    entries, report = walk.build([part, walk.Part("D", "walk", part.entries.where("false"))])
    assert (report.method, report.max_usn, report.files, report.skipped) == ("usn", {"D": 70}, 1, 1)
    empty = walk.enumerated("E", buffers.where("false"))
    assert empty.entries.count() == 0 and empty.max_usn is None


def test_walk_hands_branches_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "FOLDERS", 7)
    wide = tmp_path / "one" / "branch"
    for k in range(60):
        (wide / f"d{k}" / "e").mkdir(parents=True)
        (wide / f"d{k}" / "e" / "f").write_text("x" * k)
    (tmp_path / "link").symlink_to(tmp_path / "one")
    rounds, write = [], walk.durable
    monkeypatch.setattr(walk, "durable", lambda df, name: rounds.append(write(df, name)) or rounds[-1])
    entries, skipped = walk.tree(spark, str(tmp_path))
    assert skipped == 0 and entries.count() == 2 + 60 * 3 + 1 and entries.agg({"size": "sum"}).first()[0] == sum(range(60)) + (tmp_path / "link").lstat().st_size
    tasks = max(r.where("kind = 'entry'").selectExpr("input_file_name() AS f").distinct().count() for r in rounds)
    assert len(rounds) > 2 and tasks >= 4
    assert walk.tree(spark, str(tmp_path / "none"))[1] == 1


def test_staged_duplicates(spark, tmp_path):
    from quillon.operators import duplicates

    head = duplicates.HEAD
    data = {"a": b"s" * 4096, "b": b"s" * 4096, "c": b"t" * 4096, "long1": b"h" * head + b"1", "long2": b"h" * head + b"1", "long3": b"h" * head + b"2", "long4": b"i" * head + b"1"}
    for n, b in data.items():
        (tmp_path / n).write_bytes(b)
    huge = (2 << 30) + 5
    for n in ("huge1", "huge2", "huge3"):
        with open(tmp_path / n, "wb") as f:
            f.truncate(huge)
    with open(tmp_path / "huge3", "r+b") as f:
        f.seek(huge - 1)
        f.write(b"!")
    # "alone" is not there, but no other file has its size: it is never opened
    sizes = {n: len(b) for n, b in data.items()} | {"huge1": huge, "huge2": huge, "huge3": huge, "alone": 999_999, "gone": 4096, "small": 7}
    c = normalise(spark.createDataFrame([(k, f"X:\\{n}", s) for k, (n, s) in enumerate(sizes.items())], "id long, path string, size long"))
    read = []

    def reader(df, first):
        read.append((first, sorted(r.path[3:] for r in df.collect())))
        return walk.digests(df, first, {"X": str(tmp_path)})

    found, hashed, skipped = duplicates.staged(c, reader)
    assert {r.path[3:] for r in found.collect()} == {"a", "b", "long1", "long2", "huge1", "huge2"} and (hashed, skipped) == (11, 1)
    assert read == [(head, sorted(set(sizes) - {"alone", "small"})), (None, ["huge1", "huge2", "huge3", "long1", "long2", "long3"])]
    contents = spark.createDataFrame([(f"X:\\{n}", bytearray(b)) for n, b in data.items()], "path string, content binary")
    some = c.where(f"size < {huge}")
    plain, staged = duplicates.groups(some, contents), duplicates.staged(some, reader)[0]
    assert {(r.path, r.size) for r in plain.collect()} == {(r.path, r.size) for r in staged.collect()}
    assert duplicates.ranked(found).first().wasted == huge
    assert duplicates.staged(c.where("false"), reader)[0].count() == 0


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "db")
    c = normalise(spark.createDataFrame([(0, r"D:\x.txt", 4)], "id long, path string, size long"))
    assert snapshots.read_meta(spark, root) is None
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, root)
    snapshots.save(c, root, "mft", ["D"], 2)
    assert snapshots.load(spark, root).count() == 1 and snapshots.read_meta(spark, root)["skipped"] == 2
    with pytest.raises(snapshots.DegradeError):
        snapshots.save(c, root, "walk")
    snapshots.save(c.union(c), root, "walk", force=True)
    assert snapshots.load(spark, root).count() == 2 and not snapshots.upgrade(spark, root)
    c.drop("allocated").write.parquet(f"{root}/plain")
    snapshots.write_text(spark, f"{root}/current", "plain")
    assert snapshots.load(spark, root).first().allocated == 4 and snapshots.upgrade(spark, root) and "name_l" in snapshots.load(spark, root).columns
    snapshots.write_positions(spark, root, {"C": 5})
    snapshots.write_positions(spark, root, {"D": 7})
    assert snapshots.read_positions(spark, root) == {"C": 5, "D": 7}
    (tmp_path / "db" / "meta.json").write_text("not json")
    (tmp_path / "db" / ".meta.json.crc").unlink(missing_ok=True)
    assert snapshots.read_meta(spark, root) is None


def test_walk_service_and_cli(spark, tmp_path, capsys):
    data, db = tmp_path / "data", str(tmp_path / "db")
    (data / "sub" / "deep").mkdir(parents=True)
    (data / "a.txt").write_text("x" * 2000)
    (data / "sub" / "b.txt").write_text("x" * 2000)
    (data / "sub" / "deep" / "c.md").write_text("y")
    entries, skipped = walk.tree(spark, str(data))
    assert skipped == 0 and {r.path[len(str(data)) :]: r.size for r in entries.collect()} == {"/a.txt": 2000, "/sub": 0, "/sub/b.txt": 2000, "/sub/deep": 0, "/sub/deep/c.md": 1}
    assert walk.files(spark, f"file://{data}").count() == 3
    assert walk.volumes(spark.createDataFrame([("C", "", "NTFS"), ("D", "", "NTFS")], "drive string, label string, fs string"), "d:, e").count() == 1
    snapshots.save(entries, db, "walk", [str(data)])
    s = Service(spark, db)
    got = s.search("ext:txt", sort="size", desc="1")
    assert got["total"] == 2 and got["count"] == 2 and s.search("ext:txt", sort="size", desc="1")["took_ms"] == 0
    assert not s.search("ext:txt", sort="nonsense")["ok"] and not s.search("bogus:1")["ok"]
    assert s.du(str(data))["total_bytes"] == 4001 and s.du(str(data), allocated="1")["ok"] and not s.du("")["ok"]
    assert s.stats()["files"] == 3 and s.health()["ok"] and not s.refresh()
    s.changed(spark.createDataFrame([(str(data / "a.txt"),)], "path string"), spark.createDataFrame([(9, str(data / "new.txt"), 1)], "id long, path string, size long"))
    assert sorted(h["path"][-5:] for h in s.search("ext:txt")["hits"]) == ["b.txt", "w.txt"]
    out = lambda *a: (cli.main(["--db", db, "--json", *a]), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    assert out("search", "ext:txt", "--count-only")[1] == {"ok": True, "total": 2}
    assert out("du", str(data), "--depth", "1")[1]["children"][0]["size"] == 2001
    assert out("dupes", str(data))[1]["wasted_bytes"] == 2000
    assert out("stats")[1]["dirs"] == 2 and out("search", "bogus:x")[0] == 1
    assert out("index", str(data))[1]["files"] == 3


def test_cli_of_volumes(spark, tmp_path, capsys):
    data, db, inbox = tmp_path / "vol", str(tmp_path / "db"), tmp_path / "in"
    (data / "sub").mkdir(parents=True)
    (data / "sub" / "a.txt").write_text("abc")
    out = lambda *a: (cli.main(["--db", db, "--json", *a]), json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    richer = normalise(spark.createDataFrame([(0, r"E:\x.txt", 4)], "id long, path string, size long"))
    richer.write.parquet(str(tmp_path / "records"))
    code, got = out("index", f"D={data}", "--records", f"E={tmp_path / 'records'}")
    assert code == 0 and (got["method"], got["volumes"], got["files"], got["dirs"]) == ("mixed", ["D", "E"], 2, 1)
    assert out("index", f"D={data}", "--method", "usn")[0] == 1
    assert [(v["drive"], v["files"], v["bytes"]) for v in out("volumes")[1]["volumes"]] == [("D", 1, 3), ("E", 1, 4)]
    (data / "sub" / "b.txt").write_text("abcd")
    row = [("D", 50, 40, "b.txt", False, 7, J.FILE_CREATE), ("D", 40, 5, "sub", True, 6, J.FILE_CREATE)]
    spark.createDataFrame(row, J.EVENT).write.parquet(str(inbox))
    watch = ("monitor", str(inbox), "--checkpoint", str(tmp_path / "ckpt"), "--volume", "d:", "--mount", f"D={data}", "--once")
    code, got = out(*watch)
    assert code == 0 and got["drives"] == {"D": {"position": 7}} and got["pending"]["delta"] == 2
    assert out("search", "ext:txt")[1]["total"] == 3 and out("flush")[0] == 0
    assert out("monitor", str(inbox), "--checkpoint", str(tmp_path / "ckpt"), "--volume", "d:", "--once")[1]["pending"]["delta"] == 0
    (data / "sub" / "a.txt").unlink()
    assert out("rebuild", "--mount", f"D={data}")[0] == 0 and out("search", "ext:txt")[1]["total"] == 2
    assert out("rebuild", "--running")[1]["requested"] == "rebuild"


def test_build_chooses_the_most_complete(spark):
    one = lambda p: normalise(spark.createDataFrame([(0, p, 1)], "id long, path string, size long"))
    parts = [walk.Part("C", "walk", one(r"C:\w"), 3), walk.Part("c:", "mft", one(r"C:\m"), 1, 70), walk.Part("D", "usn", one(r"D:\u"), 0, 9)]
    entries, r = walk.build(parts)
    assert {x.path for x in entries.collect()} == {r"C:\m", r"D:\u"} and (r.method, r.volumes, r.skipped, r.max_usn) == ("mixed", ["C", "D"], 1, {"C": 70, "D": 9})
    assert walk.build(parts, "c", "walk")[1].method == "walk"
    with pytest.raises(ValueError):
        walk.build(parts, "x")
    assert walk.drives(" c:, D ,,c") == ["C", "D"]


def test_stored_catalogue_is_made_once_and_filters_reach_its_scan(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return normalise(spark.createDataFrame([(k, rf"D:\d{k % 3}\f{k}.rs", k) for k in range(20)], "id long, path string, size long"))

    source = str(tmp_path / "t")
    spark.range(3).write.parquet(source)
    first = snapshots.stored(spark, source, build)
    assert first.count() == 20 and snapshots.stored(spark, source, build).count() == 20 and len(made) == 1
    spark.range(4).write.mode("append").parquet(source)
    snapshots.stored(spark, source, build)
    assert len(made) == 2
    plan = lambda q: search.matching(first, q)._jdf.queryExecution().executedPlan().toString()
    for q, wanted in (("size:>1kb", "GreaterThanOrEqual(size,1024)"), ("dm:>2023-01-01", "GreaterThanOrEqual(mtime"), ("*.rs", "StringEndsWith(name_l,.rs)"), (r"parent:D:\d1", r"StringStartsWith(path_ci,d:\d1)")):
        assert wanted in plan(q).split("PushedFilters")[1].split("ReadSchema")[0], q


def s_version(spark, db):
    return snapshots.read_text(spark, f"{db}/current")


def test_http(spark, tmp_path):
    db = str(tmp_path / "db")
    snapshots.save(normalise(spark.createDataFrame([(0, r"D:\x.txt", 4), (1, r"D:\y.md", 5)], "id long, path string, size long")), db)
    s = http.server(Service(spark, db))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    get = lambda t: json.loads(urlopen(f"http://127.0.0.1:{s.server_port}{t}").read())
    assert get("/api/search?q=ext%3Atxt")["total"] == 1 and get("/api/du?path=D%3A%5C&allocated=true")["total_bytes"] == 9
    assert get("/api/feed") == {"ok": True, "watching": False, "generation": 1, "version": s_version(spark, db), "saturated": False, "removed": 0, "delta": 0}
    asked = []
    assert http.answer(None, "POST", "/api/rebuild", rebuild=lambda: asked.append(1))[1]["ok"] and asked
    with pytest.raises(HTTPError):
        urlopen(Request(f"http://127.0.0.1:{s.server_port}/api/rescan", b"", {"Origin": "http://elsewhere"}))
    assert get("/api/stats")["files"] == 2 and get("/api/health")["ok"] and not get("/api/search?q=a&desc=maybe")["ok"]
    assert http.answer(None, "GET", "/nothing")[0] == 404
    s.shutdown()
