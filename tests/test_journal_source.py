"""Journals as streams: positions as offsets, gaps, new journals, rebuilds from before the scan."""

import json
import struct

import pytest

from quillon.sources import journals, snapshots
from quillon.sources.catalog import normalise
from quillon.streaming import journal as J
from quillon.streaming.monitor import Monitor, request

from .test_journal import table


def packed(frn, parent, name, is_dir, usn, reason):
    text = name.encode("utf-16-le")
    length = -(-(60 + len(text)) // 8) * 8
    return struct.pack("<IHHQQqqIIIIHH", length, 2, 0, frn, parent, usn, 0, reason, 0, 0, 0x10 if is_dir else 0x20, len(text), 60) + text.ljust(length - 60, b"\0")


class Disk:
    """A journal folder of one volume."""

    def __init__(self, folder, drive, journal="one", first=0):
        self.at, self.journal, self.first, self.next = folder / drive, journal, first, first
        self.at.mkdir(parents=True, exist_ok=True)
        self.head()

    def head(self):
        (self.at / "head.json").write_text(json.dumps({"journal": self.journal, "first": self.first, "next": self.next}))

    def add(self, *records):
        usns = [self.next + 100 * k for k in range(len(records))]
        (self.at / f"{self.next:020d}.usn").write_bytes(b"".join(packed(*r[:4], u, r[4]) for r, u in zip(records, usns, strict=True)))
        self.next += 100 * len(records)
        self.head()

    def drop(self, journal=None, first=None):
        for f in self.at.glob("*.usn"):
            f.unlink()
        self.journal, self.first = journal or self.journal, self.next if first is None else first
        self.next = self.first
        self.head()


def make(name, frn):
    return frn, 5, name, False, J.FILE_CREATE


def test_offsets_partitions_and_gaps(tmp_path):
    d = Disk(tmp_path, "D", first=1000)
    for k in range(3):
        d.add(make(f"a{k}", 10 + k), make(f"b{k}", 20 + k))
    r = journals.Reader({"path": str(tmp_path), "drive": "d:"})
    assert r.initialOffset() == {"journal": "one", "usn": 1000} and r.latestOffset() == {"journal": "one", "usn": 1600}
    read = lambda a, b: [x[3] for p in r.partitions(a, b) for x in r.read(p)]
    at = lambda n, j="one": {"journal": j, "usn": n}
    assert read(at(1000), at(1600)) == ["a0", "b0", "a1", "b1", "a2", "b2"] and len(r.partitions(at(1300), at(1400))) == 1
    assert read(at(1100), at(1300)) == ["b0", "a1"] and read(at(1600), at(1600)) == []
    assert journals.Reader({"path": str(tmp_path), "drive": "D", "start": "1400"}).initialOffset() == at(1400)
    with pytest.raises(RuntimeError, match=journals.GAP):
        r.partitions(at(999), at(1600))
    d.drop("two", 0)
    d.add(make("c", 30))
    assert read(at(1600), r.latestOffset()) == ["c"]


def test_monitor_follows_heals_and_resyncs(spark, tmp_path):
    root, folder = str(tmp_path / "db"), tmp_path / "usn"
    snapshots.save(normalise(spark.createDataFrame([(0, "D:\\d.txt", 1), (1, "E:\\e.txt", 1)], "id long, path string, size long")), root, "mft", ["D", "E"])
    d, e = Disk(folder, "D"), Disk(folder, "E", first=500)
    there, scans = {"D:\\d.txt": 1, "E:\\e.txt": 1}, []

    def rescan(letters):
        scans.append(letters)
        if broken:
            raise OSError("no such mount")
        return normalise(spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate(there.items()) if p[0] in letters], "id long, path string, size long"))

    broken, m = False, Monitor(spark, root, lambda paths: table(spark, there), flush_secs=3600, rescan=rescan)
    paths = lambda: {r.path for r in m.live().collect()}
    settle = lambda: [q.processAllAvailable() for q, _ in m.streams.values() if q.isActive]
    m.watch(str(folder), ["D:", "e"], str(tmp_path / "ckpt"), "1 second")
    there |= {"D:\\new.txt": 2, "E:\\new.txt": 3}
    d.add(make("new.txt", 50))
    e.add(make("new.txt", 50))
    settle()
    assert paths() == set(there) and m.status()["drives"] == {"D": {"position": 0}, "E": {"position": 500}} and scans == []
    # the journal of D drops records that were not read
    there["D:\\lost.txt"] = 4
    m.streams["D"][0].stop()
    d.add(make("lost.txt", 51))
    d.drop()
    assert m.tick() is None and scans == [["D"]] and paths() == set(there) and m.status()["drives"]["D"]["position"] == d.next
    m.streams["D"] = (m.streams["D"][1](), m.streams["D"][1])
    there["D:\\later.txt"] = 5
    d.add(make("later.txt", 52))
    settle()
    assert paths() == set(there)
    # that of E is made anew: scanned again, and read on from where it was before the scan
    there["E:\\between.txt"] = 6
    e.drop("two", 7)
    e.add(make("between.txt", 60))
    assert m.tick() is None and scans == [["D"], ["E"]] and paths() == set(there) and m.status()["drives"]["E"]["position"] == e.next
    # a request that fails ends nothing and is told
    broken = True
    request(spark, root, "rebuild")
    assert m.tick() == "rebuild" and m.status()["faults"] == {"rebuild": "no such mount"} and paths() == set(there)
    for q, _ in m.streams.values():
        q.stop()
