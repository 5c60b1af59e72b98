"""Folds that write only the files which a change falls into."""

import pytest
from pyspark.sql import functions as F

from quillon.sources import snapshots
from quillon.sources.catalog import normalise
from quillon.streaming import pending


@pytest.fixture
def many_files(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def entries(spark, n):
    k = F.col("id")
    return normalise(spark.range(n).select("id", F.concat(F.lit("D:\\d"), F.lpad((k % 1000).cast("string"), 4, "0"), F.lit("\\F"), k.cast("string")).alias("path"), k.alias("size")))


def names(spark, root):
    return {f["file"] for f in snapshots.manifest(spark, root, snapshots.read_text(spark, f"{root}/current"))}


def test_a_fold_of_a_million_rewrites_the_files_hit(spark, tmp_path, many_files):
    root = str(tmp_path / "db")
    snapshots.save(entries(spark, 1_000_000), root, "mft", ["D"])
    before = names(spark, root)
    # a hundred changes in two directories
    removed = spark.createDataFrame([(f"d:\\D0007\\f{7 + 1000 * k}",) for k in range(50)] + [("D:\\d0500\\none",)], "path string")
    delta = spark.createDataFrame([(0, f"D:\\d0900\\new{k}", 5) for k in range(50)], "id long, path string, size long")
    snapshots.fold(spark, root, removed, delta)
    after = names(spark, root)
    assert len(before) == 24 and 21 <= len(before & after) < 24 and len(after - before) <= 3
    now = snapshots.load(spark, root)
    assert now.count() == 1_000_000 and now.agg(F.count_distinct("id")).first()[0] == 1_000_000
    assert {r.path for r in now.where("id >= 1000000").collect()} == {f"D:\\d0900\\new{k}" for k in range(50)}
    assert now.where(F.col("path_ci").startswith("d:\\d0007\\")).count() == 950
    meta = snapshots.read_meta(spark, root)
    assert (meta["files"], meta["dirs"], meta["volumes"]) == (1_000_000, 0, ["D"])
    files = snapshots.manifest(spark, root, snapshots.read_text(spark, f"{root}/current"))
    assert all(a["most"] < b["least"] for a, b in zip(files, files[1:], strict=False))


def test_folds_upon_folds_equal_plain_ones(spark, tmp_path, many_files):
    root, want = str(tmp_path / "db"), {}
    snapshots.save(entries(spark, 3000), root)
    want = {r.path.lower(): r["size"] for r in snapshots.load(spark, root).collect()}
    for k in range(3):
        gone = [p for i, p in enumerate(sorted(want)) if i % 211 == k]
        new = [(f"C:\\x{k}", 1), (f"D:\\d0500\\G{k}", 2), (f"z:\\é{k}", 3), (gone[0].upper(), 4)]
        snapshots.fold(spark, root, spark.createDataFrame([(p,) for p in gone], "path string"), spark.createDataFrame([(0, *x) for x in new], "id long, path string, size long"))
        want = {p: n for p, n in want.items() if p not in gone} | {"".join(c.lower() if c.isascii() else c for c in p): n for p, n in new}
        got = snapshots.load(spark, root).collect()
        assert {r.path_ci: r["size"] for r in got} == want and len({r.id for r in got}) == len(got) == len(want)
    version = snapshots.read_text(spark, f"{root}/current")
    nothing = spark.createDataFrame([], "path string")
    assert snapshots.fold(spark, root, nothing, snapshots.load(spark, root).where("false")) == version
    every = snapshots.load(spark, root).select("path")
    snapshots.fold(spark, root, every, snapshots.load(spark, root).where("false"))
    assert snapshots.load(spark, root).isEmpty()
    snapshots.fold(spark, root, nothing, entries(spark, 5))
    assert snapshots.load(spark, root).count() == 5


def test_folders_stay_while_a_manifest_lists_their_files(spark, tmp_path, many_files, monkeypatch):
    root = str(tmp_path / "db")
    first = snapshots.save(entries(spark, 3000), root)
    monkeypatch.setattr(pending, "KEEP", -1)
    s = pending.read(spark, root)
    second = snapshots.fold(spark, root, spark.createDataFrame([("D:\\d0000\\F0",)], "path string"), entries(spark, 0))
    pending.write(spark, root, s | {"base": second}, s)
    assert snapshots.load(spark, root).count() == 2999 and (tmp_path / "db" / first).exists()
    s = pending.read(spark, root)
    third = snapshots.save(snapshots.load(spark, root), root)
    pending.write(spark, root, s | {"base": third}, s)
    assert snapshots.load(spark, root).count() == 2999 and not (tmp_path / "db" / first).exists() and not (tmp_path / "db" / second).exists()


def test_tables_of_a_batch_do_not_stay(spark, tmp_path):
    import os

    from quillon.sources import scratch
    from quillon.streaming import journal as J
    from quillon.streaming.monitor import Monitor

    from .test_journal import events_of, table

    root, shared = str(tmp_path / "db"), scratch.folder(spark)
    snapshots.save(normalise(spark.createDataFrame([(0, "D:\\d", True, 10), (1, "D:\\d\\f", False, 11)], "id long, path string, is_dir boolean, frn long")), root)
    m = Monitor(spark, root, lambda paths: table(spark, {"D:\\e": 0, "D:\\e\\f": 1, "D:\\e\\g": 2}), flush_secs=0)
    before = set(os.listdir(shared.removeprefix("file:")))
    m.apply_batch(events_of(spark, (10, 5, "d", True, 1, J.RENAME_OLD), (10, 5, "e", True, 2, J.RENAME_NEW), (12, 10, "g", False, 3, J.FILE_CREATE)), 0)
    assert {r.path for r in m.live().collect()} == {"D:\\e", "D:\\e\\f", "D:\\e\\g"}
    assert set(os.listdir(shared.removeprefix("file:"))) == before
