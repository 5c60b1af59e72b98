"""Versioned snapshots of a catalogue and their provenance.

A snapshot is a directory of Parquet per version; a small pointer file names the current one and
is replaced last, so readers see a whole version or the one before. A version that :func:`fold` made
is a manifest instead: a list of files, its own and those of versions before it, with the least and
the largest folded path of each. Files go through Spark's writers and Hadoop's file system, so any
store that Spark reaches will do.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.paths import fold_path
from quillon.sources.catalog import SCHEMA, normalise, numbered, with_derived
from quillon.sources.scratch import folder

#: How complete a way of building is (fixed values); what has none of these counts 0.
RANKS = {"mft": 3, "usn": 2, "walk": 1}


class DegradeError(RuntimeError):
    """A poorer snapshot would replace a better one."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename over, in one step: readers find the old text or the new one."""
    fs, target = _path(spark, path)
    _, beside = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    target = fs.makeQualified(target)
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), target, over)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def read_json(spark: SparkSession, path: str) -> dict | None:
    """What a JSON file holds; None if it is missing or torn."""
    return _json(read_text(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def _json(text: str | None) -> dict | None:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def read_meta(spark: SparkSession, root: str) -> dict | None:
    """How the current snapshot was built; None if that is not known."""
    return _json(read_text(spark, f"{root}/meta.json"))


def rank(method: str | None) -> int:
    return RANKS.get((method or "").lower(), 0)


def save(catalog: DataFrame, root: str, method: str = "mft", volumes: list[str] | None = None, skipped: int = 0, force: bool = False) -> str:
    """Write a new version with the derived columns, in ranges of the folded path, and point to it:
    files and row groups of other subtrees are skipped by their statistics.

    A method of a lower rank than that of the current snapshot is refused unless ``force``.
    """
    spark, began = catalog.sparkSession, time.time()
    before = read_meta(spark, root)
    if before and rank(before.get("method")) > rank(method) and not force:
        raise DegradeError(f"{method} would replace {before['method']}")
    version = f"v_{uuid.uuid4().hex}"
    with_derived(normalise(catalog)).repartitionByRange("path_ci").sortWithinPartitions("path_ci").write.parquet(f"{root}/{version}")
    write_text(spark, f"{root}/current", version)
    kept = spark.read.parquet(f"{root}/{version}")
    n = kept.agg(F.count("*").alias("all"), F.count_if("is_dir").alias("dirs")).first()
    _write_meta(spark, root, {"method": method, "volumes": volumes or [], "skipped": skipped}, n["all"], n.dirs, began)
    return version


def _write_meta(spark: SparkSession, root: str, meta: dict, rows: int, dirs: int, began: float) -> None:
    more = {"files": rows - dirs, "dirs": dirs, "elapsed_ms": int(1000 * (time.time() - began)), "built_at_unix": int(time.time())}
    write_text(spark, f"{root}/meta.json", json.dumps(meta | more))


#: Rows that a file of a fold has at most, nearly.
FILE_ROWS = 1_000_000


def _below() -> Column:
    """A row's file, from the folder of its version on."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/([vm]_[0-9a-f]{32}/.*)$", 1)


def _measured(spark: SparkSession, root: str, version: str) -> list[dict]:
    """For each file of a folder: file (below ``root``), least and largest folded path, rows and directories among them."""
    # with a schema, as a folder of no rows has no files
    df = spark.read.schema(with_derived(spark.createDataFrame([], SCHEMA)).schema).parquet(f"{root}/{version}")
    found = df.groupBy(_below().alias("file")).agg(F.min("path_ci").alias("least"), F.max("path_ci").alias("most"), F.count("*").alias("rows"), F.count_if("is_dir").alias("dirs"))
    return [r.asDict() for r in found.collect()]  # a row a file


def manifest(spark: SparkSession, root: str, version: str) -> list[dict]:
    """The files of a version in order of their ranges. A version without a manifest is measured."""
    text = read_text(spark, f"{root}/{version}.manifest")
    files = [json.loads(x) for x in text.split("\n") if x] if text is not None else _measured(spark, root, version)
    return sorted(files, key=lambda f: (f["least"].encode(), f["file"]))


def folders(spark: SparkSession, root: str, version: str | None) -> set[str]:
    """Names of the folders that hold files of a version."""
    text = read_text(spark, f"{root}/{version}.manifest") if version else None
    return {version} | {json.loads(x)["file"].split("/")[0] for x in (text or "").split("\n") if x}


def places(keys: DataFrame, files: list[dict]) -> DataFrame:
    """``keys(path_ci, ...)`` with _place: the number of the file in whose range a key is, or before whose
    successor's range; and _inside, whether the range holds it. Ranges of sorted files overlap in one path at most."""
    from bisect import bisect_right

    least, most = [f["least"].encode() for f in files], [f["most"].encode() for f in files]
    schema = T.StructType([*keys.schema.fields, T.StructField("_place", T.IntegerType()), T.StructField("_inside", T.BooleanType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [max(0, bisect_right(least, k.encode()) - 1) for k in batch.column("path_ci").to_pylist()]
            inside = [least[i] <= k.encode() <= most[i] for i, k in zip(found, batch.column("path_ci").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32()), pa.array(inside, pa.bool_())], names=schema.names)

    return keys.mapInArrow(run, schema)


def fold(spark: SparkSession, root: str, removed: DataFrame, delta: DataFrame) -> str:
    """A new version: the current one without the paths of ``removed(path)``, with the entries ``delta``.

    Only files in whose range a change falls are read and written anew; the manifest takes the others as they
    are. Entries keep their ids, new ones follow the largest (by path): ids stay unique and in the order
    of arrival, but are not dense; a whole :func:`save` renews them. A version that nothing changes stays.
    """
    began, version = time.time(), read_text(spark, f"{root}/current")
    if "path_ci" not in _files(spark, root, version).columns:
        upgrade(spark, root)
        version = read_text(spark, f"{root}/current")
    files = manifest(spark, root, version)
    if not files:
        meta = read_meta(spark, root) or {}
        return save(delta, root, meta.get("method", "mft"), meta.get("volumes"), meta.get("skipped", 0), force=True)
    fresh, gone = with_derived(normalise(delta)), removed.select(fold_path("path").alias("path_ci")).distinct()
    asked = places(gone.select("path_ci", F.lit(True).alias("gone")).union(fresh.select("path_ci", F.lit(False))), files).where("_inside OR NOT gone")
    hit = {r[0] for r in asked.select("_place").distinct().collect()}  # no more than there are files
    # the same path can end one file and begin the next
    hit |= {i for i in range(len(files)) for j in (i - 1, i + 1) if j in hit and 0 <= j < len(files) and {files[i]["least"], files[i]["most"]} & {files[j]["least"], files[j]["most"]}}
    if not hit:
        return version
    old = spark.read.parquet(*[f"{root}/{files[i]['file']}" for i in sorted(hit)]).withColumn("file", _below())
    old = old.join(F.broadcast(spark.createDataFrame([(files[i]["file"], i) for i in sorted(hit)], "file string, _place int")), "file").drop("file")  # a row a file
    kept = old.join(gone, "path_ci", "left_anti")
    top = load(spark, root, version).agg(F.max("id")).first()[0]
    new = places(with_derived(numbered(fresh, ["path"], (top if top is not None else -1) + 1)), files)
    name = f"m_{uuid.uuid4().hex}"
    # what was one file stays one, or becomes several in order: ranges keep apart
    out = kept.select(*old.columns).unionByName(new.select(*old.columns)).repartition("_place").sortWithinPartitions("_place", "path_ci")
    out.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_place").parquet(f"{root}/{name}")
    every = [f for i, f in enumerate(files) if i not in hit] + _measured(spark, root, name)
    write_text(spark, f"{root}/{name}.manifest", "\n".join(json.dumps(f) for f in every))
    write_text(spark, f"{root}/current", name)
    _write_meta(spark, root, read_meta(spark, root) or {}, sum(f["rows"] for f in every), sum(f["dirs"] for f in every), began)
    return name


def load(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The current version, or the one named. Ones that lack derived columns or allocated sizes get them (the latter: sizes)."""
    version = version or read_text(spark, f"{root}/current")
    if version is None:
        raise FileNotFoundError(root)
    df = _files(spark, root, version)
    return df if {"name_l", "path_ci", "allocated"} <= set(df.columns) else with_derived(normalise(df))


def _files(spark: SparkSession, root: str, version: str) -> DataFrame:
    text = read_text(spark, f"{root}/{version}.manifest")
    if text is None:
        return spark.read.parquet(f"{root}/{version}")
    files = [f"{root}/{json.loads(x)['file']}" for x in text.split("\n") if x]
    return spark.read.parquet(*files) if files else with_derived(spark.createDataFrame([], SCHEMA))


def stored(spark: SparkSession, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The catalogue that ``build`` makes of the files at ``source``, kept as a snapshot in the shared
    folder and made anew when their number, bytes or time of change do. Filters reach its scan."""
    fs, p = _path(spark, source)
    held = fs.getContentSummary(p)
    mark = f"{fs.makeQualified(p)}|{held.getFileCount()}|{held.getLength()}|{fs.getFileStatus(p).getModificationTime()}"
    root = f"{folder(spark)}/catalogue-{hashlib.md5(mark.encode()).hexdigest()}"
    try:
        return load(spark, root)
    except FileNotFoundError:
        save(build(), root)
        return load(spark, root)


def upgrade(spark: SparkSession, root: str) -> bool:
    """Rewrite a version that lacks columns; False if there is nothing to do."""
    version = read_text(spark, f"{root}/current")
    have = set(_files(spark, root, version).columns)
    if {"name_l", "path_ci", "allocated"} <= have:
        return False
    meta = read_meta(spark, root) or {}
    save(load(spark, root), root, meta.get("method", "mft"), meta.get("volumes"), meta.get("skipped", 0), force=True)
    return True


def read_positions(spark: SparkSession, root: str) -> dict[str, int]:
    """Journal positions by drive."""
    return {k: int(v) for k, v in (_json(read_text(spark, f"{root}/positions.json")) or {}).items()}


def write_positions(spark: SparkSession, root: str, positions: dict[str, int]) -> None:
    """Other drives keep theirs."""
    write_text(spark, f"{root}/positions.json", json.dumps(read_positions(spark, root) | positions))
