"""Change journals as a streaming source whose offsets are positions.

A journal is a folder per volume: ``head.json`` (journal: its identity, first: the oldest position it
still holds, next: the position after its last record) and segments ``<first usn of it>.usn`` of binary
records as a volume gives them. The folder must be mounted where tasks run, as for walks and probes.

``quillon_journal`` reads one volume. Options: path, drive, start (a position; else the first). A stream
whose position the journal no longer holds fails with :data:`GAP` in its message; one under which the
journal is made anew goes on with the first record of the new one.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillon.sources.records import journal_records

FORMAT = "quillon_journal"
GAP = "the journal has lost records"
SCHEMA = "drive string, frn long, parent_frn long, name string, is_dir boolean, usn long, reason long"


class Segment(InputPartition):
    def __init__(self, file: str, first: int, following: int):
        self.file, self.first, self.following = file, first, following


class Journal(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return Reader(self.options)


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.drive = options["drive"].upper().rstrip(":")
        self.folder = Path(options["path"]) / self.drive
        self.start = options.get("start")

    def _head(self) -> dict:
        return json.loads((self.folder / "head.json").read_text())

    def initialOffset(self) -> dict:
        head = self._head()
        return {"journal": head["journal"], "usn": int(self.start) if self.start else head["first"]}

    def latestOffset(self) -> dict:
        head = self._head()
        return {"journal": head["journal"], "usn": head["next"]}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        head = self._head()
        first = start["usn"] if start["journal"] == end["journal"] else head["first"]
        if first < head["first"]:
            raise RuntimeError(f"{GAP}: {self.drive}: stands at {first}, the journal begins at {head['first']}")
        files = sorted((int(f.stem), str(f)) for f in self.folder.glob("*.usn"))
        at = max(0, bisect_right([k for k, _ in files], first) - 1)
        return [Segment(f, first, end["usn"]) for k, f in files[at:] if k < end["usn"]]

    def read(self, part: Segment):
        for frn, parent, name, is_dir, usn, reason in journal_records(Path(part.file).read_bytes()):
            if part.first <= usn < part.following:
                yield self.drive, frn, parent, name, is_dir, usn, reason

    def commit(self, end: dict) -> None:
        """Nothing: the journal drops old records by itself."""


def stream(spark: SparkSession, folder: str, drive: str, start: int | None = None) -> DataFrame:
    """The events of a volume from a position on (else from the first record)."""
    spark.dataSource.register(Journal)
    reader = spark.readStream.format(FORMAT).option("path", folder).option("drive", drive)
    return (reader if start is None else reader.option("start", str(start))).load()


def bounds(spark: SparkSession, folder: str) -> DataFrame:
    """drive, journal, first, following: what each journal of the folder holds."""
    heads = spark.read.schema("journal string, first long, next long").json(f"{folder}/*/head.json")
    return heads.select(F.upper(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/head\.json$", 1)).alias("drive"), "journal", "first", F.col("next").alias("following"))
