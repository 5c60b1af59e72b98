"""Tables between the steps of one query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Local sessions that name none get a temporary
    one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders written since the oldest open :func:`passing` of a thread, if there is one.
_written = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end: for work whose result is stored elsewhere by then."""
    if getattr(_written, "paths", None) is not None:  # the outer one deletes
        yield
        return
    _written.paths = []
    try:
        yield
    finally:
        paths, _written.paths = _written.paths, None
        for path in paths:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_written, "paths", None) is not None:
        _written.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
