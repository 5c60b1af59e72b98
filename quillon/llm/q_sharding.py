"""Query op6: documents in eight shards of near equal bytes."""

from pyspark.sql import functions as F

from quillon.llm.common import table
from quillon.llm.sharding import shard_by_bytes


def op6_histogram_sort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = shard_by_bytes(docs.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")))), 8)
    return keyed.select(
        "doc_id", F.col("_size").alias("size"), F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op6_histogram_sort": op6_histogram_sort}
SQL: dict[str, str] = {}
