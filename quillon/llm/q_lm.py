"""Query op1: all documents scored by a language model that learns from six sevenths of them."""

from pyspark.sql import functions as F

from quillon.llm import lm
from quillon.llm.common import table


def op1_recurrent_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)
    return lm.score(docs, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_recurrent_lm": op1_recurrent_lm}
SQL: dict[str, str] = {}
