"""Query op7: toxicity of all documents; every fifth (by checksum of the id) is held out."""

from pyspark.sql import functions as F

from quillon.llm import toxicity as X
from quillon.llm.common import table


def op7_lexicon_automata(spark, sf_dir):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon, weights = X.train_model(docs, labels.where(~held))
    return X.score(docs.withColumn("held_out", held), lexicon, weights).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op7_lexicon_automata": op7_lexicon_automata}
SQL: dict[str, str] = {}
