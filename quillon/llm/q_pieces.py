"""Query op2: all documents encoded and decoded again."""

from quillon.llm import pieces
from quillon.llm.common import table


def op2_sentencepiece(spark, sf_dir):
    return pieces.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
SQL: dict[str, str] = {}
