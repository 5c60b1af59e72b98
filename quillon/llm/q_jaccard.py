"""Query op9: similarity classes of all documents."""

from quillon.llm import jaccard
from quillon.llm.common import table


def op9_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
SQL: dict[str, str] = {}
