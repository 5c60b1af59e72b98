"""Query op5: personal data in all documents."""

from quillon.llm import pii
from quillon.llm.common import table


def op5_disclosure_spans(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_disclosure_spans": op5_disclosure_spans}
SQL: dict[str, str] = {}
