"""Query op3: the 20 nearest vectors of every twentieth one."""

from pyspark.sql import functions as F

from quillon.llm import graph_search
from quillon.llm.common import table


def op3_graph_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_search.nearest(rows, F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op3_graph_search": op3_graph_search}
SQL: dict[str, str] = {}
