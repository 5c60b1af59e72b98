import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{k % 97}" for k in range(30_000))


def documents():
    """Nulls in every column, empty and very long texts, repeated rows, ties."""
    prose = "It was the best of times and it was the worst of times for all of them in the old town by the sea where "
    rows = [(k, prose + " ".join(f"word{(k * j) % 41}" for j in range(80)), "en", "a") for k in range(1, 30)]
    rows += [(30, None, "en", "a"), (31, "", None, "b"), (32, " \n\t ", "en", None), (None, prose * 4, "en", "a"), (None, None, None, None), (33, LONG, "xx", "b"), (34, "tiny", "en", "c"),
             (1, rows[0][1], "en", "a"), (35, rows[4][1], "de", "c"), (36, rows[4][1], "de", "c")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string")
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    # names that operators add or use inside
    return df.withColumns({"score": F.lit("x"), "Kept": F.lit(1), "shard": F.lit(9), "copy": F.lit("c"), "spans": F.lit(0), "_digest": F.lit(1), "_text": F.lit(2), "ids": F.lit(3), "odd name": F.lit(4)}).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
