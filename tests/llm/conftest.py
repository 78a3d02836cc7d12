import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta. " * 4000


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    same = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen.\nA b c d.\nE f g h.\n"
    rows = [
        (1, same, "en", "a", 1), (2, same, None, "a", None), (2, same, None, "a", None), (3, None, "en", None, 0), (4, "", None, "b", 0),
        (None, "lonely words here", "en", "b", 3), (None, None, None, None, None), (5, LONG, "en", "a", 9), (6, LONG + "omega", "en", "c", 9),
        (7, "   \n\t ", "en", "c", 1), (7, same + "tail", "en", "a", 1), (8, "école 日本 ünïcode \\ [INST] </s>", "fr", "a", 1),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("row", "_doc", "_alt", "shard", "slot", "score", "h", "node", "s", "key", "_k", "size", "times"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
