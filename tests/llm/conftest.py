import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    T.StructField("chunk", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("position", T.StringType()),
])
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 13}" for i in range(60))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash with inner ones."""

    def make(pairs):
        rows = [Row(doc_id=i, text=t, lang="en", source=None, n_chars=len(t) if t else 0, chunk="c", fingerprint="f", position="p") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def hard_pairs():
    """Nulls, empty and blank texts, a very long one, copies, near copies, repeated rows, a null doc_id."""
    near = BASE.replace("alpha7 ", "ALPHA7 ").replace("alpha30", "other")
    return [
        (1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, LONG), (6, BASE), (7, near), (8, BASE), (9, "one two"), (10, "One  two"),
        (11, "a"), (11, "a"), (12, "päss wörd ééé 文字 end"), (13, "password = abcdefghijkl0123"), (None, BASE), (None, None),
        (14, BASE + " tail"), (15, "AKIA" + "Z" * 20 + " 0123456789abcdef0123"), (16, LONG + " x"),
    ]
