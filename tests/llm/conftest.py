"""Small tables with what operators must bear: NULLs, empty and long texts, repeated rows, clashing columns."""
import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("TEXT", T.StringType()),
                          T.StructField("kept", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts or (doc_id, text) pairs, with columns whose names clash."""
    def make(rows, partitions=3):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, "en", "s", None if t is None else len(t), "other", "other") for i, t in pairs]
        return spark.createDataFrame(data, DOCUMENTS).repartition(partitions) if data else spark.createDataFrame([], DOCUMENTS)
    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, repeatable."""
    import random

    def make(seed, n, vocabulary=3000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary):x}{r.choice(['', '', '', '.', ','])}" for _ in range(n))
    return make
