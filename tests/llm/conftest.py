import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with the other columns and some whose names clash with outputs."""
    def make(rows, clash=False):
        full = [(i, t, "en" if k % 2 else None, "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        if clash:
            for name in ("spans", "kept", "score", "length", "sequence_id", "shard", "slot", "size", "sign", "tree", "key", "w", "piece", "_at", "_hd", "n"):
                df = df.withColumn(name, df["doc_id"].cast("string"))
        return df

    return make
