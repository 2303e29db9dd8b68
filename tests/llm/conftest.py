import os
import sys

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
    # names the operators use inside
    StructField("h", StringType()), StructField("n", LongType()), StructField("keep", StringType()), StructField("words", StringType()),
])


@pytest.fixture
def make_docs(spark):
    def run(rows):
        data = [(i, t, "en", "src", len(t) if t is not None else None, "x", 1, None, "y") for i, t in rows]
        return spark.createDataFrame(data, DOCS)

    return run
