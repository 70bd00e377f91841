import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def prose(seed, n=120, vocabulary=400, lines=6):
    rng = random.Random(seed)
    w = [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]
    step = max(1, n // lines)
    return "\n".join(" ".join(w[k:k + step]) for k in range(0, n, step))


def edge_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies."""
    base = prose(1)
    swapped = base.split(" ")
    swapped[5] = "changed"
    rows = [(k, prose(10 + k), "en", f"src{k % 3}", 7) for k in range(1, 31)]
    rows += [(31, base, "en", "src0", 1), (32, base, None, "src1", None), (33, " ".join(swapped), "en", None, 3),
             (34, None, "en", "src1", None), (35, "", "de", "src1", 0), (36, " \t\n ", "de", "src2", 3),
             (37, "one", "fr", "src2", 3), (38, "ONE", "fr", "src2", 3), (39, "éé ö \U0001f600 <|endoftext|>", "fr", "src2", 3),
             (40, prose(2, 6000, lines=100), "en", "src0", 3), (41, "same line again\n" * 40, "en", "src0", 3),
             (None, prose(3), None, None, None), (None, prose(4), "en", "src0", None),
             (42, prose(5), "en", "src0", 3), (42, prose(5), "en", "src0", 3), (42, prose(6), "en", "src0", 3),
             (43, "a" * 5000, "en", "src0", 3)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
