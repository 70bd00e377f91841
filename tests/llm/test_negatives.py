"""Hard negatives: lookup scores, the whole operator against plain Python, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        T.StructField("label", T.IntegerType())])


@pytest.mark.parametrize("most", [0, 1, 127, 128, 5000, 2 ** 27])
@pytest.mark.parametrize("dim", [1, 8, 13, 64])
def test_lookups_equal_products(most, dim):
    rng = np.random.default_rng(dim)
    x, a = rng.integers(-most, most + 1, (77, dim)), rng.integers(-most, most + 1, (5, dim))
    x[0], x[1] = most, -most
    x, a = negatives._matrix(list(x), dim), negatives._matrix(list(a), dim)
    assert (negatives.scores(negatives.subset_sums(a), negatives.bit_planes(x)) == x @ a.T).all()


def test_lookups_are_exact_where_sums_pass_a_long():
    x = np.array([[2 ** 61, 2 ** 61, 2 ** 61, -2 ** 61, -2 ** 61, -2 ** 61, 7, 0]])
    a = np.array([[5, 5, 5, 5, 5, 5, 3, 1]])
    assert negatives.scores(negatives.subset_sums(a), negatives.bit_planes(x)).tolist() == [[21]]


def plain(rows, every=50):
    ok = [(i, [int(np.floor(256 * float(c))) for c in v], g) for i, v, g in rows
          if i is not None and g is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    ok = [r for r in ok if sum(c * c for c in r[1]) < 2 ** 62]
    out = []
    for i, q, g in (r for r in ok if r[0] % every == 0):
        scored = sorted((-sum(map(int.__mul__, q, v)), j, h == g) for j, v, h in ok if j != i and len(v) == len(q))
        for p, j, _ in [s for s in scored if s[2]][:5]:
            hard = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, r, k, -p, -s) for r, (s, k, _) in enumerate(hard, 1)]
    return sorted(out)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns(
        {c: F.lit("own") for c in ("row", "v", "x", "band", "rank", "score", "dim")})
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.hard_negatives(df, F.col("label"), **kw).collect())


@pytest.mark.parametrize("block", [4096, 16])
def test_negatives_equal_plain(spark, block, monkeypatch):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0.1, 0.2) for _ in range(12)], 0 if rng.random() < 0.4 else rng.randrange(4)) for i in range(160)]
    rows += [(i, list(rows[i % 40][1]), rng.randrange(3)) for i in range(200, 240)]                 # ties
    rows += [rows[0], rows[0], rows[50], (100, rows[3][1], 1), (-50, rows[4][1], 2)]               # repeated ids
    rows += [(300, None, 1), (350, [], 1), (400, [0.5] * 11 + [None], 1), (450, [0.5] * 11 + [float("nan")], 1),
             (500, [0.5] * 11 + [float("-inf")], 1), (550, [0.5] * 12, None), (None, [0.5] * 12, 1),
             (600, [1e17] + [0.1] * 11, 1), (601, [1e300] * 12, 2), (650, [0.0] * 12, 1), (700, [-0.3] * 12, 3),
             (750, [0.2] * 3, 1), (751, [0.2] * 3, 1), (752, [0.19] * 3, 2), (753, [2e5] * 3, 2), (754, [3e5] * 3, 1)]
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ANCHORS", 2 if block == 16 else 512)
    assert mined(spark, rows) == plain(rows)


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.9], 2)]) == [
        (0, 1, 1, 2, 65536, 58880), (0, 1, 2, 3, 65536, 58880)]
