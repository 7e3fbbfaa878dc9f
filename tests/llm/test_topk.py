import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import topk
from evidex.llm.topk import exact_topk


def brute(rows, k):
    ok = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block, size", [(4096, 1), (8, 1), (8, 300)])
def test_against_brute_force(spark, monkeypatch, block, size):
    """Small blocks; components of many cells' width; copies of one vector, more than k."""
    monkeypatch.setattr(topk, "QUERIES", block)
    monkeypatch.setattr(topk, "VECTORS", 16 * block)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, size, 8)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 470)]  # ties
    rows += [(500, None), (520, [1.0] * 7 + [None]), (540, [1.0] * 7 + [float("nan")]), (560, [1.0] * 7 + [float("inf")]), (580, [0.0] * 8), (600, []), (620, [1.0, 2.0]), (621, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x")).withColumn("rank", F.lit("x")).repartition(5)
    got = exact_topk(df, F.col("vec_id") % 20 == 0, 20)
    assert {tuple(r) for r in got.collect()} == brute(rows, 20)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in exact_topk(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 64 + 128 * 64)]
    assert exact_topk(df.limit(0), F.lit(True)).count() == 0


def test_bounds_hold_and_few_exact_vectors_are_read(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 4000, (20, 32))
    vectors = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 400, (4000, 32))).astype(np.int64)
    low, high = topk.bounds(vectors[:50].astype(float), *topk.cells_of(vectors))
    exact = vectors[:50] @ vectors.T
    assert (low <= exact).all() and (exact <= high).all()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "_id bigint, _v array<bigint>")
    found = topk.scanned(topk.approximated(df, 10), df.where("_id < 20"), 10, 4000, 20)
    assert found.count() < 20 * 400


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [9.0, 9.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in exact_topk(df, F.lit(True)).orderBy("query_id").collect()] == [(0, 1, 1, 8192), (1, 1, 0, 8192)]
