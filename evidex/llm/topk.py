"""Exact top-k inner-product search over vector-approximation files.

Each vector has an approximation: a step and one signed byte a component, the cell
the component lies in.  They are written once, in a table of their own columns.  The
scan reads cells only: for a query, a vector's cells bound its score from below and
above.  The k-th highest lower bound that a query meets anywhere is a score it is
sure to reach, so vectors whose upper bound stays below it are out.  Exact vectors
are read only for what is left and whose bounds differ, by a join on their ids.

Queries and vectors meet in a grid of blocks (QUERIES x VECTORS): a block pair gives
back what its own k-th lower bound leaves.  Copies of a vector beyond the k + 1
smallest ids can be in no result and are left out before the scan.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Queries and vectors of a block, and queries whose bounds are held at once.
QUERIES, VECTORS, CHUNK = 4096, 65_536, 64


def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step of each integer vector and its components' cells, floor(component / step), in a signed byte."""
    most = np.maximum(vectors.max(1), -1 - vectors.min(1)) if vectors.shape[1] else np.zeros(len(vectors), np.int64)
    step = most // 128 + 1
    return step, np.floor_divide(vectors, step[:, None]).astype(np.int8)


def bounds(queries: np.ndarray, step: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each query (rows) with each vector of these cells; whole numbers in doubles, exact below 2**53."""
    base = (queries @ cells.T.astype(np.float64)) * step
    slack = step - 1.0
    return base + np.minimum(queries, 0).sum(1)[:, None] * slack, base + np.maximum(queries, 0).sum(1)[:, None] * slack


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """_id and _v, floor(scale * x) as long of each component; without vectors that are null, empty or hold a null, NaN or infinity."""
    x = F.col(vec_col)
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("bigint").alias("_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("_v"))


def approximated(rows: DataFrame, k: int) -> DataFrame:
    """The table of approximations: _id, _n (length), _step, _cells and _v; at most k + 1 of equal vectors, those of the smallest ids."""
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_v").orderBy("_id"))).where(F.col("_r") <= k + 1).select("_id", "_v")

    def approximate(batches):
        for batch in batches:
            length = batch.column(1).value_lengths().to_numpy()
            for n in np.unique(length):
                part = batch.take(pa.array(np.flatnonzero(length == n)))
                step, cells = cells_of(part.column(1).flatten().to_numpy().reshape(-1, n))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(step), n, np.int32)), pa.array(step), pa.array([c.tobytes() for c in cells], pa.binary()), part.column(1)], names=["_id", "_n", "_step", "_cells", "_v"])

    return written(first.mapInArrow(approximate, "_id bigint, _n int, _step bigint, _cells binary, _v array<bigint>"), "va-cells")


def scanned(cells: DataFrame, wanted: DataFrame, k: int, n_vectors: int, n_queries: int) -> DataFrame:
    """query_id, vec_id, low and high: bounds of all pairs that can be among a query's k best."""
    rows, columns = max(1, math.ceil(n_queries / QUERIES)), max(1, math.ceil(n_vectors / VECTORS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    nothing = F.lit(None)
    left = cells.select("_id", "_n", "_step", "_cells", nothing.cast("array<bigint>").alias("_v"), block(columns).alias("_j"), spread(rows).alias("_i"))
    right = wanted.select("_id", F.size("_v").alias("_n"), nothing.cast("bigint").alias("_step"), nothing.cast("binary").alias("_cells"), "_v", block(rows).alias("_i"), spread(columns).alias("_j"))

    def met(table: pa.Table) -> pa.Table:
        is_query = pa.compute.is_null(table["_step"])
        q, v = table.filter(is_query), table.filter(pa.compute.invert(is_query))
        found = []
        if len(q) and len(v):
            n = q["_n"][0].as_py()
            vectors = q["_v"].combine_chunks().flatten().to_numpy().reshape(-1, n).astype(np.float64)
            ids, own = q["_id"].to_numpy(), v["_id"].to_numpy()
            cells = np.frombuffer(b"".join(v["_cells"].to_pylist()), np.int8).reshape(-1, n)
            step = v["_step"].to_numpy().astype(np.float64)
            for at in range(0, len(ids), CHUNK):
                low, high = bounds(vectors[at : at + CHUNK], step, cells)
                for i, query in enumerate(ids[at : at + CHUNK]):
                    low[i, own == query] = high[i, own == query] = -np.inf
                    sure = np.partition(low[i], len(own) - k)[len(own) - k] if len(own) >= k else -np.inf
                    some = np.flatnonzero((high[i] >= sure) & (high[i] > -np.inf))
                    known = some[low[i, some] == high[i, some]]  # of those whose score is known no more than k
                    best = known[np.lexsort((own[known], -low[i, known]))[:k]]
                    some = np.concatenate((best, some[low[i, some] < high[i, some]]))
                    found.append((np.full(len(some), query), own[some], low[i, some].astype(np.int64), high[i, some].astype(np.int64), np.full(len(some), max(sure, -(2.0**53)), np.float64)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "low", "high", "sure"])

    pairs = left.unionByName(right).groupBy("_n", "_i", "_j").applyInArrow(met, "query_id bigint, vec_id bigint, low bigint, high bigint, sure double")
    return pairs.withColumn("sure", F.max("sure").over(Window.partitionBy("query_id"))).where("high >= sure").drop("sure")


def exact_topk(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k best other rows by integer inner product.

    `queries`: condition that chooses the query rows.  Ties go to the smaller id;
    fewer rows than k: all.  Rows whose vector is null, empty or holds null or
    non-finite components, or whose id is null, take no part; only vectors of equal
    length are compared.  Rows that repeat an id are one vector, the smallest of
    theirs; a query never meets its own id.  An empty table gives an empty result;
    extra columns have no effect.  Scores are exact while scale * component *
    component * length stays below 2**53.
    """
    rows = quantised(vectors, id_col, vec_col, scale).groupBy("_id").agg(F.min("_v").alias("_v"))
    cells = approximated(rows, k)
    wanted = written(quantised(vectors.where(queries), id_col, vec_col, scale).groupBy("_id").agg(F.min("_v").alias("_v")), "va-queries")
    found = written(scanned(cells, wanted, k, cells.count(), wanted.count()), "va-found")
    # exact vectors, where the bounds leave the score open
    dot = F.aggregate(F.zip_with("_q", "_v", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    open_ = found.where("low < high").join(cells.select(F.col("_id").alias("vec_id"), "_v"), "vec_id").join(wanted.select(F.col("_id").alias("query_id"), F.col("_v").alias("_q")), "query_id")
    scores = found.where("low = high").select("query_id", "vec_id", F.col("low").alias("score")).unionByName(open_.select("query_id", "vec_id", dot.alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = written(scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "va-best")
    dropped(cells, wanted, found)
    return best
