"""Near-duplicate vectors by NN-descent.

Every distinct vector keeps a list of its NEIGHBOURS nearest by cosine.  Random
hyperplane buckets give first lists; each round then joins, at every vector, the
neighbours of its neighbours (both ways) and keeps what is nearer.  Of all pairs
met at the threshold enough are links to connect what they connect.  A vector
whose list is saturated (full of links) has its list enlarged to its whole
component, compared in blocks, and meets vectors of other components in buckets
of its own.  An audit compares samples of vectors with all others until it has
seen LINKS true links; below RECALL more buckets and rounds follow, and at last
all pairs are compared in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written
from .graph import components

NEIGHBOURS, TABLES, BUCKET, JOIN = 8, 6, 256, 128
BLOCK, PAIRS = 4096, 512  # vectors of a block whose links are counted, and of one whose links are found
ROUNDS, UPDATES = 3, 0.02  # NN-descent stops after ROUNDS, or when a round changes a smaller share of the lists
AUDIT, RECALL, RETRIES = 256, 0.97, 3  # vectors first audited, recall asked for, further attempts
LINKS, MOST_AUDIT = 500, 8192  # true links an audit has to see, vectors audited at once


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; first by their largest component, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pairs(a, b, s) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "s": pa.array(s, pa.float64())})


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of links that connect all that `linked` (symmetric) connects: each vector reached is linked with the one it was reached from."""
    a, b = [], []
    todo = linked.any(1)
    while todo.any():
        first = int(todo.argmax())
        todo[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & todo)
            todo[new] = False
            a.append(np.full(len(new), at))
            b.append(new)
            queue += new.tolist()
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def local_join(table: pa.Table, threshold: float) -> pa.Table:
    """Pairs of a group that are nearer than the k-th of the first one's list, at most NEIGHBOURS each, and links that connect all linked among them.

    With a column g, only pairs of different g.
    """
    c, kth = table["c"].to_numpy(), table["k"].to_numpy()
    c, first = np.unique(c, return_index=True)
    if len(c) < 2:
        return _pairs([], [], [])
    x = unit(matrix(table["v"])[first])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    if "g" in table.column_names:
        g = table["g"].to_numpy()[first]
        s[g[:, None] == g] = -2
    n = min(NEIGHBOURS, len(c) - 1)
    near = np.argpartition(-s, n - 1, axis=1)[:, :n]
    a = np.repeat(np.arange(len(c)), n)
    b = near.ravel()
    value = s[a, b]
    better = ((value > kth[first][a]) | (value >= threshold)) & (value > -2)
    i, j = spanning(s >= threshold)
    a, b = np.concatenate((a[better], i)), np.concatenate((b[better], j))
    return _pairs(c[a], c[b], s[a, b])


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, n_links (other vectors linked directly), component_id (smallest id reachable, itself included) and kept of every row.

    Linked: cosine in double precision at or above the threshold (as computed; pairs
    within rounding of it may fall either way).  Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing; only vectors of one length
    are compared.  Equal vectors are one class, expanded again in the counts.  Rows
    that repeat an id are one vector, the smallest of theirs.  Rows with a null id
    stay alone.  An empty table gives an empty result; extra columns have no effect.
    """
    spark = vectors.sparkSession
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    ok = F.coalesce(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0), F.lit(False))
    ids = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.when(ok, x).alias("v"))
    one = written(ids.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v")), "nn-ids")
    classes = written(one.groupBy("v").agg(F.min("id").alias("c"), F.count("*").alias("m")), "nn-classes")
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    hits = spark.createDataFrame([], "a bigint, b bigint, s double")
    lists = None
    for attempt in range(1 + RETRIES):
        if n < 2:
            break
        found = _buckets(classes, n, longest, attempt, threshold)
        lists, more = _merged(lists, found, threshold)
        hits = hits.unionAll(more)
        for _ in range(ROUNDS):
            then, more = _merged(lists, _descent(classes, lists, threshold), threshold)
            hits = hits.unionAll(more)
            changed = then.join(lists.select("a", "b"), ["a", "b"], "left_anti").count()
            dropped(lists)
            lists = then
            if changed < UPDATES * n * NEIGHBOURS:
                break
        hits = hits.unionAll(written(_between(classes, hits, lists, n, longest, attempt, threshold), "nn-between"))
        if _recall(classes, hits, threshold, n) >= RECALL:
            break
    else:
        hits = _all_pairs(classes, n, threshold)
    links = written(hits.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "nn-links")
    groups = written(components(links), "nn-groups")
    counts = _counted(classes, groups, threshold)
    member = one.join(classes.select("v", "c", "m"), "v").select("id", "c", "m")
    member = member.join(counts.withColumnRenamed("id", "c"), "c", "left").join(groups.withColumnRenamed("id", "c"), "c", "left")
    told = member.select("id", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("_n"), F.coalesce("component", "c").alias("_g"))
    out = ids.select("id").join(told, "id", "left")
    component = F.coalesce("_g", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _salted(keys: list[str], rows: DataFrame, most: int) -> DataFrame:
    """rows with `salt`, such that no group of keys and salt holds many more than `most` rows."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    return rows.join(sizes, keys).withColumn("salt", F.pmod(F.xxhash64("c", *keys), F.col("parts")).cast("int")).drop("parts")


def _buckets(classes: DataFrame, n: int, longest: int, attempt: int, threshold: float, seed: int = 100) -> DataFrame:
    """Pairs met in buckets; classes may bring g, then only pairs of different g."""
    bits = max(0, min(24, math.ceil(math.log2(max(1, n / (BUCKET // 4))))))
    tables = TABLES * (1 + attempt)

    def coded(batches):
        planes = np.random.default_rng(seed + attempt).normal(size=(longest, tables * bits))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            c, length = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                x = matrix(batch.column(1).take(pa.array(rows)))
                codes = ((x @ planes[:size] > 0).reshape(len(rows), tables, bits) * weights).sum(2) if bits else np.zeros((len(rows), tables), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c[rows], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(codes.ravel().astype(np.int64) * 4096 + size), pa.array(np.full(len(rows) * tables, -2.0))], names=["c", "t", "code", "k"])

    codes = written(classes.select("c", "v").mapInArrow(coded, "c bigint, t int, code bigint, k double"), "nn-codes")
    salted = _salted(["t", "code"], codes, BUCKET).join(classes.drop("m"), "c")
    return salted.groupBy("t", "code", "salt").applyInArrow(lambda table: local_join(table, threshold), "a bigint, b bigint, s double")


def _merged(lists: DataFrame | None, found: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The NEIGHBOURS nearest of lists and what was found, and the links among what was found."""
    found = written(found, "nn-found")
    both = (found if lists is None else found.unionAll(lists)).groupBy("a", "b").agg(F.max("s").alias("s"))
    order = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    top = written(both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= NEIGHBOURS).drop("_r"), "nn-lists")
    return top, found.where(F.col("s") >= threshold)


def _descent(classes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Neighbours of neighbours: at every vector, all in its list or with it in theirs meet."""
    kth = lists.groupBy("a").agg(F.count("*").alias("_n"), F.min("s").alias("_s")).select(F.col("a").alias("c"), F.when(F.col("_n") >= NEIGHBOURS, F.col("_s")).otherwise(-2.0).alias("k"))
    known = written(classes.select("c", "v").join(kth, "c", "left").select("c", "v", F.coalesce("k", F.lit(-2.0)).alias("k")), "nn-known")
    sides = lists.select(F.col("a").alias("p"), F.col("b").alias("c")).unionAll(lists.select(F.col("b").alias("p"), F.col("a").alias("c"))).unionAll(classes.select(F.col("c").alias("p"), "c")).distinct()
    met = _salted(["p"], sides, JOIN).join(known, "c")
    return met.groupBy("p", "salt").applyInArrow(lambda table: local_join(table, threshold), "a bigint, b bigint, s double")


def _between(classes: DataFrame, hits: DataFrame, lists: DataFrame, n: int, longest: int, attempt: int, threshold: float) -> DataFrame:
    """Links of saturated vectors, whose lists hold nothing but links, with other components: they meet in new buckets, own components left out."""
    full = lists.where(F.col("s") >= threshold).groupBy("a").count().where(F.col("count") >= NEIGHBOURS).select(F.col("a").alias("c"))
    groups = written(components(hits.select(F.col("a").alias("u"), F.col("b").alias("v"))), "nn-between-groups")
    some = written(classes.join(full, "c").join(groups.select(F.col("id").alias("c"), F.col("component").alias("g")), "c").select("c", "v", "g"), "nn-full")
    return _buckets(some, some.count(), longest, attempt, threshold, seed=200).where(F.col("s") >= threshold)


def _all_pairs(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links that connect all linked vectors, from all pairs compared in blocks."""
    blocks = max(1, math.ceil(n / PAIRS))
    placed = classes.withColumn("block", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")).withColumn("size", F.size("v"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("size", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "c", "v")

    def compared(table: pa.Table) -> pa.Table:
        c, x = table["c"].to_numpy(), unit(matrix(table["v"]))
        s = x @ x.T
        np.fill_diagonal(s, -2)
        a, b = spanning(s >= threshold)
        return _pairs(c[a], c[b], s[a, b])

    return dealt.groupBy("size", "i", "j").applyInArrow(compared, "a bigint, b bigint, s double")


def _recall(classes: DataFrame, hits: DataFrame, threshold: float, n: int) -> float:
    """Share of true link partners that lie in the same component by the links found.

    Samples by a hash of the id, the first of about AUDIT vectors and later ones
    larger, until LINKS true links are seen or all vectors are audited.
    """
    groups = written(components(hits.select(F.col("a").alias("u"), F.col("b").alias("v"))), "nn-audit")
    parts = math.ceil(n / AUDIT)
    part = F.pmod(F.xxhash64("c"), F.lit(parts))
    at, size, seen, same = 0, 1, 0, 0
    while at < parts and seen < LINKS:
        more, found = _audited(classes, groups, threshold, (part >= at) & (part < at + size))
        seen, same, at, size = seen + more, same + found, at + size, min(4 * size, MOST_AUDIT // AUDIT)
    dropped(groups)
    return same / seen if seen else 1.0


def _audited(classes: DataFrame, groups: DataFrame, threshold: float, among) -> tuple[int, int]:
    """True links of the vectors that `among` picks (they are broadcast), and how many of them lie in one component; each task gives back links only."""
    sample = classes.where(among).select("c", "v").collect()
    ids, values = np.array([r[0] for r in sample], np.int64), [np.array(r[1]) for r in sample]
    shared = classes.sparkSession.sparkContext.broadcast((ids, values))

    def compared(batches):
        ids, values = shared.value
        for batch in batches:
            c, length = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                of = np.flatnonzero([len(v) == size for v in values])
                if len(of):
                    s = unit(np.stack([values[i] for i in of])) @ unit(matrix(batch.column(1).take(pa.array(rows)))).T
                    i, j = np.nonzero(s >= threshold)
                    differ = ids[of[i]] != c[rows[j]]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of[i[differ]]]), pa.array(c[rows[j[differ]]])], names=["a", "b"])

    true = classes.select("c", "v").mapInArrow(compared, "a bigint, b bigint")
    placed = true.join(groups.select(F.col("id").alias("a"), F.col("component").alias("ga")), "a", "left").join(groups.select(F.col("id").alias("b"), F.col("component").alias("gb")), "b", "left")
    return tuple(placed.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("ga") == F.col("gb"), 1)), F.lit(0))).first())


def _counted(classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """id and n: vectors linked with each class, its own left out; components are compared in blocks, only counts come out."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(F.col("component").alias("g"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("id").alias("c"))
    dealt = dealt.join(classes, "c")

    def counted(table: pa.Table) -> pa.Table:
        c, m, block, x = table["c"].to_numpy(), table["m"].to_numpy(), table["block"].to_numpy(), unit(matrix(table["v"]))
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        low, high = np.flatnonzero(block == i), np.flatnonzero(block == j)
        n = np.zeros(len(c), np.int64)
        for at in range(0, len(low), 256):
            some = low[at : at + 256]
            linked = (x[some] @ x[high].T) >= threshold
            if i == j:
                linked[np.arange(len(some)), at + np.arange(len(some))] = False
            else:
                n[high] += linked.T @ m[some]
            n[some] += linked @ m[high]
        return pa.table({"id": pa.array(c), "n": pa.array(n)})

    return dealt.groupBy("g", "i", "j").applyInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
