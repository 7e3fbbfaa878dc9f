import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import embdup


def data(seed=1, dims=16):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dims) for _ in range(300)]
    centre = rng.normal(size=dims)
    rows += [centre + rng.normal(size=dims) * 0.12 for _ in range(120)]
    for k in range(40):
        rows.append(rows[k * 3] * 2.5 + rng.normal(size=dims) * 0.1)
    rows += [rows[5]] * 30
    out = [(i, [float(x) for x in r]) for i, r in enumerate(rows)]
    bad = [None, [], [0.0] * dims, [1.0] * (dims - 1) + [None], [float("nan")] * dims, [float("inf")] * dims, [1.0, 0.0], [2.0, 0.1], [1e-300] * dims, [1e300] * dims]
    return out + [(1000 + i, b) for i, b in enumerate(bad)]


def brute(rows, t=0.9):
    ok = {i: embdup.unit(np.array([v], float))[0] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    n = {i: 0 for i, _ in rows}
    ids = sorted(ok)
    for a in ids:
        for b in ids:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= t:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in n}


@pytest.mark.parametrize("block", [4096, 20])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embdup, "BLOCK", block)
    monkeypatch.setattr(embdup, "BUCKET", 64)
    rows = data()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("kept", F.lit(1)).withColumn("c", F.lit(1)).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdup.near_vectors(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert got == want


def test_few_repeated_and_none(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embdup.near_vectors(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (3, 1, 1, False), (3, 1, 1, False)]
    assert embdup.near_vectors(df.limit(0)).count() == 0


def test_two_tight_clumps_linked_with_each_other(spark):
    """Each vector's nearest are all of its own clump; the links across are found all the same."""
    rng = np.random.default_rng(4)
    one, two = np.eye(16)[0], 0.93 * np.eye(16)[0] + np.sqrt(1 - 0.93**2) * np.eye(16)[1]
    rows = [(i, [float(x) for x in (one if i < 20 else two) + rng.normal(size=16) * 0.002]) for i in range(40)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == brute(rows) and set(got.values()) == {(39, 0, True), (39, 0, False)}


def test_all_pairs_where_the_search_finds_nothing(spark, monkeypatch):
    """A search below the recall asked for ends in the comparison of all pairs."""
    monkeypatch.setattr(embdup, "_buckets", lambda classes, *args, **more: classes.sparkSession.createDataFrame([], "a bigint, b bigint, s double"))
    monkeypatch.setattr(embdup, "RETRIES", 0)
    monkeypatch.setattr(embdup, "PAIRS", 40)
    rows = data()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == brute(rows)


def test_audit_goes_on_until_it_sees_links(spark):
    """One linked pair among 1,500 vectors: no small sample holds it."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24))
    x[1] = x[0] * 2 + 0.01
    classes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "c bigint, v array<double>, m bigint")
    none = spark.createDataFrame([], "a bigint, b bigint, s double")
    assert embdup._recall(classes, none, 0.9, 1500) == 0.0
