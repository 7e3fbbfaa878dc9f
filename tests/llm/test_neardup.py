import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import neardup
from evidex.llm.graph import components


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ") if t else []
        w = [x for x in (t or "").encode().lower().split()]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                s = len(sets[a] & sets[b])
                if 100 * s >= percent * (len(sets[a]) + len(sets[b]) - s):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(60):
        rows.append([rng.choice(vocab) for _ in range(rng.randint(1, 120))])
    group = [rng.choice(vocab) for _ in range(100)]
    for _ in range(150):  # near copies of one text, some of them further off
        t = list(group)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 8])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        rows.append(t)
    passage = [rng.choice(vocab) for _ in range(40)]
    for _ in range(30):
        rows.append(passage + [rng.choice(vocab) for _ in range(40)])
    out = [" ".join(t) for t in rows]
    out += [out[3].upper().replace("W", "w"), "  " + out[70].replace(" ", "\n"), None, "", " \t ", "one", "one", "one two", "é ü É", "é ü é", "x " * 30_000]
    return list(enumerate(out))


@pytest.mark.parametrize("size,percent,block", [(5, 80, 256), (3, 85, 16), (5, 80, 16)])
def test_against_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit("x")).withColumn("_key", F.lit(1)).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, size, percent).collect()}
    want = brute(rows, size, percent)
    assert {i: x for i, x in got.items() if x != want[i]} == {}
    assert len(got) == len(rows)


def test_large_cluster_is_linear(spark, monkeypatch):
    """Near copies of one text, and some outside their threshold: as brute force says; rows dealt grow with the classes, not their pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 32)
    monkeypatch.setattr(neardup, "PIVOTS", 8)
    rng = random.Random(9)
    base, n = [f"b{k}" for k in range(260)], 700
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.choice([1, 1, 2]) if i % 100 else 40):
            t[rng.randrange(len(t))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    dealt = {}
    for name in ("first_blocks", "remaining_blocks"):
        def counted(members, name=name, true=getattr(neardup, name)):
            out = true(members)
            dealt[name] = out.count()
            return out

        monkeypatch.setattr(neardup, name, counted)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()}
    assert got == brute(rows, 5, 80)
    assert 2 <= len({x[1] for x in got.values()}) < 20
    assert n < dealt["first_blocks"] < 2 * n  # all pairs of blocks: 22 times
    assert dealt["remaining_blocks"] < 4 * n


def test_blocks_hold_every_pair(spark):
    """What first_blocks and remaining_blocks bring together is all pairs but those of the largest part."""
    rng = random.Random(2)
    rows = [(g, c, -(-n // neardup.BLOCK), c % -(-n // neardup.BLOCK), rng.choice([0, 0, 0, c])) for g, n in ((1, 600), (2, 300)) for c in range(n)]
    members = spark.createDataFrame(rows, "g bigint, c bigint, blocks int, block int, part bigint")
    met = {1: set(), 2: set()}
    tasks = {}
    for r in neardup.remaining_blocks(members).collect():
        tasks.setdefault((r.g, r.i, r.j), {}).setdefault(r.block, []).append(r.c)
    for (g, i, j), by in tasks.items():
        assert set(by) <= {i, j}
        met[g] |= {(min(a, b), max(a, b)) for a in by.get(i, []) for b in by.get(j, []) if a != b}
    part = {(g, c): p for g, c, _, _, p in rows}
    for g, n in ((1, 600), (2, 300)):
        assert met[g] == {(a, b) for a in range(n) for b in range(a + 1, n) if part[g, a] or part[g, b]}


def test_repeated_ids_and_empty(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (3, "q r s"), (2, "q r s"), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df, 3, 85).collect()))
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False)]
    assert neardup.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 200)] + [(5, 5)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1] or i in got}


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[: 919], rng.integers(0, 1 << 63, 81, dtype=np.uint64)))  # similarity 0.85
    x, y = (neardup.odd_sketch(neardup.minhash(np.unique(s))) for s in (a, b))
    assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= neardup.most_bits(85) < 180
