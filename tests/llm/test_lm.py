import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import lm, lm_parts


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]


def rows():
    base = ["the cat sat on the mat", "The dog sat on the log", "a CAT and a dog É é", "the cat sat"]
    out = [(i, base[i % 4] + (f" only{i}" if i % 7 == 0 else "")) for i in range(60)]
    return out + [(100, None), (101, ""), (102, " \n\t "), (103, "zzz unseen the cat"), (104, "the cat " * 5000), (5, base[1])]


#: Bounds that choose the form: broadcast, in partitions, in partitions with dealt words and small blocks.
FORMS = [{}, {"MOST_CHARS": 0}, {"MOST_CHARS": 0, "PART_TOKENS": 400, "HOT_TOKENS": 800, "BLOCK_TOKENS": 50, "SLICE_TOKENS": 30}, {"MOST_CHARS": 0, "PART_TOKENS": 40, "HOT_TOKENS": 20, "BLOCK_TOKENS": 50, "NUMBERED": 4}]


def bounded(monkeypatch, form):
    for name, value in form.items():
        monkeypatch.setattr(lm if name == "MOST_CHARS" else lm_parts, name, value)


@pytest.mark.parametrize("form", FORMS)
def test_base_against_brute_force(spark, monkeypatch, form):
    bounded(monkeypatch, form)
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("score", F.lit(1)).repartition(3)
    train = F.col("doc_id") % 5 != 1
    got = lm.lm_scores(df, train).collect()
    c = Counter(x for i, t in data if i % 5 != 1 for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, len(k := tokens(t)), sum(c[x] > 0 for x in k), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in k), 6)) for i, t in data)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    seen = [r for r in got if r.doc_id < 60]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen) * 0.7


@pytest.mark.parametrize("form", FORMS)
def test_no_training_rows_and_empty(spark, monkeypatch, form):
    bounded(monkeypatch, form)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in lm.lm_scores(df, F.lit(False)).collect()}
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[2].n_tokens == 1
    assert lm.lm_scores(df.limit(0), F.lit(True)).count() == 0


def test_automaton_is_a_distribution_and_equals_plain_backoff():
    rng = np.random.default_rng(2)
    n, end = 7, 6
    texts = [rng.choice(6, rng.integers(0, 9), p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.1]) for _ in range(300)]
    uni, bi, tri = Counter(), Counter(), Counter()
    for t in texts:
        s = [end, *t.tolist(), end]
        uni.update(s[1:])
        bi.update(zip(s, s[1:]))
        tri.update(zip(s, s[1:], s[2:]))
    counts = np.array([uni[i] for i in range(n)], float)
    root = np.log10((counts + 0.5) / (counts.sum() + 0.5 * n))
    p = {k: c for k, c in bi.items() if c >= 3}
    q = {k: c for k, c in tri.items() if c >= 2 and k[:2] in p and k[1:] in p}
    auto = lm.Automaton(root, counts, (np.array([a * n + b for a, b in p]), np.array(list(p.values()))), (np.array([(a * n + b) * n + c for a, b, c in q]), np.array(list(q.values()))), end)

    def plain(w, u, v):
        """P(w | u v) from the counts."""

        def one(w):
            return 10 ** root[w]

        def two(w, v):
            arcs = {x: (c - lm.DISCOUNT) / counts[v] for (a, x), c in p.items() if a == v}
            return arcs[w] if w in arcs else (1 - sum(arcs.values())) / (1 - sum(one(x) for x in arcs)) * one(w) if arcs else one(w)

        arcs = {x: (c - lm.DISCOUNT) / p[(u, v)] for (a, b, x), c in q.items() if (a, b) == (u, v)}
        if u is None or not arcs:
            return two(w, v)
        return arcs[w] if w in arcs else (1 - sum(arcs.values())) / (1 - sum(two(x, v) for x in arcs)) * two(w, v)

    for v in range(n):
        for u in range(n):
            total = sum(plain(w, u, v) for w in range(n))
            assert 0.5 < total < 1 + 1e-9  # below 1 only where every word is an arc
    for t, score in zip(texts[:60], auto.scores([x.astype(np.int32) for x in texts[:60]])):
        s, want = [None, end, *t.tolist(), end], 0.0
        for a, b, c in zip(s, s[1:], s[2:]):
            want += math.log10(plain(c, a, b))
        assert abs(want - score) < 1e-6


@pytest.mark.parametrize("form", FORMS)
def test_all_grams_count_whatever_the_bounds(spark, monkeypatch, form):
    """Scores equal a plain backoff model over all n-grams counted twice, be the automaton broadcast or in partitions."""
    bounded(monkeypatch, form)
    data = rows()
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, t in data:
        if i % 5 != 1:
            k = tokens(t)
            uni.update(k)
            bi.update(zip([None, *k], k))
            tri.update(zip([None, *k], k, k[1:]))
    n = sum(uni.values()) + 0.5 * (len(uni) + 1)
    one = lambda w: (uni[w] + 0.5) / n
    part = lambda c, of: (c - lm.DISCOUNT) / of
    clip = lambda x: min(max(x, 1e-9), 1)
    after, after2 = {}, {}
    for (v, w), c in bi.items():
        if c >= 2:
            after.setdefault(v, {})[w] = part(c, uni[v])
    for (u, v, w), c in tri.items():
        if c >= 2:
            after2.setdefault((u, v), {})[w] = part(c, bi[u, v])

    def two(w, v):
        a = after.get(v, {})
        return a[w] if w in a else clip(1 - sum(a.values())) / clip(1 - sum(map(one, a))) * one(w) if a else one(w)

    def three(w, u, v):
        a = after2.get((u, v), {})
        return a[w] if w in a else clip(1 - sum(a.values())) / clip(1 - sum(two(x, v) for x in a)) * two(w, v) if a else two(w, v)

    def score(t):
        k = tokens(t)
        s = [None, *k]
        return math.log10(two(k[0], None)) + sum(math.log10(three(w, u, v)) for u, v, w in zip(s, s[1:], s[2:]))

    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, round(r.score, 4)) for r in lm.lm_scores(df, F.col("doc_id") % 5 != 1).collect())
    want = sorted((i, round(score(t), 4)) for i, t in data)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, want))


def test_fast_forms_equal_plain_ones():
    """Sorting with places below the keys, places by flags and codes of many words: what argsort, unique and code_of give."""
    rng = np.random.default_rng(1)
    for low, high, n in [(0, 1, 0), (0, 1, 1), (0, 50, 4000), (0, 1 << 40, 4000), (0, 1 << 62, 4000), (-9, 9, 4000), (0, 1 << 20, 300)]:
        x = rng.integers(low, high, n)
        assert (lm_parts._order(x) == np.argsort(x, kind="stable")).all()
        keys, at, sums = lm_parts._grouped(x, np.ones(n))
        want, places = np.unique(x, return_inverse=True)
        assert (keys == want).all() and (at == places).all() and (sums == np.bincount(places, minlength=len(want))).all()
        if low >= 0:
            assert (lm_parts._dealt_order(x) == np.argsort(x, kind="stable")).all()
        if low >= 0 and high <= 1 << 20:
            found, places = lm_parts._placed(x, high)
            assert (found == want).all() and (found[places] == x).all()
    words = [f"w{i}é".encode() for i in range(500)]
    code = {b"": 0} | {w: i + 1 for i, w in enumerate(words[:90])}
    assert lm_parts.codes_of(dict.fromkeys(words), 500, code).tolist() == [lm_parts.code_of(w, code) for w in words]
