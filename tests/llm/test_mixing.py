import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm.mixing import mix_to_targets, posteriors

WORDS = {"a": "red green blue cyan pink".split(), "b": "uno dos tres cuatro cinco".split(), "c": "eins zwei drei vier sechs".split()}


def rows(n=300):
    rng = random.Random(2)
    out = []
    for i in range(n):
        d = "a" if i % 10 < 7 else "b" if i % 10 < 9 else "c"
        words = [rng.choice(WORDS[d]) for _ in range(rng.randint(3, 60))]
        if i % 13 == 0:
            words += [rng.choice(WORDS["b"]) for _ in range(len(words))]
        out.append((i, " ".join(words), d))
    return out + [(900, None, None), (901, "", "a"), (902, "  \n", None), (903, "unseen words only", None), (904, "red " * 20_000, None), (0, out[0][1], "a")]


def brute(p, n, low, target):
    """Projected gradient in numpy, to the end."""
    r = np.full(len(n), max(1.0, low))
    have = n @ p
    for _ in range(20_000):
        r = np.maximum(low, r - p @ ((((n * r) @ p) - target) / have))
    return r


@pytest.mark.parametrize("low,weights", [(0.0, {"a": 0.2, "b": 0.3, "c": 0.5}), (0.0, {"a": 0.0, "b": 1.0, "c": 0.0}), (1.0, 0.5)])
def test_against_numpy(spark, low, weights):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string").withColumn("rate", F.lit("x")).withColumn("p0", F.lit("x")).repartition(3)
    labelled = df.where("doc_id < 200")
    domains, soft = posteriors(df, labelled, "doc_id", "text", "lang")
    got = {(r[0], r[1]): np.array(r[2:], float) for r in soft.collect()}
    assert domains == ["a", "b", "c"] and all(abs(x.sum() - 1) < 1e-9 for x in got.values())
    out = mix_to_targets(df, labelled, weights, min_rate=low).collect()
    assert len(out) == len(rows())
    p = np.array([got[(r.doc_id, r.n_tokens)] for r in out])
    n = np.array([r.n_tokens for r in out], float)
    r = np.array([r.rate for r in out])
    have = n @ p
    if isinstance(weights, dict):
        target = have.sum() * np.array([weights[d] for d in domains])
    else:
        s = (have / have.sum()) ** weights
        s /= s.sum()
        target = s * max(have / s)
    assert (r >= low - 1e-12).all()
    fitted, want = (n * r) @ p, (n * brute(p, n, low, target)) @ p
    assert np.abs(fitted - want).max() <= 0.02 * want.sum()
    assert all(abs(x.copies - x.rate) < 1 for x in out)


def test_degenerate(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string")
    assert {r.rate for r in mix_to_targets(df, df.limit(0)).collect()} == {1.0}
    assert mix_to_targets(df.limit(0), df).count() == 0
    one = mix_to_targets(df, df.where("lang = 'a'")).collect()
    assert {r.domain for r in one} == {"a"} and all(abs(r.rate - 1) < 1e-6 for r in one)
