import random

import numpy as np
from pyspark.sql import functions as F

from evidex.llm import toxicity
from evidex.llm.subword import gram_ids
from evidex.llm.toxicity import toxicity_scores


def corpus():
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(800):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 150))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grumzok" + rng.choice(["", "en", "ig", "ste", "ung"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_and_generalises(spark):
    rows, labels = corpus()
    odd = [(1000, None), (1001, ""), (1002, rows[5][1] + " grumzokkery grumzokka"), (1003, " ".join([rows[1][1]] * 50) + " grumzokly grumzokig " + " ".join([rows[2][1]] * 50)), (1004, "\U0001f600 " * 200), (1005, "q" * 50_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string").withColumn("score", F.lit(1))
    labelled = spark.createDataFrame(labels + [(2, None), (7, 5)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity_scores(docs, labelled, F.col("doc_id") % 5 != 0).collect()}
    assert len(got) == 806 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [i for i in range(800) if i % 5 == 0]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.93 * len(held)
    assert got[1000].predicted == got[1001].predicted == got[1004].predicted == 0
    assert got[1002].predicted == got[1003].predicted == 1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.predicted for r in toxicity_scores(docs, none, F.lit(True)).collect()] == [0, 0]
    assert toxicity_scores(docs.limit(0), none, F.lit(True)).count() == 0


def test_subwords_are_shared():
    owner, ids = gram_ids(["grumzok", "grumzokkery", "ab"], (3, 4), 1 << 20)
    assert len(set(ids[owner == 0]) & set(ids[owner == 1])) >= 10
    assert (owner == 2).sum() == 1 + 2 + 1


def test_all_windows_are_scored_and_all_words_trained_on():
    size = toxicity.WINDOW
    rng = np.random.default_rng(5)
    sums, counts = rng.normal(size=300), rng.integers(1, 9, 300)
    want = max(sums[a : a + size].sum() / counts[a : a + size].sum() for a in range(301 - size))
    assert abs(toxicity.top_window(sums, counts) - want) < 1e-9
    for n in range(1, 200):
        assert set(range(n)) == {w for a in toxicity.window_starts(n) for w in range(a, min(a + size, n))}


def test_scores_equal_the_softmax_of_averaged_bags():
    """The folded model's window means are those of a bag's embeddings through the linear layer."""
    rows, labels = corpus()
    model = toxicity.train([t for _, t in rows[:200]], [y for _, y in labels[:200]])
    words = toxicity.WordValues(model.values)
    for _, text in rows[200:240]:
        own = toxicity.words_of(text)
        words.learn([own])
        both = np.array([words[w] for w in own])
        top = -np.inf
        for a in range(len(own) - toxicity.WINDOW + 1):
            _, grams = gram_ids([toxicity.core(w) for w in own[a : a + toxicity.WINDOW]], toxicity.GRAMS, toxicity.BUCKETS)
            top = max(top, model.values[grams].mean(dtype=np.float64))
        assert abs(toxicity.top_window(both[:, 0], both[:, 1]) - top) < 1e-6


def test_held_out_recall(spark):
    from evidex.llm.queries import op5_toxicity

    sf = "/root/testdata/sf0.1"
    held = op5_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in held}
    # some 9 of the 97 held-out toxic rows hold no word that any other toxic row holds
    assert n[1, 1] >= 0.88 * (n[1, 1] + n.get((1, 0), 0)) and n[0, 0] >= 0.98 * (n[0, 0] + n.get((0, 1), 0))


def test_sample_is_bounded_by_rows_and_characters(spark, monkeypatch):
    rows, labels = corpus()
    docs, table = spark.createDataFrame(rows + rows[:9], "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    sample = lambda: toxicity.labelled_sample(docs, table, "doc_id", "text", "toxic", F.lit(True))
    assert len(sample()[0]) == 800
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 50)
    assert all(45 <= sample()[1].count(k) <= 50 for k in (0, 1))  # repeated rows are ranked too
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 3000)
    texts, y = sample()
    assert {0, 1} == set(y) and sum(map(len, texts)) <= 6000


def test_training_holds_little_beside_its_parameters():
    """The driver trains: the parameters with their two moments and one gradient are four tables, and no step may take many more."""
    import tracemalloc

    rng = np.random.default_rng(9)
    words = ["".join(x) for x in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (40_000, 7))]
    texts = [" ".join(words[i : i + 400]) for i in range(0, len(words), 400)]
    table = toxicity.BUCKETS * toxicity.DIMENSIONS * 8
    tracemalloc.start()
    try:
        toxicity.train(texts, [i % 2 for i in range(len(texts))], epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 7 * table
    finally:
        tracemalloc.stop()


def test_memory_of_the_sample_goes_back(spark, monkeypatch):
    """Later stages of a pipeline run in the same driver: what the training freed is returned to the system."""
    order = []
    train, released = toxicity.train, toxicity.released
    monkeypatch.setattr(toxicity, "train", lambda *a: order.append("train") or train(*a))
    monkeypatch.setattr(toxicity, "released", lambda: order.append("released") or released())
    rows, labels = corpus()
    docs, labelled = spark.createDataFrame(rows[:80], "doc_id bigint, text string"), spark.createDataFrame(labels[:80], "doc_id bigint, toxic int")
    for f in (toxicity.toxicity_scores, toxicity.without_toxic):
        order.clear()
        f(docs, labelled, F.lit(True))
        assert order == ["train", "released"]
