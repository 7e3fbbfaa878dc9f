import itertools

import numpy as np

from evidex.llm.langid import detect_languages, viterbi
from pyspark.sql import functions as F


def brute(s, switch):
    best, path = -1e18, None
    for p in itertools.product(range(s.shape[1]), repeat=len(s)):
        v = sum(s[i, k] for i, k in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
        if v > best + 1e-6:
            best, path = v, p
    return best


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    scores = [rng.normal(0, 2, (n, 3)).astype(np.float32) for n in (1, 5, 0, 6, 3, 6, 1)]
    for s, path in zip(scores, viterbi(scores, 1.5)):
        if len(s):
            v = s[np.arange(len(s)), path].sum() - 1.5 * (path[1:] != path[:-1]).sum()
            assert abs(v - brute(s, 1.5)) < 1e-4


def rows(spark):
    en, de, ru = "the house and the garden are green this morning", "das Haus und der Garten sind heute früh grün", "дом и сад сегодня зеленые"
    data = [(i, [en, de, ru][i % 3], ["en", "de", "ru"][i % 3]) for i in range(60)]
    data += [(100, None, "en"), (101, "", None), (102, "12 34 !!", "de"), (103, (en + " ") * 6 + (de + " ") * 3, None), (104, "x" * 30_000, None), (105, "сад", None)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))


def test_mixed_and_odd_texts(spark):
    got = {r.doc_id: r for r in detect_languages(rows(spark), F.lit(True), with_spans=True).collect()}
    assert len(got) == 66
    assert all(got[i].lang_pred == ["en", "de", "ru"][i % 3] for i in range(60))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[103].lang_pred == "en" and {s.lang for s in got[103].spans} == {"en", "de"} and len(got[103].spans) == 2
    assert got[105].lang_pred == "ru"


def test_nothing_to_learn(spark):
    assert {r.lang_pred for r in detect_languages(rows(spark), F.lit(False)).collect()} == {"und"}
    assert detect_languages(rows(spark).limit(0), F.lit(True)).count() == 0


def test_languages_with_long_texts_only_are_learned(spark):
    short = [(i, "the house and the garden are green", "en") for i in range(20)]
    long = [(100 + i, "дом и сад сегодня зеленые " * 1000, "ru") for i in range(8)]
    docs = spark.createDataFrame(short + long + [(200, "сад и дом", None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in detect_languages(docs, F.lit(True)).collect()}
    assert got[200] == "ru" and got[100] == "ru" and got[0] == "en"


def test_labels_beyond_one_byte():
    scores = np.full((4, 300), -5.0, np.float32)
    scores[:, 290] = 0
    assert viterbi([scores])[0].tolist() == [290] * 4


def test_three_hundred_languages(spark):
    """Languages of invented words: all are learned, also with more rows than are sampled."""
    rng = np.random.default_rng(3)
    letters = [list("abcdefghijklmnopqrstuvwxyz"[i % 20 : i % 20 + 6]) for i in range(300)]
    words = [["".join(rng.choice(letters[k], 5)) + chr(0x4E00 + k) for _ in range(8)] for k in range(300)]
    rows = [(10 * k + j, " ".join(rng.choice(words[k], 12)), f"l{k:03}") for k in range(300) for j in range(4)]
    got = detect_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True)).collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 10:03}" for r in got) > 0.97 * len(got)
