"""Language identification: script ranges, per-word scores and a Viterbi pass with a switching penalty.

Every word gets a log score under each learned language: naive Bayes over its
character n-grams.  The script of the word's letters narrows the candidates
first: a language in whose training text the script doesn't occur is out for
that word.  Viterbi over the words, with a penalty for each switch, labels spans;
the text's language is the one whose spans hold most letters.  Many texts walk
through Viterbi side by side in numpy, one step for a word of each.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import worker_cache
from .subword import gram_ids

BUCKETS = 1 << 16
GRAMS = (2, 3, 4, 5)
SWITCH = 9.0  # log score that a switch of language costs
#: Bound of the training sample: rows of each language; their whole texts are counted where they lie.
SAMPLE_ROWS = 600
SALTS = 64  # a language's rows are ranked in so many parts first
CACHE_WORDS = 400_000
LANES = 512  # texts that walk side by side

# First code points of Unicode script blocks, and their names.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
STARTS = [s for s, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})


def script_of(word: str) -> int:
    return NAMES.index(SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1][1])


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case; very long runs are cut every 40 letters (scripts without spaces)."""
    import regex

    found = regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())
    if found and max(map(len, found)) > 40:
        found = [w[i : i + 40] for w in found for i in range(0, len(w), 40)]
    return found


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray):
        self.langs, self.table, self.scripts = langs, table, scripts  # BUCKETS x L log shares; script x L allowed

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores, words x languages, each word's best at 0."""
        owner, grams = gram_ids(words, GRAMS, BUCKETS)
        value = np.stack([np.bincount(owner, self.table[grams, k], len(words)) for k in range(len(self.langs))], axis=1)
        value *= np.minimum(1.0, 8 / np.bincount(owner, minlength=len(words)))[:, None]  # n-grams of a word overlap
        allowed = self.scripts[[script_of(w) for w in words]]
        value = np.where(allowed, value, value.max(1, keepdims=True) - 30.0)
        value[~allowed.any(1)] = 0.0
        return (value - value.max(1, keepdims=True)).astype(np.float32)


def tally(rows) -> dict[tuple[str, int], int]:
    """rows: text and language.  How often each language shows each n-gram bucket, and (below zero: -1 - script) each script."""
    words: dict[str, Counter] = {}
    for text, lang in rows:
        words.setdefault(lang, Counter()).update(words_of(text))
    out: dict[tuple[str, int], int] = {}
    for lang, found in words.items():
        own = list(found)
        for at in range(0, len(own), 20_000):
            part = own[at : at + 20_000]
            often = np.array([found[w] for w in part], np.float64)
            owner, grams = gram_ids(part, GRAMS, BUCKETS)
            counts = np.bincount(grams, often[owner], BUCKETS)
            for k in np.flatnonzero(counts).tolist():
                out[lang, k] = out.get((lang, k), 0) + int(counts[k])
            for w in part:
                k = -1 - script_of(w)
                out[lang, k] = out.get((lang, k), 0) + found[w]
    return out


def model_of(counted, names) -> Model:
    """counted: (language, bucket or script, count) rows.  Add-one-half smoothing; every language weighs alike."""
    langs = sorted(names)
    at = {lang: k for k, lang in enumerate(langs)}
    counts, scripts = np.zeros((BUCKETS, len(langs))), np.zeros((len(NAMES), len(langs)))
    for lang, k, n in counted:
        (counts if k >= 0 else scripts)[k if k >= 0 else -1 - k, at[lang]] += n
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS)) if langs else counts
    table -= table.max(1, keepdims=True) if langs else 0
    return Model(langs, np.maximum(table, -6.0).astype(np.float32), scripts > 0.002 * scripts.sum(0))


class WordScores(dict):
    """Word -> its row in a table of scores."""

    def __init__(self, model: Model):
        self.model, self.table = model, np.zeros((CACHE_WORDS, len(model.langs)), np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        """Have every word of the texts at hand."""
        new = set().union(*texts).difference(self)
        if len(self) + len(new) > len(self.table):
            self.clear()
            new = set().union(*texts)
            if len(new) > len(self.table):
                self.table = np.zeros((len(new), self.table.shape[1]), np.float32)
        if new:
            n, words = len(self), list(new)
            self.update(zip(words, range(n, n + len(words)), strict=True))
            for at in range(0, len(words), 20_000):
                self.table[n + at : n + at + 20_000][: len(words) - at] = self.model.score(words[at : at + 20_000])


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best label of each word, for many texts at once; ties go to staying, then to the first language."""
    out: list[np.ndarray] = [np.zeros(len(s), np.int32) for s in scores]
    order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: -len(scores[i]))
    for at in range(0, len(order), LANES):
        lanes = order[at : at + LANES]
        lengths = np.array([len(scores[i]) for i in lanes])
        steps = int(lengths[0])
        # the words of step t stand together, in the lanes' order; the lanes still walking are a prefix
        active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
        first = np.concatenate(([0], np.cumsum(active)))
        by_step = np.empty((first[-1], scores[lanes[0]].shape[1]), np.float32)
        for lane, i in enumerate(lanes):
            by_step[first[: lengths[lane]] + lane] = scores[i]
        stay, best = np.ones(by_step.shape, bool), np.zeros(len(by_step), np.int32)
        label = np.zeros(len(by_step), np.int32)
        rows = np.arange(len(lanes))
        v = by_step[: active[0]].copy()
        ends = np.zeros(len(lanes), np.int32)
        for t in range(1, steps):
            a, lo = active[t], first[t]
            if a < len(v):
                ends[a : len(v)] = v[a:].argmax(1)
                v = v[:a]
            top = v.argmax(1)
            peak = v[rows[:a], top]
            keep = v >= (peak - switch)[:, None]
            best[lo : lo + a], stay[lo : lo + a] = top, keep
            v = np.maximum(v, (peak - switch)[:, None]) - peak[:, None] + by_step[lo : lo + a]
        ends[: len(v)] = v.argmax(1)
        state, after = ends.copy(), 0
        for t in range(steps - 1, -1, -1):
            a, lo = active[t], first[t]
            state[after:a] = ends[after:a]  # lanes that end here
            label[lo : lo + a] = state[:a]
            state[:a] = np.where(stay[lo + rows[:a], state[:a]], state[:a], best[lo : lo + a])
            after = a
        for lane, i in enumerate(lanes):
            out[i] = label[first[: lengths[lane]] + lane]
    return out


def learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str, training) -> Model:
    """The model of at most SAMPLE_ROWS rows of each language, by the order of a hash of the id; of all languages.

    One scan ranks ids (no text is shuffled), a second counts the n-grams of the rows
    chosen, in each task first; the driver gets at most BUCKETS numbers a language.
    """
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    key = F.xxhash64(F.col("_id").cast("string"))
    ids = rows.where(F.trim("_text") != "").select("_id", "_lang", key.alias("_h")).withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    for by in (("_lang", "_salt"), ("_lang",)):
        ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_id"))).where(F.col("_r") <= SAMPLE_ROWS)
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in ids.select("_id", "_lang").distinct().collect()], rows.drop("_text").schema)

    def counted(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = tally(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(found.values(), pa.int64())], names=["lang", "k", "n"])

    found = rows.join(F.broadcast(chosen), ["_id", "_lang"]).select("_text", "_lang").mapInArrow(counted, "lang string, k int, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    counts = list(zip(found["lang"].to_pylist(), found["k"].to_pylist(), found["n"].to_pylist(), strict=True))
    return model_of(counts, {c[0] for c in counts})


def detect_languages(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_spans: bool = False) -> DataFrame:
    """id_col, lang_pred, score (share of the letters in that language's spans) and, with `with_spans`, the spans.

    `training`: condition on docs; only text and non-null lang_col of its rows are
    learned from.  A text that is null or has no letter is `und` with score 0; so
    is every text when nothing can be learned.  Ties go to the smaller name.
    Spans: language, first word and number of words (words: runs of letters).
    Repeated rows, also of a null id, are treated alike; extra columns have no effect;
    an empty table gives an empty result.  One narrow map over whole texts, however
    long; only counts of the bounded sample go to the driver.
    """
    model = learned(docs, id_col, text_col, lang_col, training)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double" + ", spans array<struct<lang:string,first_word:int,n_words:int>>" * with_spans

    def detected(batches):
        model = shared.value
        cache = worker_cache(("langid", key), lambda: WordScores(model))

        def label(cells):
            found = [words_of(cell.as_py()) if model.langs else [] for cell in cells]
            cache.learn(found)
            scores = [cache.table[np.fromiter(map(cache.__getitem__, words), np.int64, len(words))] for words in found]
            texts = [np.fromiter(map(len, words), np.int64, len(words)) for words in found]
            for letters, path in zip(texts, viterbi(scores), strict=True):
                if not len(path):
                    yield "und", 0.0, []
                    continue
                share = np.bincount(path, letters, len(model.langs))
                edges = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
                spans = [{"lang": model.langs[path[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(edges, np.append(edges[1:], len(path)), strict=True)] if with_spans else []
                yield model.langs[int(share.argmax())], float(share.max() / share.sum()), spans

        for batch in batches:
            for at in range(0, batch.num_rows, LANES):
                part = batch.slice(at, LANES)
                rows = list(label(part.column(1)))
                columns = [part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
                if with_spans:
                    columns.append(pa.array([r[2] for r in rows], pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", *["spans"] * with_spans])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(detected, schema)
