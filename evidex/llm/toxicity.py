"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag of character n-grams hashed into a table of embeddings, so an
unseen misspelling or ending shares most of its vectors with known words.  A
text's bag is averaged and goes through a two-class linear softmax; embeddings
and softmax are fitted together by Adam.  Since both layers are linear, the
trained model folds into one number per n-gram; a word's sum over its n-grams is
computed once per worker.  A whole text is scored through all its overlapping
windows of `window` words: the highest window's mean, calibrated by a logistic
fit, so that a long text doesn't dilute a short passage.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, worker_cache
from .subword import gram_ids

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 16  # words; found by held-out recall, as is the rate of training
EDGES = "!?.,;:#*&%$|()[]{}'\"-_=~<>/"  # a word's n-grams are those of what stands between such characters
#: Bounds of the training sample: labelled rows of each class, and characters of all their texts together.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 20_000_000
SALTS = 64  # a class's rows are ranked in so many parts first
CACHE_WORDS = 120_000
#: Numbers that a step of the fit holds beside its parameters: the driver trains, and has less memory than an executor.
BLOCK = 16_384


def words_of(text: str | None) -> list[str]:
    """Lower-case words; one that came among the last WINDOW words kept isn't repeated, so a window is a bag of distinct words."""
    out, last, n = [], {}, 0
    for w in (text or "").lower().split():
        if n - last.get(w, -WINDOW) >= WINDOW:
            last[w] = n
            out.append(w)
            n += 1
    return out


def core(word: str) -> str:
    return word.strip(EDGES) or word


def grams_by_word(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of the words' n-grams, word by word, and how many each word has."""
    ids, sizes = [], []
    for at in range(0, len(words), 5000):
        owner, grams = gram_ids([core(w) for w in words[at : at + 5000]], GRAMS, BUCKETS)
        ids.append(grams.astype(np.int32))
        sizes.append(np.bincount(owner, minlength=len(words[at : at + 5000])))
    return np.concatenate(ids), np.concatenate(sizes)


def summed(values: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each word's sum of its n-grams' values, some thousand words at a time."""
    out = np.empty(len(offsets) - 1)
    for at in range(0, len(out), 5000):
        cuts = offsets[at : at + 5001]
        out[at : at + 5000] = np.add.reduceat(values[flat[cuts[0] : cuts[-1]]], cuts[:-1] - cuts[0])
    return out


def running(values: np.ndarray) -> np.ndarray:
    """Running sums, from 0 on."""
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def adam(q: np.ndarray, g: np.ndarray, m: np.ndarray, s: np.ndarray, step: int, rate: float) -> None:
    """One step of Adam on q in place, BLOCK numbers at a time."""
    q, g, m, s = (x.reshape(-1) for x in (q, g, m, s))
    for at in range(0, len(q), BLOCK):
        gb, mb, sb = g[at : at + BLOCK], m[at : at + BLOCK], s[at : at + BLOCK]
        mb *= 0.9
        mb += 0.1 * gb
        sb *= 0.999
        sb += 0.001 * gb * gb
        q[at : at + BLOCK] -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.999**step)) + 1e-8)


class Model:
    """n-gram values (embedding times softmax difference), bias, and the calibration of window scores."""

    def __init__(self, values: np.ndarray, slope: float, offset: float, empty: float):
        self.values, self.slope, self.offset, self.empty = values.astype(np.float32), slope, offset, empty

    def probability(self, top: float | None) -> float:
        if top is None:
            return self.empty
        return float(1 / (1 + np.exp(-np.clip(self.slope * top + self.offset, -30, 30))))


def top_window(sums: np.ndarray, counts: np.ndarray) -> float | None:
    """Highest mean n-gram value over all windows of WINDOW words."""
    n = len(sums)
    if not n:
        return None
    s, c = np.concatenate(([0.0], np.cumsum(sums, dtype=np.float64))), np.concatenate(([0], np.cumsum(counts)))
    if n <= WINDOW:
        # a short text is filled up to a window's size with neutral n-grams, else one word alone would decide
        return float(s[n] / (c[n] * max(1.0, (WINDOW / n) ** 0.7)))
    return float(np.max((s[WINDOW:] - s[:-WINDOW]) / (c[WINDOW:] - c[:-WINDOW])))


def window_starts(n: int) -> list[int]:
    """First words of a training text's windows: WINDOW apart, and one that ends with the text."""
    starts = list(range(0, max(1, n - WINDOW // 2), WINDOW))
    return starts + [n - WINDOW] * (starts[-1] + WINDOW < n)


def train(texts: list[str | None], labels: list[int], seed: int = 7, epochs: int = 5, batch: int = 64, rate: float = 0.01) -> Model:
    """Fit on labelled texts.  Without texts of both classes, a constant model of the labels' mean."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if not len(y) or share in (0.0, 1.0) or not any(words_of(t) for t in texts):
        return Model(np.zeros(BUCKETS), 0.0, np.log(max(share, 1e-3) / max(1 - share, 1e-3)), share)
    number: dict[str, int] = {}
    docs = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int32) for t in texts]
    flat, sizes = grams_by_word(list(number))
    del number, texts
    offsets = running(sizes)
    # instances: windows, so that training sees what scoring sees; a text's label holds for its windows until
    # the model itself tells which window of a toxic text is the toxic one
    tokens, spans, at = np.concatenate(docs), [], 0
    for k, n in enumerate(map(len, docs)):
        if n:
            spans.append(np.array([(k, at + a, at + min(a + WINDOW, n)) for a in window_starts(n)], np.int64))
        at += n
    docs = np.split(tokens, np.cumsum([len(d) for d in docs])[:-1])  # views
    owner, begin, end = np.concatenate(spans).T.copy()
    del spans
    compact = np.zeros(BUCKETS, np.int32)
    for at in range(0, len(flat), BLOCK):
        compact[flat[at : at + BLOCK]] = 1
    used = np.flatnonzero(compact)
    compact[used] = np.arange(len(used))
    for at in range(0, len(flat), BLOCK):
        flat[at : at + BLOCK] = compact[flat[at : at + BLOCK]]
    grams_before = running(sizes[tokens])

    def bags(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of the instances, one after another, and how many each has."""
        words = np.concatenate([tokens[begin[i] : end[i]] for i in part])
        n = sizes[words]
        first = np.cumsum(n) - n
        return flat[np.repeat(offsets[words] - first, n) + np.arange(n.sum())], grams_before[end[part]] - grams_before[begin[part]]

    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (len(used), DIMENSIONS))
    W = rng.normal(0, 0.1, (DIMENSIONS, 2))
    b = np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (E, W, b)]
    step = 0
    weight = np.where(y == 1, 0.5 / share, 1.0 / (1 - share))  # the calibration leans to leaving clean texts alone
    active = np.arange(len(owner))
    epochs = max(epochs, min(40, 400 * batch // len(owner)))  # a small sample takes more rounds
    for epoch in range(epochs):
        if epoch >= 2:  # from now on a toxic text is its best window
            v = E @ (W[:, 1] - W[:, 0])
            by_word = running(summed(v, flat, offsets)[tokens])
            score = (by_word[end] - by_word[begin]) / (grams_before[end] - grams_before[begin])
            del by_word
            order = np.lexsort((-score, owner))
            first = order[np.concatenate(([True], owner[order][1:] != owner[order][:-1]))]
            negatives = np.flatnonzero(y[owner] == 0)
            active = np.concatenate((first[y[owner[first]] == 1], negatives))
        positives = active[y[owner[active]] == 1]
        negatives = active[y[owner[active]] == 0]
        if len(negatives) > 3 * max(len(positives), 500):
            negatives = rng.choice(negatives, 3 * max(len(positives), 500), replace=False)
        todo = rng.permutation(np.concatenate((positives, negatives)))
        balance = np.where(y[owner] == 1, 0.5 / max(1, len(positives)), 0.5 / max(1, len(negatives))) * len(todo)
        for at in range(0, len(todo), batch):
            part = todo[at : at + batch]
            grams, lengths = bags(part)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            mean = np.add.reduceat(E[grams], starts) / lengths[:, None]
            z = mean @ W + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[owner[part]]] -= 1
            p *= (balance[part] / len(part))[:, None]
            each = np.repeat(p @ W.T / lengths[:, None], lengths, axis=0)
            gE = np.bincount((grams[:, None] * np.int64(DIMENSIONS) + np.arange(DIMENSIONS)).reshape(-1), each.reshape(-1), E.size)
            step += 1
            for q, g, (m, s) in zip((E, W, b), (gE, mean.T @ p, p.sum(0)), state, strict=True):
                adam(q, g, m, s, step, rate)
    values = np.zeros(BUCKETS)
    values[used] = E @ (W[:, 1] - W[:, 0])
    word_sum = summed(values[used], flat, offsets)
    tops = np.array([t if (t := top_window(word_sum[d], sizes[d])) is not None else np.nan for d in docs])
    ok = ~np.isnan(tops)
    slope, offset = logistic(tops[ok], y[ok], weight[ok])
    return Model(values, slope, offset, min(share, 0.49))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by ridge-damped Newton steps on the standardised score."""
    mid, scale = float(x.mean()), float(x.std()) or 1.0
    X = np.stack([(x - mid) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (weight * (p - y)) + 0.01 * w
        H = (X * (weight * p * (1 - p))[:, None]).T @ X + 0.01 * np.eye(2)
        w -= np.clip(np.linalg.solve(H, g), -2, 2)
    return float(w[0] / scale), float(w[1] - w[0] * mid / scale)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, training) -> tuple[list[str], list[int]]:
    """At most SAMPLE_ROWS rows of each class, as many as SAMPLE_CHARS characters hold, by the order of a hash of the id."""
    rows = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    text = docs.where(training).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).where("_text IS NOT NULL")
    # ids first, in one scan, so that no text is shuffled
    found = text.select("_id", F.length("_text").alias("_long"), F.xxhash64(F.col("_id").cast("string")).alias("_h")).join(rows, "_id").withColumn("_salt", F.pmod("_h", F.lit(SALTS)))
    for by, most in ((("_label", "_salt"), min(SAMPLE_ROWS, 1000)), (("_label",), SAMPLE_ROWS)):  # up to 1000 rows are cut before the shuffle
        found = found.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_id", "_long"))).where(F.col("_r") <= most)
    chosen, size = [], {0: 0, 1: 0}
    for r in found.orderBy("_label", "_r").collect():
        if size[r._label] + r._long <= SAMPLE_CHARS:
            size[r._label] += r._long
            chosen.append((r._id, r._label))
    ids = docs.sparkSession.createDataFrame(list(dict.fromkeys(chosen)), found.select("_id", "_label").schema)
    got = text.join(F.broadcast(ids), "_id").select("_text", "_label", F.xxhash64(F.col("_id").cast("string")).alias("_h")).distinct().collect()
    got = sorted(got, key=lambda r: (r[2], r[0]))[: 2 * SAMPLE_ROWS]
    return [r[0] for r in got], [r[1] for r in got]


class WordValues(dict):
    """Word -> sum of its n-grams' values, and their number."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def learn(self, texts: list[list[str]]) -> None:
        """Have every word of the texts at hand."""
        new = list(set().union(*texts).difference(self))
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(set().union(*texts))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            owner, grams = gram_ids([core(w) for w in part], GRAMS, BUCKETS)
            sums, counts = np.bincount(owner, self.values[grams], len(part)), np.bincount(owner, minlength=len(part))
            self.update(zip(part, zip(sums.tolist(), counts.tolist(), strict=True), strict=True))


def trained(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, training) -> Model:
    """The model of the sample; the driver's memory that the sample and the fit took goes back to the system."""
    model = train(*labelled_sample(docs, labels, id_col, text_col, label_col, training))
    gc.collect()
    released()
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id_col, score (0 to 1) and predicted (1 if score >= 0.5) of every row of docs.

    `training`: condition on docs; only its rows' labels are learned from.  Labels
    other than 0 and 1 count as missing; several labels of one id: the highest.
    Null, empty and blank texts get the training sample's share of toxic rows
    (below 0.5).  Without labels of both classes every score is that share.
    Repeated rows, also of a null id, are scored alike; extra columns have no effect;
    an empty table gives an empty result.  Long texts are scored whole.  Scoring is one
    narrow map over whole texts; only the sample goes to the driver.
    """
    model = trained(docs, labels, id_col, text_col, label_col, training)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int"

    def scored(batches):
        model = shared.value
        words = worker_cache(("toxicity", key), lambda: WordValues(model.values))
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                texts = [words_of(cell.as_py()) for cell in batch.column(1).slice(at, 256)]
                words.learn(texts)
                for text in texts:
                    both = np.array(list(map(words.__getitem__, text)), np.float64).reshape(-1, 2)
                    out.append(model.probability(top_window(both[:, 0], both[:, 1])))
            score = np.array(out, np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(scored, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, training, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs whose score stays below the threshold, with all their columns; see toxicity_scores for nulls and ties."""
    model = trained(docs, labels, id_col, text_col, label_col, training)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def passed(batches):
        model = shared.value
        words = worker_cache(("toxicity", key), lambda: WordValues(model.values))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [words_of(cell.as_py()) for cell in part.column(part.schema.get_field_index(text_col))]
                words.learn(texts)
                both = [np.array(list(map(words.__getitem__, t)), np.float64).reshape(-1, 2) for t in texts]
                yield part.filter(pa.array([model.probability(top_window(x[:, 0], x[:, 1])) < threshold for x in both]))

    return docs.mapInArrow(passed, docs.schema)
