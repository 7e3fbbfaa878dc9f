"""Language-model scores from a weighted backoff automaton.

Counts come from all training tokens: every word, then all pairs and triples of
words; an n-gram is kept when it is counted at least twice.  Smoothed n-grams (absolute discounting over an add-one-half
unigram model) become an automaton: a state for each context that has arcs, an
arc for each n-gram kept, and a failure arc, weighted by the context's backoff,
to the next shorter context.  One left-to-right traversal carries the state,
follows arcs and failures, and sums log10 probabilities; many texts walk side by
side in numpy.  That form needs the whole automaton in a worker, so it is for
corpora of at most MOST_CHARS characters; larger ones score by the same automaton in
partitions of its states (lm_parts), whatever their size.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .lm_parts import part_scores

#: Characters of all texts up to which the automaton is broadcast whole: half as many words, and n-grams of each order, at most.
MOST_CHARS = 4_000_000
DISCOUNT = 0.75
LANES = 2048
FLUSH = 400_000  # distinct words counted in a task before they are passed on
END = ""  # the end token; no word is empty


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return (text or "").encode("utf-8", "replace").lower().split()


class Automaton:
    """States 0 (root), contexts of one word, contexts of two; arcs sorted by state * words + word."""

    def __init__(self, root: np.ndarray, context: np.ndarray, pairs, triples, end: int):
        """root: log10 of each head word's unigram probability; context: how often each word is a context
        (the end token stands for the start of a text); pairs, triples: keys in base len(root), and counts."""
        n = self.words = len(root)
        self.root, self.end = root, end
        uni = 10.0**root
        pk, pc = _sorted(*pairs)
        u, v = pk // n, pk % n
        p2 = np.maximum(pc - DISCOUNT, 0.05) / context[u]
        ctx, inv = np.unique(u, return_inverse=True)
        single = np.zeros(n, np.int64)  # word -> its state, 0: none
        single[ctx] = 1 + np.arange(len(ctx))
        left = np.clip(1 - np.bincount(inv, p2, len(ctx)), 1e-9, 1) / np.clip(1 - np.bincount(inv, uni[v], len(ctx)), 1e-9, 1)
        weight, fail = [np.zeros(1), np.log10(left)], [np.zeros(1 + len(ctx), np.int64)]
        tk, tc = _sorted(*triples)
        known = np.isin(tk // n, pk)
        tk, tc = tk[known], tc[known]
        uv, w = tk // n, tk % n
        bi, inv3 = np.unique(uv, return_inverse=True)
        p3 = np.maximum(tc - DISCOUNT, 0.05) / pc[np.searchsorted(pk, uv)]
        vw = (uv % n) * n + w
        at = np.minimum(np.searchsorted(pk, vw), max(len(pk) - 1, 0))
        lower = np.where(pk[at] == vw, p2[at], left[np.maximum(single[uv % n] - 1, 0)] * uni[w]) if len(pk) and len(vw) else np.zeros(len(vw))
        left3 = np.clip(1 - np.bincount(inv3, p3, len(bi)), 1e-9, 1) / np.clip(1 - np.bincount(inv3, lower, len(bi)), 1e-9, 1)
        weight.append(np.log10(left3))
        fail.append(single[bi % n])
        first = 1 + len(ctx)

        def state_of(key):
            """The state after the words of a pair: the pair's own if it has arcs, else its last word's."""
            if not len(bi):
                return single[key % n]
            at = np.minimum(np.searchsorted(bi, key), len(bi) - 1)
            return np.where(bi[at] == key, first + at, single[key % n])

        self.weight, self.fail = np.concatenate(weight), np.concatenate(fail)
        self.root_next = single
        self.keys = np.concatenate((single[u] * n + v, (first + inv3) * n + w))
        self.arc = np.concatenate((np.log10(p2), np.log10(p3))) if len(pk) else np.zeros(0)
        self.next = np.concatenate((state_of(pk), state_of(vw))) if len(pk) else np.zeros(0, np.int64)
        if not len(self.keys):
            self.keys, self.arc, self.next = np.array([-1]), np.zeros(1), np.zeros(1, np.int64)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text (ids of its words; -1: not in the head, whose unigram part is left out), its end included."""
        out = np.zeros(len(texts))
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            lengths = np.array([len(texts[i]) + 1 for i in lanes])
            active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
            first = np.concatenate(([0], np.cumsum(active)))
            by_step = np.full(first[-1], self.end, np.int64)
            for lane, i in enumerate(lanes):
                by_step[first[: lengths[lane] - 1] + lane] = texts[i]
            total = np.zeros(len(lanes))
            state = np.full(len(lanes), self.root_next[self.end])
            for t in range(lengths[0]):
                a = active[t]
                word, s = by_step[first[t] : first[t] + a], state[:a]
                todo = np.flatnonzero(s)  # not at the root
                while len(todo):
                    key = s[todo] * self.words + word[todo]
                    key[word[todo] < 0] = -2
                    place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    hit = self.keys[place] == key
                    go = todo[hit]
                    total[go] += self.arc[place[hit]]
                    s[go] = -1 - self.next[place[hit]]  # done with this word
                    todo = todo[~hit]
                    total[todo] += self.weight[s[todo]]
                    s[todo] = self.fail[s[todo]]
                    todo = todo[s[todo] > 0]
                here = np.flatnonzero(s == 0)
                w = word[here]
                inside = w >= 0
                total[here[inside]] += self.root[w[inside]]
                s[here[inside]] = -1 - self.root_next[w[inside]]
                moved = s < 0
                s[moved] = -1 - s[moved]
            out[lanes] = total
        return out


def _sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return np.asarray(keys, np.int64)[order], np.asarray(counts, np.float64)[order]


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """_word and _c over all rows, the end token once a row.  Counted in each task before the shuffle."""

    def counted(batches):
        tally, rows = Counter(), 0
        for batch in batches:
            for cell in batch.column(0):
                tally.update(words_of(cell.as_py()))
                rows += 1
                if len(tally) > FLUSH:
                    yield _pairs(tally)
                    tally = Counter()
        if rows:
            tally[END.encode()] += rows
        yield _pairs(tally)

    parts = docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(counted, "_word string, _n bigint")
    return parts.groupBy("_word").agg(F.sum("_n").alias("_c"))


def _pairs(tally: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in tally], pa.string()), pa.array(tally.values(), pa.int64())], names=["_word", "_n"])


def count_grams(ids: DataFrame, size: int, words: int, start: int, allowed=None) -> DataFrame:
    """_key (word ids in base `words`) and _c of all runs of `size` head words; a text starts with `start` and ends with it.

    allowed: broadcast sorted keys of the pairs that a triple's two pairs must be among.
    """

    def counted(batches):
        held, n = [], 0
        for batch in batches:
            column = batch.column(0)
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(column.offsets) - column.offsets[0].as_py()
            # every text between two start marks; runs may not cross a mark
            marks = offsets[:-1] + np.arange(len(offsets) - 1)
            seq = np.empty(len(flat) + len(offsets), np.int64)
            is_mark = np.zeros(len(seq), bool)
            is_mark[np.append(marks, len(seq) - 1)] = True
            seq[is_mark], seq[~is_mark] = start, flat
            ok = seq >= 0
            if size == 2:
                keys = (seq[:-1] * words + seq[1:])[ok[:-1] & ok[1:]]
            else:
                good = ok[:-2] & ok[1:-1] & ok[2:] & ~is_mark[1:-1]
                a, b, c = seq[:-2][good], seq[1:-1][good], seq[2:][good]
                left, right = a * words + b, b * words + c
                kept = _among(allowed.value, left)
                kept[kept] = _among(allowed.value, right[kept])
                keys = left[kept] * words + c[kept]
            held.append(keys)
            n += len(keys)
            if n > 4_000_000:
                yield _counts(held)
                held, n = [], 0
        if n:
            yield _counts(held)

    return ids.select("_ids").mapInArrow(counted, "_key bigint, _n bigint").groupBy("_key").agg(F.sum("_n").alias("_c"))


def _among(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _counts(held: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["_key", "_n"])


def kept_grams(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Those counted at least twice, keys ascending."""
    table = counts.where("_c >= 2").toArrow()
    return _sorted(table["_key"].to_numpy(), table["_c"].to_numpy())


def lm_scores(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    `training`: condition on docs; its rows are learned from.  A null text is an
    empty one: its only token is the end.  Without training rows every token has the
    same probability.  Repeated rows are learned from and scored one by one; rows
    that share an id, or have none, stay apart.  A very long text is a block of its
    own.  An empty table gives an empty result.  Extra columns have no effect.

    All n-grams of the training rows counted at least twice are arcs.  Up to
    MOST_CHARS characters the automaton is broadcast and walks over every text;
    beyond, tokens visit its partitions.  Words beyond the most frequent ones are
    told apart there by 63 bits of a hash.
    """
    picked = docs.select(F.col(id_col).alias("_id"), F.coalesce(training, F.lit(False)).alias("_train"), F.col(text_col).cast("string").alias("_text"))
    chars, rows = picked.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0)), F.count("*")).first()
    found = walked_scores(picked) if chars <= MOST_CHARS else part_scores(picked, rows, words_of, DISCOUNT)
    return found.withColumnRenamed("_id", id_col)


def walked_scores(docs: DataFrame) -> DataFrame:
    """_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (_id, _train, _text); all words and arcs are broadcast."""
    spark = docs.sparkSession
    vocab = sorted(((r[0].encode(), r[1]) for r in count_words(docs.where("_train"), "_text").collect()), key=lambda r: (-r[1], r[0]))
    total = sum(c for _, c in vocab)
    norm = total + 0.5 * (len(vocab) + 1)
    number = {w: i for i, (w, _) in enumerate(vocab)}
    end = number.setdefault(END.encode(), len(number))
    counts = np.array([c for _, c in vocab] + [0] * (len(number) - len(vocab)), np.float64)
    shared_number = spark.sparkContext.broadcast(number)

    def numbered(batches):
        find = shared_number.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [np.array([find(w, -1) for w in words_of(cell.as_py())], np.int32) for cell in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["_id", "_train", "_ids"])

    kind = docs.schema["_id"].dataType.simpleString()
    ids = written(docs.mapInArrow(numbered, f"_id {kind}, _train boolean, _ids array<int>"), "lm-ids")
    pairs = kept_grams(count_grams(ids.where("_train"), 2, len(counts), end))
    triples = kept_grams(count_grams(ids.where("_train"), 3, len(counts), end, spark.sparkContext.broadcast(pairs[0])))
    shared = spark.sparkContext.broadcast((Automaton(np.log10((counts + 0.5) / norm), np.maximum(counts, 1.0), pairs, triples, end), counts > 0, float(np.log10(0.5 / norm))))

    def walked(batches):
        automaton, known, unseen = shared.value
        for batch in batches:
            texts = [np.asarray(x.values) for x in batch.column(1)]
            new = np.array([(t < 0).sum() for t in texts]) * unseen
            base = np.array([automaton.root[t[t >= 0]].sum() for t in texts]) + automaton.root[automaton.end] + new
            n_known = np.array([known[t[t >= 0]].sum() for t in texts], np.int64) + int(known[automaton.end])
            columns = pa.array(np.array([len(t) + 1 for t in texts], np.int64)), pa.array(n_known), pa.array(np.full(len(texts), total, np.int64)), pa.array(base), pa.array(automaton.scores(texts) + new)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ids.select("_id", "_ids").mapInArrow(walked, f"_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
