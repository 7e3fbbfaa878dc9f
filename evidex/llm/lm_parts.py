"""The backoff automaton in partitions of its states, for models that no worker could hold.

The state after a word depends on that word and the one before it, so all states
of a word v, with their arcs and failure arcs, belong to one partition: the hash
of v.  Every token visits the partition of its state once: a text is a cycle
(end token, its words) whose records (u, v, w) are the word before, the word, and
the word after.  What a record needs is then in its partition, but for one number
a word, the unigram probability of its followers, which comes back by a sum:

* whether v itself came by an arc from u, and v's unigram probability if not;
* the arc from (u, v) to w, or the failure weight of (u, v) and the arc from v to
  w, or both failure weights.

Records travel as packed arrays, one row a block of texts and partition.  A partition is worked on
in slices of its words.  A word of more than HOT_TOKENS tokens is dealt over several
partitions by the word before it, a pair of as many by block; counts that then lie in several
partitions (of pairs, and of triples) are put together by joins, one row for each
distinct pair or triple of a partition.
"""

from __future__ import annotations

import math
import struct
from collections import Counter, defaultdict
from collections.abc import Iterable
from itertools import chain, compress, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, released, written

#: Tokens of a partition, of a slice of it, of a word that is dealt over several, and of a block of texts.
PART_TOKENS, SLICE_TOKENS, HOT_TOKENS, BLOCK_TOKENS = 4_000_000, 200_000, 2_000_000, 400_000
#: Texts sampled to number frequent words (which only makes records smaller) and to tell hot words, and how many are numbered.
SAMPLE_DOCS, NUMBERED = 4000, 1 << 17
SCALE = 1e10  # log probabilities travel as whole multiples of 1 / SCALE, which add up alike in any order
END = 0  # the end token's code, at a text's start too
IDS, PLAIN, BY_PAIR, BY_BLOCK = 0, 1, 2, 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 32 or 64 bit integers and doubles as bytes: their planes, compressed."""
    import zstandard

    head = struct.pack(f"<B{len(arrays)}I", len(arrays), *map(len, arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays if len(a)))


def unpacked(data: bytes, kinds: str) -> list[np.ndarray]:
    """The arrays again; kinds: a numpy type code of each."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = struct.unpack_from(f"<{raw[0]}I", raw, 1), 1 + 4 * raw[0], []
    for n, kind in zip(sizes, kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).ravel() if n else np.zeros(0, kind))
        at += n * width
    return out


def sampled(docs: DataFrame, rows: int, words_of):
    """A sample of the texts, by a hash.  What is learned from it decides where records go, never what they count."""
    chosen = F.pmod(F.xxhash64(F.length("_text"), F.substring("_text", 1, 64), F.substring("_text", -64, 64)), F.lit(max(1, rows // SAMPLE_DOCS))) == 0

    def top(tally_of, most: int) -> dict:
        """The sample's most frequent items; None: tokens, b"": texts (no item is empty)."""

        def counted(batches):
            tally, tokens, texts = Counter(), 0, 0
            for batch in batches:
                for cell in batch.column(0):
                    words = words_of(cell.as_py())
                    tally_of(tally, words)
                    tokens, texts = tokens + len(words) + 1, texts + 1
            yield pa.RecordBatch.from_arrays([pa.array([None, b"", *tally], pa.binary()), pa.array([tokens, texts, *tally.values()], pa.int64())], names=["w", "n"])

        table = docs.where(chosen).select("_text").mapInArrow(counted, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
        special = F.when(F.col("w").isNull(), 2).when(F.length("w") == 0, 1).otherwise(0)
        return {None if r[0] is None else bytes(r[0]): r[1] for r in table.orderBy(special.desc(), F.desc("n"), "w").limit(most + 2).collect()}

    return top


def layout(docs: DataFrame, rows: int, words_of) -> tuple[dict[bytes, int], int, dict[int, int], dict[int, int]]:
    """Codes of frequent words, partitions, and over how many partitions hot words (by code) and hot pairs (by hash) are dealt."""
    top = sampled(docs, rows, words_of)
    n = top(lambda tally, words: tally.update(words), NUMBERED)
    total, texts = n.pop(None, 0), n.pop(b"", 0)
    code = {b"": END} | {w: k + 1 for k, w in enumerate(n)}
    tokens = rows * (total / texts if texts else 1.0)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens / PART_TOKENS))
    each = tokens / max(1, total)  # tokens that one of the sample stands for
    hot = {w: math.ceil(c * each / HOT_TOKENS) for w, c in [(b"", texts), *n.items()] if c * each > HOT_TOKENS}
    pairs = {}
    if hot:

        def among(tally, words):
            seq = [b"", *words]
            tally.update(u + b" " + v for u, v in zip([seq[-1], *seq], seq, strict=False) if v in hot)  # words hold no blank

        n = top(among, NUMBERED)
        del n[None], n[b""]
        for both, c in n.items():
            if c * each > HOT_TOKENS:
                u, v = both.split(b" ")
                pairs[pair_hash(np.array([code_of(u, code)]), np.array([code_of(v, code)]))[0].item()] = math.ceil(c * each / HOT_TOKENS)
    return code, parts, {code[w]: m for w, m in hot.items()}, pairs


def code_of(word: bytes, code: dict[bytes, int]) -> int:
    """Its number, or a hash below zero."""
    import xxhash

    found = code.get(word)
    return found if found is not None else (xxhash.xxh3_64_intdigest(word) | 1 << 63) - (1 << 64)


def codes_of(words: Iterable[bytes], n: int, code: dict[bytes, int]) -> np.ndarray:
    """code_of each of n words."""
    import xxhash

    out = np.fromiter(map(code.get, words, repeat(-1)), np.int64, n)
    rare = out < 0
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, compress(words, rare.tolist())), np.uint64, int(rare.sum()))
    out[rare] = (hashes | np.uint64(1 << 63)).view(np.int64)
    return out


def _order(key: np.ndarray) -> np.ndarray:
    """As np.argsort(key, kind="stable"); where they fit, the keys are sorted with their places below them, which takes less time."""
    bits = len(key).bit_length()
    if not len(key) or key.min() < 0 or int(key.max()).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort(key.astype(np.int64) << bits | np.arange(len(key))) & ((1 << bits) - 1)


def _dealt_order(group: np.ndarray) -> np.ndarray:
    """As np.argsort(group, kind="stable") for numbers of groups, which mostly fit 16 bits."""
    return np.argsort(group.astype(np.uint16, copy=False) if group.max(initial=0) < 1 << 16 else group, kind="stable")


def _placed(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of x (from 0, below size), ascending, and each one's place among them."""
    if size > 8 * len(x):
        values, at = np.unique(x, return_inverse=True)
        return values, at.ravel()
    there = np.zeros(size, bool)
    there[x] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[x]


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (_mixed(u ^ _mixed(v).view(np.int64)) >> np.uint64(1)).view(np.int64)


class Table:
    """Sorted keys and their values, for many lookups at once."""

    def __init__(self, values: dict[int, float]):
        self.keys = np.array(sorted(values), np.int64)
        self.values = np.array([values[k] for k in sorted(values)], np.float64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values; 0 for keys that aren't there."""
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0.0)


def records(docs: DataFrame, words_of, parts: int, shared, only_hot: bool = False) -> DataFrame:
    """part, block, kind and payload: the packed records of each block for each partition, and the blocks' ids.

    shared: broadcast code and tables of hot words and pairs, see layout(); only_hot: records of dealt words only.
    """

    def block_rows(block: int, ids: list[pa.Array], train: list[bool], texts: list[list[bytes]]):
        number, hot_parts, pair_parts = shared.value
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        own = defaultdict(count(1).__next__)  # a word's number in this block
        flat = np.fromiter(map(own.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()) - len(texts))
        codes = np.concatenate((np.array([END], np.int64), codes_of(own, len(own), number)))
        home, dealt = (_mixed(codes) % np.uint64(parts)).astype(np.int64), hot_parts(codes).astype(np.int64)
        order = np.lexsort((codes, home, dealt > 0))  # words of one partition stand together
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes, home, dealt = codes[order], home[order], dealt[order]
        first = np.cumsum(sizes) - sizes
        seq = np.empty(sizes.sum(), np.int64)
        inner = np.ones(len(seq), bool)
        inner[first] = False
        seq[first] = rank[0]
        seq[inner] = rank[flat]
        u, w = np.empty_like(seq), np.empty_like(seq)
        u[1:], w[:-1] = seq[:-1], seq[1:]
        last = first + sizes - 1
        u[first], w[last] = seq[last], rank[0]
        row = np.repeat(np.arange(len(texts)) * 2 + np.array(train, np.int64), sizes)
        by = np.flatnonzero(dealt[seq]) if only_hot else np.arange(len(seq))
        by = by[_order(seq[by] * len(codes) + w[by])]
        u, v, w, row = u[by], seq[by], w[by], row[by]
        place, kind = home[v], np.full(len(v), PLAIN)
        some = np.flatnonzero(dealt[v])
        if len(some):
            both = pair_hash(codes[u[some]], codes[v[some]])
            often = pair_parts(both).astype(np.int64)
            spread = int(_mixed(np.array([block]))[0]) & 0x7FFFFFFF
            place[some] = (place[some] + both % dealt[v[some]] + np.where(often > 0, spread % np.maximum(often, 1), 0)) % parts
            kind[some] = np.where(often > 0, BY_BLOCK, BY_PAIR)
            by = _dealt_order(kind * parts + place)
            u, v, w, row, place, kind = u[by], v[by], w[by], row[by], place[by], kind[by]
        group = kind * parts + place
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        by_code = np.argsort(codes)
        new = np.empty(len(codes), np.int64)
        new[by_code] = np.arange(len(codes))
        ordered = codes[by_code]
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(v)), strict=True):
            words, at = _placed(new[np.concatenate((u[a:b], v[a:b], w[a:b]))], len(codes))
            at, n = at.astype(np.uint32), b - a
            data = packed(np.diff(ordered[words], prepend=0), at[:n], np.diff(at[n : 2 * n], prepend=np.uint32(0)), np.diff(at[2 * n :], prepend=np.uint32(0)), row[a:b].astype(np.uint32))
            out.append((int(place[a]), block, int(kind[a]), data))
        if not only_hot:
            sink = pa.BufferOutputStream()
            table = pa.table({"id": pa.concat_arrays(ids)})
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            out.append((block % parts, block, IDS, struct.pack("<I", len(sizes)) + sizes.tobytes() + sink.getvalue().to_pybytes()))
        if not out:
            out = [(0, block, -1, b"")]
        released()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "block", "kind", "payload"])

    def emitted(batches):
        block, ids, train, texts, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            begin = 0
            for k, cell in enumerate(batch.column(2)):
                texts.append(words_of(cell.as_py()))
                train.append(batch.column(1)[k].as_py())
                held += len(texts[-1]) + 1
                if held >= BLOCK_TOKENS:
                    yield block_rows(block, [*ids, batch.column(0).slice(begin, k + 1 - begin)], train, texts)
                    block, ids, train, texts, held, begin = block + 1, [], [], [], 0, k + 1
            if begin < batch.num_rows:
                ids.append(batch.column(0).slice(begin))
        if texts:
            yield block_rows(block, ids, train, texts)

    rows = docs.select("_id", "_train", "_text").mapInArrow(emitted, "part int, block bigint, kind int, payload binary")
    return rows.repartition(parts, "part")


def _joined(pieces: list, words: list | None = None, kind=np.int32) -> np.ndarray:
    """The pieces, one after the other, each taken from its words where they are given; they are freed on the way, as a partition is large."""
    out, at = np.empty(sum(map(len, pieces)), kind), 0
    for k, x in enumerate(pieces):
        out[at : at + len(x)] = x if words is None else words[k][x]
        pieces[k], at = None, at + len(x)
    return out


class Part:
    """A partition's records of one kind: codes of its words, and u, v, w (places among the codes), text and train of each record.

    texts: block and row of each text; a block's texts stand together.
    """

    def __init__(self, table: pa.Table, kind: int):
        words, columns, self.texts = [], ([], [], [], [], []), []
        n = 0
        for block, k, payload in zip(table["block"], table["kind"], table["payload"], strict=True):
            if k.as_py() == kind:
                own, u, v, w, row = unpacked(payload.as_py(), "qIIII")
                rows, text = _placed(row >> 1, int(row.max()) // 2 + 1)
                words.append(np.cumsum(own))
                for to, x in zip(columns, (u.astype(np.int32), np.cumsum(v, dtype=np.uint32).astype(np.int32), np.cumsum(w, dtype=np.uint32).astype(np.int32), (text + n).astype(np.int32), (row & 1).astype(bool)), strict=True):
                    to.append(x)
                self.texts.append((block.as_py(), n, rows.astype(np.uint32)))
                n += len(rows)
        self.codes = np.concatenate(words) if words else np.zeros(0, np.int64)
        self.codes.sort()
        self.codes = self.codes[np.append(True, self.codes[1:] != self.codes[:-1])[: len(self.codes)]]
        for k, c in enumerate(words):
            words[k] = np.searchsorted(self.codes, c).astype(np.int32)
        self.u, self.v, self.w = (_joined(columns[k], words) for k in range(3))
        self.text, self.train = _joined(columns[3]), _joined(columns[4], kind=bool)
        self.n_texts = n

    def slices(self, by: str = "v"):
        """Parts of about SLICE_TOKENS records, those of a word (v, or the one before it) in one, and the places of their records."""
        word = getattr(self, by)
        count = np.bincount(word, minlength=len(self.codes))
        of = (np.cumsum(count) - count) // SLICE_TOKENS  # by word
        of = of.astype(np.uint16) if of.max(initial=0) < 1 << 16 else of
        order = _dealt_order(of[word]).astype(np.int32)
        ends = np.cumsum(np.bincount(of, count).astype(np.int64)) if len(of) else []
        begin = 0
        for end in ends:
            if end > begin:
                at, part = order[begin:end], object.__new__(Part)
                words = np.zeros(len(self.codes), bool)
                for x in (self.u, self.v, self.w):
                    words[x[at]] = True
                new = np.cumsum(words, dtype=np.int32) - 1
                part.codes, part.train = self.codes[words], self.train[at]
                part.u, part.v, part.w = new[self.u[at]], new[self.v[at]], new[self.w[at]]
                yield at, part
            begin = end

    def pair(self, a: str, b: str) -> np.ndarray:
        """Two words' places as one number."""
        return getattr(self, a).astype(np.int64) * max(1, len(self.codes)) + getattr(self, b)


def _grouped(key: np.ndarray, weight: np.ndarray):
    """Distinct keys, each record's place among them, and the sums of weight."""
    order = _order(key)
    keys = key[order]
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - 1
    keys = keys[first]
    return keys, at, np.bincount(at, weight, len(keys))


def _clip(x):
    return np.clip(x, 1e-9, 1.0)


def visits(p: Part, discount: float, mass: np.ndarray, told: pa.Table | None = None, c1: Table | None = None, a2: Table | None = None, whole: bool = False):
    """What each record adds to its text's sums: log10 of the arcs and failure weights taken from (u, v), and of v's unigram where no
    arc led to v; of v's unigram; whether no arc led to v; whether v is known.  mass: unigrams after each word's arcs, summed.

    Where v is dealt, the counts of (v, w) come from rows, and those of v and the sum over its arcs (a2) by word; where (u, v) is,
    theirs come from rows too.
    """
    n = max(1, len(p.codes))
    arc = lambda c, of: np.where(c >= 2, np.maximum(c - discount, 0.05) / np.maximum(of, 1), 0.0)
    if told is None:
        count = np.bincount(p.v, p.train, n)
        pairs, at, c = _grouped(p.pair("v", "w"), p.train)
        p2 = arc(c, count[pairs // n])
        left = 1 - np.bincount(pairs // n, p2, n)
        p2 = p2[at]
        del pairs, at, c
    else:
        of = found(p, told.filter(pa.compute.is_null(told["u"])), "vw")
        count, left = c1(p.codes), 1 - a2(p.codes)
        p2 = arc(of("c2"), count[p.v])
    with np.errstate(divide="ignore"):
        go = np.where(p2 > 0, np.log10(p2), np.log10(_clip(left) / _clip(1 - mass))[p.v])
    if whole:
        of = found(p, told.filter(pa.compute.is_valid(told["u"])), "uvw")
        cu = of("cu")
        p3, b3 = arc(of("c3"), cu), np.log10(_clip(1 - of("a3")) / _clip(1 - of("l3")))
    else:
        before, at, cu = _grouped(p.pair("u", "v"), p.train)
        triples, at3, c3 = _grouped(at.astype(np.int64) * n + p.w, p.train)
        c3[p.codes[before[triples // n] % n] == END] = 0  # a text's first word has one word before it
        p3, lower = arc(c3, cu[triples // n]), np.zeros(len(triples))
        lower[at3] = p2
        b3 = np.log10(_clip(1 - np.bincount(triples // n, p3, len(before))) / _clip(1 - np.bincount(triples // n, np.where(c3 >= 2, lower, 0.0), len(before))))[at]
        cu, p3 = cu[at], p3[at3]
        del before, at, triples, at3, c3, lower
    with np.errstate(divide="ignore"):
        go = np.where(p3 > 0, np.log10(p3), b3 + go)
    base = np.log10(count + 0.5)[p.v]
    return go + np.where(cu < 2, base, 0.0), base, cu < 2, (count > 0)[p.v]


def found(p: Part, rows: pa.Table, words: str):
    """Column -> its value in the row of each record's words (every record has one)."""
    places = {c: np.minimum(np.searchsorted(p.codes, rows[c].to_numpy()), max(len(p.codes) - 1, 0)) for c in words}
    rows = rows.filter(pa.array(np.all([p.codes[places[c]] == rows[c].to_numpy() for c in words], axis=0)))  # of these words only
    mine, theirs = [getattr(p, c) for c in words], [np.searchsorted(p.codes, rows[c].to_numpy()) for c in words]
    a, b, n = mine[0].astype(np.int64), theirs[0].astype(np.int64), max(1, len(p.codes))
    for x, y in zip(mine[1:], theirs[1:], strict=True):
        keys, at = np.unique(np.concatenate((b * n + y, a * n + x)), return_inverse=True)
        at = at.ravel()
        b, a = at[: len(b)], at[len(b) :]
    place = np.zeros(int(max(b.max(initial=0), a.max(initial=0))) + 1, np.int64)
    place[b] = np.arange(len(b))
    return lambda column: rows[column].to_numpy().astype(np.float64)[place[a]] if len(a) else np.zeros(0)


def put_together(rows: DataFrame, discount: float) -> tuple[DataFrame, dict[int, float], dict[int, float], dict[int, float]]:
    """What partitions must be told of dealt words: part, u, v, w and counts; c1 and a2 (the sum over v's arcs) by word; c1 + 0.5 of the
    words after a word, summed over its dealt pairs.  The dictionaries have an entry a dealt word or pair, at most tokens / HOT_TOKENS."""

    def distinct(table: pa.Table) -> pa.Table:
        out = []
        part = table["part"][0].as_py()
        for kind in (BY_PAIR, BY_BLOCK):
            p = Part(table, kind)
            n = max(1, len(p.codes))
            pairs, at, c = _grouped(p.pair("v", "w"), p.train)
            out.append(pa.table({"part": pa.array(np.full(len(c), part), pa.int32()), "u": pa.nulls(len(c), pa.int64()), "v": pa.array(p.codes[pairs // n] if len(c) else [], pa.int64()), "w": pa.array(p.codes[pairs % n] if len(c) else [], pa.int64()), "n": pa.array(c, pa.float64())}))
            if kind == BY_BLOCK:
                triples, _, c = _grouped(at.astype(np.int64) * n + p.u, p.train)
                both = pairs[triples // n]
                out.append(pa.table({"part": pa.array(np.full(len(c), part), pa.int32()), **{k: pa.array(p.codes[x] if len(c) else [], pa.int64()) for k, x in (("u", triples % n), ("v", both // n), ("w", both % n))}, "n": pa.array(c, pa.float64())}))
        return pa.concat_tables(out)

    own = written(rows.groupBy("part").applyInArrow(distinct, "part int, u bigint, v bigint, w bigint, n double"), "lm-dealt")
    share = lambda c, of: F.when(F.col(c) >= 2, F.greatest(F.col(c) - discount, F.lit(0.05)) / F.greatest(F.col(of), F.lit(1.0))).otherwise(0.0)
    pairs, triples = own.where("u IS NULL").drop("u"), own.where("u IS NOT NULL")
    t2 = written(pairs.groupBy("v", "w").agg(F.sum("n").alias("c2")), "lm-dealt2")
    t1 = t2.groupBy("v").agg(F.sum("c2").alias("c1"))
    c1 = {r[0]: r[1] for r in t1.collect()}
    p2 = t2.join(F.broadcast(t1), "v").withColumn("p2", share("c2", "c1"))
    a2 = {r[0]: r[1] for r in p2.groupBy("v").agg(F.sum("p2")).collect()}
    t3 = triples.groupBy("u", "v", "w").agg(F.sum("n").alias("c3"))
    tu = t3.groupBy("u", "v").agg(F.sum("c3").alias("cu"))
    arcs = t3.withColumn("c3", F.when(F.col("v") == END, 0.0).otherwise(F.col("c3"))).join(F.broadcast(tu), ["u", "v"]).join(p2.select("v", "w", "p2"), ["v", "w"])
    arcs = written(arcs.withColumn("p3", share("c3", "cu")), "lm-dealt3")
    sums = arcs.groupBy("u", "v").agg(F.max("cu").alias("cu"), F.sum("p3").alias("a3"), F.sum(F.when(F.col("c3") >= 2, F.col("p2")).otherwise(0.0)).alias("l3"))
    after: dict[int, float] = {}
    for u, v, cu in sums.select("u", "v", "cu").collect():
        if cu >= 2:
            after[u] = after.get(u, 0.0) + c1[v] + 0.5
    none = [F.lit(None).cast("double").alias(c) for c in ("c3", "cu", "a3", "l3")]
    told = pairs.drop("n").join(t2, ["v", "w"]).select("part", F.lit(None).cast("bigint").alias("u"), "v", "w", "c2", *none)
    whole = triples.drop("n").join(arcs.select("u", "v", "w", "c3"), ["u", "v", "w"]).join(F.broadcast(sums), ["u", "v"])
    told = written(told.unionByName(whole.select("part", "u", "v", "w", F.lit(None).cast("double").alias("c2"), "c3", "cu", "a3", "l3")), "lm-told")
    dropped(own, t2, arcs)
    return told, c1, a2, after


def part_scores(docs: DataFrame, rows: int, words_of, discount: float) -> DataFrame:
    """_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (_id, _train, _text); rows: their number."""
    spark = docs.sparkSession
    code, parts, hot, pairs = layout(docs, rows, words_of)
    shared = spark.sparkContext.broadcast((code, Table(hot), Table(pairs)))
    told, c1, a2, after = put_together(records(docs, words_of, parts, shared, only_hot=True), discount) if hot else (None, {}, {}, {})
    rows = records(docs, words_of, parts, shared)
    dealt = spark.sparkContext.broadcast((Table(hot), Table(c1), Table(a2)))
    home = lambda codes: (_mixed(codes) % np.uint64(parts)).astype(np.int64)

    def summed(table: pa.Table) -> pa.Table:
        """c1 + 0.5 of this partition's words, summed by the words that have an arc to them; training tokens and types of its own words."""
        hot_parts, hot_c1, _ = dealt.value
        after = np.zeros(0, np.int64), np.zeros(0)
        totals = [0.0, 0.0]
        for kind in (PLAIN, BY_PAIR):
            for _, p in Part(table, kind).slices("v" if kind == PLAIN else "u"):
                n = len(p.codes)
                count = np.bincount(p.v, p.train, n) if kind == PLAIN else hot_c1(p.codes)
                before, _, cu = _grouped(p.pair("u", "v"), p.train)
                kept = before[cu >= 2]
                codes, _, s = _grouped(np.concatenate((after[0], p.codes[kept // n])), np.concatenate((after[1], count[kept % n] + 0.5)))
                after = codes, s
                if kind == PLAIN:
                    totals = [totals[0] + float(count.sum()), totals[1] + float((count > 0).sum())]
            _ = p = None  # a slice keeps its partition's order
        released()
        part, u, s = np.where(hot_parts(after[0]) > 0, -1, home(after[0])).tolist(), after[0].tolist(), after[1].tolist()
        return pa.table({"part": pa.array([*part, None], pa.int32()), "v": pa.array([*u, None], pa.int64()), "s": pa.array([*s, totals[0]], pa.float64()), "types": pa.array([*[None] * len(u), totals[1]], pa.float64())})

    sums = rows.groupBy("part").applyInArrow(summed, "part int, v bigint, s double, types double")
    nothing = F.lit(None)
    more = [(-1 if u in hot else int(home(np.array([u]))[0]), u, x, None) for u, x in after.items()] + [(None, None, float(sum(c1.values())), float(sum(x > 0 for x in c1.values())))] * bool(c1)
    sums = sums.unionByName(spark.createDataFrame(more, "part int, v bigint, s double, types double"))
    # a word's sum goes to its partition, a dealt word's to all it can be in, and the totals (null) to all partitions
    spread = spark.createDataFrame([(k, sorted({(int(home(np.array([k]))[0]) + i) % parts for i in range(min(parts, m + max(pairs.values(), default=0)))})) for k, m in hot.items()], "v bigint, homes array<int>")
    sums = sums.groupBy("part", "v").agg(F.sum("s").alias("s"), F.sum("types").alias("types")).join(F.broadcast(spread), "v", "left")
    to = F.when(F.col("part").isNull(), F.sequence(F.lit(0), F.lit(parts - 1))).when(F.col("part") < 0, F.col("homes")).otherwise(F.array("part"))
    counts = ("c2", "c3", "cu", "a3", "l3")
    extra = sums.select(F.explode(to).alias("part"), F.when(F.col("part").isNull(), 0).otherwise(1).alias("kind"), "s", "types", nothing.cast("bigint").alias("u"), "v", nothing.cast("bigint").alias("w"), *[nothing.cast("double").alias(c) for c in counts])
    if hot:
        extra = extra.unionByName(told.select("part", F.lit(2).alias("kind"), nothing.cast("double").alias("s"), nothing.cast("double").alias("types"), "u", "v", "w", *counts))

    def visited(left: pa.Table, right: pa.Table) -> pa.Table:
        """By block: the packed sums of its rows' visits to this partition; ids pass through with the number of training tokens."""
        kind = right["kind"].to_numpy()
        total, types = (float(right[c].to_numpy()[kind == 0].sum()) for c in ("s", "types"))
        norm = total + 0.5 * (types + 1)
        after = right.filter(pa.array(kind == 1))
        fv, fs = after["v"].to_numpy(), after["s"].to_numpy()
        order = np.argsort(fv)
        fv, fs = fv[order], fs[order]
        out = []
        of_dealt = right.filter(pa.array(kind == 2))
        for which in (PLAIN, BY_PAIR, BY_BLOCK):
            whole = Part(left, which)
            if not len(whole.u):
                continue
            sums = [np.zeros(whole.n_texts) for _ in range(4)]
            for some, p in whole.slices("v" if which == PLAIN else "u"):
                mass = np.zeros(len(p.codes))
                if len(fv):
                    place = np.minimum(np.searchsorted(fv, p.codes), len(fv) - 1)
                    mass = np.where(fv[place] == p.codes, fs[place], 0.0) / norm
                for to, x, scale in zip(sums, visits(p, discount, mass, *((of_dealt, *dealt.value[1:], which == BY_BLOCK) if which != PLAIN else ())), (SCALE, SCALE, 1, 1), strict=True):
                    to += np.bincount(whole.text[some], x, whole.n_texts) * scale
            for block, a, texts in whole.texts:
                own = [np.rint(x[a : a + len(texts)]) for x in sums]
                out.append((block, PLAIN, packed(np.diff(texts, prepend=np.uint32(0)), *(x.astype(np.int64) for x in own[:2]), *(x.astype(np.uint32) for x in own[2:]))))
            del whole, some, p, sums, own
        for b, k, data in zip(left["block"], left["kind"], left["payload"], strict=True):
            if k.as_py() == IDS:
                out.append((b.as_py(), IDS, struct.pack("<dd", total, math.log10(norm)) + data.as_py()))
        released()
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "kind", "payload"])

    seen = rows.groupBy("part").cogroup(extra.groupBy("part")).applyInArrow(visited, "block bigint, kind int, payload binary")
    kind = docs.schema["_id"].dataType.simpleString()

    def gathered(table: pa.Table) -> pa.Table:
        """The block's rows: ids and the sums over all partitions."""
        kinds = table["kind"].to_numpy()
        data = table["payload"][int(np.flatnonzero(kinds == IDS)[0])].as_py()
        total, log_norm = struct.unpack_from("<dd", data)
        (n,) = struct.unpack_from("<I", data, 16)
        sizes = np.frombuffer(data, np.int64, n, 20)
        ids = pa.ipc.open_stream(data[20 + 8 * n :]).read_all()["id"]
        sums = np.zeros((4, n), np.int64)
        for k in np.flatnonzero(kinds != IDS):
            row, *values = unpacked(table["payload"][int(k)].as_py(), "IqqII")
            row = np.cumsum(row, dtype=np.uint32)
            for to, x in zip(sums, values, strict=True):
                to[row] += x.astype(np.int64)
        score, base, unigrams, known = sums
        return pa.table({"_id": ids, "n_tokens": pa.array(sizes), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(n, int(total)), pa.int64()), "base_score": pa.array(base / SCALE - sizes * log_norm), "score": pa.array(score / SCALE - unigrams * log_norm)})

    return seen.groupBy("block").applyInArrow(gathered, f"_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
