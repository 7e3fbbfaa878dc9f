"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

Documents of one word sequence are one class.  Of a class's shingle set, MinHash
samples are taken; bands of ROWS samples give buckets, and the parities of all
samples' positions give an odd sketch, a bitmap of BITS bits: the population
count of two sketches' XOR estimates high similarities closely.  Candidates:

1. in each bucket, every class against the bucket's smallest one, by sketch; the
   components of what passes are clusters;
2. a cluster's blocks of some BLOCK classes, each with itself and with the
   cluster's pivots (some PIVOTS of its classes), on their full sets; a block gives
   back only the links that join something;
3. in a cluster of several blocks, the classes that these links leave outside its
   largest part, with all its classes, block by block: two classes of that part are
   joined already, so its pairs need no comparison;
4. classes of one bucket and two clusters whose sketches are close enough, on
   their full sets; classes of the bucket's main cluster don't meet one another.

The sketch bound leaves SIGMAS deviations, so a link at the threshold passes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, worker_cache, written
from .graph import components

BANDS, ROWS, BITS = 42, 6, 512
SAMPLES = BANDS * ROWS
SIGMAS = 4.5
BLOCK = 256
PIVOT = -1  # marks them in a block
PIVOTS = 32  # expected number in a cluster of several blocks; it decides what step 3 has left to do, not the result
#: Rows up to which ids are broadcast against the documents, and clusters against their classes (8 to 24 bytes each).
BROADCAST_IDS = 1_000_000
WORDS_CACHED = 250_000

_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
PLACE = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def most_bits(percent: int) -> int:
    """Population count that sketches of sets at the threshold stay below, SIGMAS deviations up."""
    j = percent / 100
    items = 2 * SAMPLES * (1 - j)
    q = (1 - np.exp(-2 * items / BITS)) / 2
    spread = np.sqrt(BITS * q * (1 - q) + (np.exp(-2 * items / BITS) * 2) ** 2 * SAMPLES * j * (1 - j))
    return int(np.ceil(BITS * q + SIGMAS * spread))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of fewer words, of the whole sequence; of none, nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = worker_cache("neardup", WordHashes)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def minhash(items: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 256):
        part = items[at : at + 256, None] * MULTIPLY + ADD
        np.minimum(best, (part ^ (part >> np.uint64(29))).min(0), out=best)
    return best


def bands_of(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of how many samples fall on each bit, as 64-bit words."""
    place = (mixed(samples * PLACE + PLACE) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(place, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(left: list[np.ndarray], right: list[np.ndarray], left_bits: np.ndarray, right_bits: np.ndarray, percent: int, bound: int, same: bool) -> list[tuple[int, int]]:
    """Links between two blocks of sets, as few as join the same things; right is left where `same`."""
    n = len(left)
    sizes, others = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    everything, number = np.unique(np.concatenate(left + right), return_inverse=True)
    number = number.ravel()
    starts = np.concatenate(([0], np.cumsum(np.concatenate((sizes, others)))))
    flat, first = number[starts[n] :], starts[n:-1] - starts[n]
    mark, union, out = np.zeros(len(everything), np.int64), Union(n + (0 if same else len(right))), []
    for i in range(n):
        close = np.bitwise_count(left_bits[i] ^ right_bits).sum(1) <= bound
        close &= 100 * np.minimum(sizes[i], others) >= percent * np.maximum(sizes[i], others)
        if same:
            close[: i + 1] = False
        if not close.any():
            continue
        own = number[starts[i] : starts[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat], first)
        mark[own] = 0
        linked = close & (100 * shared >= percent * (sizes[i] + others - shared))
        for j in np.flatnonzero(linked).tolist():
            if union.join(i, j if same else n + j):
                out.append((i, j))
    return out


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _key (of the word sequence; null without words), n_shingles, _bands, _bits of every row."""

    def signed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys, counts, bands, bits = [], [], [], []
                for cell in part.column(1):
                    words = words_of(cell.as_py())
                    items = shingles(words, size)
                    counts.append(len(items))
                    if len(items):
                        samples = minhash(items)
                        keys.append(hashlib.md5(b" ".join(words)).digest())
                        bands.append(bands_of(samples))
                        bits.append(odd_sketch(samples))
                    else:
                        keys.append(None)
                        bands.append(None)
                        bits.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["_id", "_key", "n_shingles", "_bands", "_bits"])

    return docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string")).mapInArrow(signed, "_id bigint, _key binary, n_shingles bigint, _bands array<bigint>, _bits array<bigint>")


def _distance(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(BITS // 64))


def first_blocks(members: DataFrame) -> DataFrame:
    """g, i = j, block, c: each class in its own block, and the pivots of a cluster of several blocks in all its others.

    members: g (cluster), c (class), blocks (of the cluster) and block (of the class).
    """
    pivots = members.where("blocks > 1").where(F.expr(f"pmod(xxhash64(c, 2), CAST(ceil(blocks * {BLOCK} / {PIVOTS}) AS BIGINT)) = 0"))
    elsewhere = pivots.withColumn("i", F.explode(F.expr("sequence(0, blocks - 1)"))).where("i <> block").select("g", "i", F.col("i").alias("j"), F.lit(PIVOT).alias("block"), "c")
    return members.select("g", F.col("block").alias("i"), F.col("block").alias("j"), "block", "c").unionAll(elsewhere)


def remaining_blocks(members: DataFrame) -> DataFrame:
    """g, i, j, block, c: pairs of blocks that hold all pairs of a cluster but those within its largest part.

    members: as for first_blocks, and part (of the cluster, joined already).  The
    classes of other parts get blocks of their own, from 0; those of the largest part
    follow and meet only them.
    """
    parts = members.groupBy("g", "part").count().groupBy("g").agg(F.max_by("part", F.struct("count", "part")).alias("main"), (F.sum("count") - F.max("count")).alias("others"))
    parts = written(parts.where("others > 0").select("g", "main", F.ceil(F.col("others") / BLOCK).cast("int").alias("out")), "nd-parts")
    split = members.join(F.broadcast(parts) if parts.count() <= BROADCAST_IDS else parts, "g")  # else a large cluster's rows go to one task
    inner, outer = split.where("part = main"), split.where("part <> main")
    outer = outer.withColumn("block", F.expr("CAST(pmod(xxhash64(c, 1), out) AS INT)")).withColumn("other", F.explode(F.expr("sequence(0, out + blocks - 1)")))
    inner = inner.withColumn("block", F.expr("out + block")).withColumn("other", F.explode(F.expr("sequence(0, out - 1)")))
    both = outer.select("g", "block", "other", "c").unionAll(inner.select("g", "block", "other", "c"))
    return both.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (smallest id reachable by links, itself included) and kept (id = component) of every row.

    Linked: 100 * |A and B| >= percent * |A or B| for the sets of distinct `size`-word
    shingles (of fewer words: the whole sequence as one; of none: linked with
    nothing).  Shingles are compared by 64-bit hashes, word sequences by 128-bit ones.
    Null texts have no words.  Rows that repeat an id are one document of several
    texts: each row's component is that of the id.  Null ids stay alone and are kept.
    An empty table gives an empty result.  Extra columns have no effect.
    """
    bound = most_bits(percent)
    spark = docs.sparkSession
    sig = written(signatures(docs, size, id_col, text_col), "nd-sig")
    known = sig.where("_key IS NOT NULL AND _id IS NOT NULL")
    reps = written(known.groupBy("_key").agg(F.min("_id").alias("_rep")), "nd-reps")
    # the rows that stand for their class; an id may stand for several classes, so classes have keys of their own
    firsts = known.join(reps, "_key").where("_id = _rep").groupBy("_key").agg(F.first("_id").alias("_id"), F.first("n_shingles").alias("n"), F.first("_bands").alias("_bands"), F.first("_bits").alias("_bits"))
    classes = written(firsts.withColumn("c", F.xxhash64("_key")), "nd-classes")

    rows = classes.select("c", F.explode("_bands").alias("b"))
    heads = rows.groupBy("b").agg(F.min("c").alias("r"), F.count("*").alias("k")).where("k > 1").select("b", "r")
    buckets = written(rows.join(heads, "b"), "nd-buckets")
    bits = classes.select("c", "_bits")
    stars = buckets.where("c <> r").select("c", "r").distinct()
    near = stars.join(bits, "c").join(bits.select(F.col("c").alias("r"), F.col("_bits").alias("_rbits")), "r").where(F.expr(f"{_distance('_bits', '_rbits')} <= {bound}"))
    clusters = written(components(near.select(F.col("c").alias("u"), F.col("r").alias("v"))), "nd-clusters")

    # pairs of one bucket and two clusters: classes outside the bucket's main cluster with all of the bucket
    placed = buckets.select("b", "c").join(clusters.withColumnRenamed("id", "c"), "c", "left").select("b", "c", F.coalesce("component", "c").alias("g"))
    placed = written(placed, "nd-placed")
    several = placed.groupBy("b", "g").count().groupBy("b").agg(F.max_by("g", F.struct("count", "g")).alias("main"), F.count("*").alias("n")).where("n > 1").select("b", "main")
    across = written(placed.join(several, "b").join(bits, "c"), "nd-across")
    one = across.where("g <> main").select("b", *[F.col(x).alias(x + "1") for x in ("c", "g", "_bits")])
    two = across.select("b", (F.col("g") == F.col("main")).alias("inner"), *[F.col(x).alias(x + "2") for x in ("c", "g", "_bits")])
    pairs = one.join(two, "b").where(F.expr(f"g1 <> g2 AND (inner OR c1 < c2) AND {_distance('_bits1', '_bits2')} <= {bound}")).select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct()
    pairs = written(pairs, "nd-pairs")

    # full sets of the classes in question, read from the documents again
    wanted = clusters.select(F.col("id").alias("c")).unionAll(pairs.select("c1")).unionAll(pairs.select("c2")).distinct()
    ids = written(wanted.join(classes.select("c", "_key", "_id"), "c"), "nd-wanted")
    n_ids = ids.count()
    chosen = ids.select("_id").distinct()

    def sets_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = [words_of(x.as_py()) for x in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(b" ".join(w)).digest() for w in words], pa.binary()), pa.array([shingles(w, size).tobytes() for w in words], pa.binary())], names=["_key", "_set"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen) if n_ids <= BROADCAST_IDS else chosen, "_id", "left_semi")
    sets = texts.select("_text").mapInArrow(sets_of, "_key binary, _set binary").groupBy("_key").agg(F.first("_set").alias("_set"))
    sets = written(sets.join(ids.select("_key", "c"), "_key").select("c", "_set"), "nd-sets")

    def inside(table: pa.Table) -> pa.Table:
        block, c = table["block"].to_numpy(), table["c"].to_numpy()
        own = [np.frombuffer(x.as_py(), np.uint64) for x in table["_set"]]
        sketch = np.array(table["_bits"].to_pylist(), np.int64).reshape(len(c), -1).view(np.uint64)  # bitwise_count takes the absolute value of signed ones
        low, high, pivots = (np.flatnonzero(block == x) for x in (table["i"][0].as_py(), table["j"][0].as_py(), PIVOT))
        same, u, v = table["i"][0].as_py() == table["j"][0].as_py(), [], []
        for left, right in ((low, high), (low, pivots)):
            if len(left) and len(right):
                links = block_links([own[k] for k in left], [own[k] for k in right], sketch[left], sketch[right], percent, bound, same and right is high)
                u += [c[left[a]] for a, _ in links]
                v += [c[right[b]] for _, b in links]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def compared(dealt: DataFrame) -> DataFrame:
        return dealt.join(sets, "c").join(bits, "c").groupBy("g", "i", "j").applyInArrow(inside, "u bigint, v bigint")

    # within clusters
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = written(clusters.join(sizes, "component").select(F.col("component").alias("g"), F.col("id").alias("c"), "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")), "nd-members")
    within = written(compared(first_blocks(members)), "nd-within")
    large = members.where("blocks > 1")
    written_links = [within]
    if not large.isEmpty():
        joined = written(components(within.join(large.select(F.col("c").alias("u")), "u", "left_semi")), "nd-joined")
        written_links.append(written(compared(remaining_blocks(large.join(joined.select(F.col("id").alias("c"), "component"), "c", "left").withColumn("part", F.coalesce("component", "c")))), "nd-rest"))
        dropped(joined)
    checked = pairs.join(sets.select(F.col("c").alias("c1"), F.col("_set").alias("s1")), "c1").join(sets.select(F.col("c").alias("c2"), F.col("_set").alias("s2")), "c2")

    def confirmed(batches):
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    u.append(a.as_py())
                    v.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    links = written(reduce(DataFrame.unionAll, written_links).unionAll(checked.select("c1", "c2", "s1", "s2").mapInArrow(confirmed, "u bigint, v bigint")), "nd-links")
    # from classes to ids: class to class, and the classes that one repeated id is in
    at = classes.select("c", F.col("_id"))
    edges = links.join(at.select(F.col("c").alias("u"), F.col("_id").alias("a")), "u").join(at.select(F.col("c").alias("v"), F.col("_id").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    copies = known.join(reps, "_key").where("_id <> _rep").select(F.col("_id").alias("u"), F.col("_rep").alias("v"))
    # most ids have one text; then copies hang from their class and need no walk of their own
    whole = _is_unique(known)
    if whole:
        found = written(components(edges), "nd-found")
        of = known.join(reps, "_key").select("_id", "_rep")
        of = of.join(found.withColumnRenamed("id", "_rep"), "_rep", "left").select("_id", F.coalesce("component", "_rep").alias("_component"))
    else:
        found = written(components(edges.unionAll(copies)), "nd-found")
        of = found.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    out = sig.select("_id", "n_shingles").join(of, "_id", "left")
    component = F.coalesce("_component", "_id")
    dropped(buckets, placed, across, pairs, sets, links, ids, clusters, members, *written_links)
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def _is_unique(known: DataFrame) -> bool:
    return known.groupBy("_id").count().where("count > 1").limit(1).count() == 0
