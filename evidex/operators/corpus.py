"""Document and corpus analytics: style metrics, distributions, duplicates, boilerplate."""

from __future__ import annotations

import hashlib
import itertools
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from evidex.functions import text as T
from evidex.operators import style

METRICS = ["characters", "sentences", "paragraphs", "lexical_diversity", "question_share", "exclamation_share", "mean_sentence"]
SHINGLES = 1 << 16  # of a text that are counted at a time
PARCEL = 32_768  # rows whose hashes a task compares with as many


def style_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of style measures a document, in one narrow pass; nothing is shuffled."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    most = style.AT_A_TIME

    def measured(batches):
        for batch in batches:
            ids = batch.column(0)
            for texts in style.parts(batch.column(1).to_pylist(), most):
                found = style.measured(texts)
                yield pa.RecordBatch.from_arrays([ids[: len(texts)], *map(pa.array, found.values())], names=["id", *found])
                ids = ids[len(texts) :]

    return rounded(rows.mapInArrow(measured, f"id {rows.schema['id'].dataType.simpleString()}, {style.SCHEMA}"), F.col("id").alias(id_col))


def rounded(found: DataFrame, *more: Column) -> DataFrame:
    """style.measured, as style_metrics gives it."""
    near = lambda m: F.round(m, 4 if m == "lexical_diversity" or m.endswith("_share") else 2).alias(m)
    names = ["characters", "cjk_characters", "ascii_words", "paragraphs", "sentences", "mean_sentence", "p25_sentence", "median_sentence", "p75_sentence", "max_sentence", "mean_paragraph", "median_paragraph", "lexical_diversity", "question_share", "exclamation_share", "heading_share", "list_share", "quote_marks"]
    return found.select(*more, *[near(m) if m in style.NUMBERS else F.col(m) for m in names])


def distributions(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """metric, mean, p25, median, p75 of each named measure: one pass, partly summed before the shuffle."""
    names = names or METRICS
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("x")).select("x.*")
    found = quantiles(long, ["metric"], "value", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return found.select("metric", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("mean", "p25", "median", "p75")])


def quantiles(rows: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """group, n, mean, largest and the named quantiles (linear interpolation) of each group.

    Values are counted before the shuffle; running counts over the distinct ones, a
    sort that spills, give the places, so no task holds a group's values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumn("_upto", F.sum("_n").over(up))
    total = counts.groupBy(*group).agg(F.sum("_n").alias("n"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.max("_v").alias("largest"))
    both = run.join(total, group)
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    first = lambda ok: F.min(F.when(ok, F.col("_v")))
    parts = [x for name, p in at.items() for x in (first(F.col("_upto") > F.floor(place(p))).alias(f"_{name}_low"), first(F.col("_upto") > F.ceil(place(p))).alias(f"_{name}_high"))]
    found = both.groupBy(*group, "n", "mean", "largest").agg(*parts)
    between = lambda name, p: F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * (place(p) - F.floor(place(p)))
    return found.select(*group, "n", "mean", "largest", *[between(name, p).alias(name) for name, p in at.items()])


def top_per_group(rows: DataFrame, group: list[str], item: str, n: int) -> DataFrame:
    """The n most frequent items of each group, ties by item.  Counts are combined before each of the two shuffles."""
    counts = rows.groupBy(*group, item).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal without white space and case: signature, copies, first id.

    Only counts and the smallest id are kept, so a group of any size is one small row.
    """
    return docs.groupBy(T.signature(text_col).alias("signature")).agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id")).where("copies > 1")


def boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = 100, least_share: float = 0.6) -> DataFrame:
    """Lines of 8 to 240 visible characters that many documents hold: of the `top` most frequent, those in at least max(2, share)."""
    n = docs.agg(F.count("*").alias("documents"))
    lines = docs.select(F.explode(F.array_distinct(F.transform(T.lines(text_col), T.squeezed))).alias("line"))
    visible = lines.where(F.length(T.compact("line")).between(8, 240))
    first = visible.groupBy("line").agg(F.count("*").alias("documents_with")).orderBy(F.desc("documents_with"), "line").limit(top)
    return first.crossJoin(F.broadcast(n)).where(F.col("documents_with") >= F.greatest(F.lit(2), F.ceil(F.col("documents") * least_share))).select("line", "documents_with")


class _Hashes(dict):
    """Shingle -> its hash; emptied when full."""

    def __init__(self, digest, most: int = 500_000):
        self.digest, self.most = digest, most

    def __missing__(self, shingle: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[shingle] = h = int.from_bytes(self.digest(shingle.encode("utf-8", "replace")), "big")
        return h


def _simhash(texts: pd.Series, hashes: _Hashes) -> pd.Series:
    out = []
    for text in texts:
        compact = "".join((text or "").lower().split())
        n = max(1, len(compact) - 4)
        tally = np.zeros(64)  # of each bit, from the highest: how many shingles have it
        for start in range(0, n, SHINGLES):
            grams = [compact[i : i + 5] for i in range(start, min(n, start + SHINGLES))]
            found, often = np.unique(np.fromiter(map(hashes.__getitem__, grams), np.uint64, len(grams)), return_counts=True)
            tally += often.astype(np.float32) @ np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
        on = 2 * tally - n >= 0
        out.append(int(np.packbits(on).view(">i8")[0]))
    return pd.Series(out, dtype="int64")


_md5 = _Hashes(lambda g: hashlib.md5(g).digest()[:8])
_blake = _Hashes(lambda g: hashlib.blake2b(g, digest_size=8).digest())


@pandas_udf(LongType())
def simhash_md5(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of five-character shingles by the upper half of MD5 (which SQL engines have)."""
    return _simhash(texts, _md5)


@pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of five-character shingles by BLAKE2b."""
    return _simhash(texts, _blake)


def hamming_pairs(rows: DataFrame, id_col: str, hash_col: str, most: int = 5, same_key: str | None = None, blocks: int | None = None) -> DataFrame:
    """Pairs left_id < right_id whose 64-bit hashes differ in at most `most` bits: exact, by pigeonhole.

    Of `blocks` blocks of bits, `most` differences leave blocks - most alike, so
    candidates come from an equi-join on every choice of that many blocks of the
    distinct hashes.  More blocks make longer keys, and fewer candidates for more
    rows of keys: one block is enough for few hashes, two and more are taken for many
    (the number of distinct hashes is counted first).  Beyond 6 bits no key is long
    enough to tell hashes apart, so all rows are compared (_all_pairs).  Hashes shared
    by many rows are joined once and expanded at the end.  same_key: rows equal in it are no pair.
    """
    keys = rows.select(F.col(id_col).alias("id"), F.col(hash_col).alias("_h"), F.col(same_key or id_col).alias("_k")).persist(StorageLevel.MEMORY_AND_DISK)  # read more than once; hashes cost far more than their rows
    if blocks is None and most > 6:
        pairs = _all_pairs(keys, most).where((F.col("k1") != F.col("k2")) & ((F.col("x") != F.col("y")) | (F.col("id1") != F.col("id2"))))
    else:
        near = _banded_near(keys.select("_h").where("_h IS NOT NULL").distinct(), most, blocks)
        a, b = (keys.select(F.col("id").alias(f"id{s}"), F.col("_h").alias(h), F.col("_k").alias(f"k{s}")) for s, h in (("1", "x"), ("2", "y")))
        pairs = near.hint("merge").join(a.hint("merge"), "x").hint("merge").join(b.hint("merge"), "y").where((F.col("k1") != F.col("k2")) & ((F.col("x") != F.col("y")) | (F.col("id1") < F.col("id2"))))
    return pairs.select(F.least("id1", "id2").alias("left_id"), F.greatest("id1", "id2").alias("right_id"), F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("int").alias("distance"))


def _all_pairs(keys: DataFrame, most: int) -> DataFrame:
    """id1, x, k1, id2, y, k2: every two rows with hashes within `most` bits, once.

    Rows lie in parcels by their id; every two parcels meet in one row, whose pairs
    leave in batches.  A task holds two parcels and a batch, whatever the number of
    rows and however many share a hash.  The work is n * n / 2 comparisons.
    """
    rows = keys.where("id IS NOT NULL AND _h IS NOT NULL AND _k IS NOT NULL")
    n = rows.count()
    parcels = max(1, -(-n // PARCEL), min(12, n // 1024))
    held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parcels)).cast("int").alias("p")).agg(F.collect_list(F.struct("id", "_h", "_k")).alias("r"))
    dealt = held.select("p", "r", F.explode(F.sequence(F.lit(0), F.lit(parcels - 1))).alias("o")).select(F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), "p", "r")
    tasks = min(parcels * (parcels + 1) // 2, 2000)  # said here, as Spark would put small rows together
    meet = dealt.repartition(tasks, "i", "j").groupBy("i", "j").agg(F.min_by("r", "p").alias("a"), F.max_by("r", "p").alias("b"), F.count("*").alias("parcels"))

    def met(batches):
        for batch in batches:
            i, j, a, b, parcels = (batch.column(c) for c in ("i", "j", "a", "b", "parcels"))
            for k in range(batch.num_rows):
                own = i[k] == j[k]
                if not own and parcels[k].as_py() < 2:
                    continue
                left, right = a[k].values, b[k].values
                xs, ys = (np.array(r.field("_h"), np.int64).view(np.uint64) for r in (left, right))
                at, found, n = [], [], 0
                for m, x in enumerate(xs):
                    first = m + 1 if own else 0
                    hits = np.flatnonzero(np.bitwise_count(ys[first:] ^ x) <= most)
                    if len(hits):
                        at.append(np.full(len(hits), m))
                        found.append(hits + first)
                        n += len(hits)
                    if n >= 1 << 16 or n and m == len(xs) - 1:
                        one, two = left.take(pa.array(np.concatenate(at))), right.take(pa.array(np.concatenate(found)))
                        yield pa.RecordBatch.from_arrays([r.field(c) for r in (one, two) for c in ("id", "_h", "_k")], names=["id1", "x", "k1", "id2", "y", "k2"])
                        at, found, n = [], [], 0

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return meet.mapInArrow(met, ", ".join(f"{name} {kinds[c]}" for name, c in (("id1", "id"), ("x", "_h"), ("k1", "_k"), ("id2", "id"), ("y", "_h"), ("k2", "_k"))))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _banded_near(distinct: DataFrame, most: int, blocks: int | None) -> DataFrame:
    """x <= y: distinct hashes within `most` bits that agree in blocks - most blocks, each two once.

    Joins are merged: a broadcast would gather its side's rows in the driver.
    """
    if blocks is None:
        n = distinct.count()
        blocks = most + (1 if n <= 1 << 17 else 2 if n <= 1 << 22 else 3)
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    piece = lambda k: F.shiftrightunsigned(F.shiftleft("_h", 64 - cuts[k + 1]), 64 - cuts[k + 1] + cuts[k])
    choices = list(itertools.combinations(range(blocks), blocks - most))

    def key(chosen):
        out = F.lit(0).cast("bigint")
        for k in chosen:
            out = F.shiftleft(out, cuts[k + 1] - cuts[k]).bitwiseOR(piece(k))
        return out

    bits = [sum(1 << k for k in c) for c in choices]  # a band is the bits of its blocks
    banded = distinct.select("_h", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit((1 << b.bit_length()) - 1).alias("upto"), key(c).alias("value")) for b, c in zip(bits, choices, strict=True)])).alias("b")).select("_h", "b.*")
    left, right = banded.withColumnRenamed("_h", "x"), banded.withColumnRenamed("_h", "y").drop("upto")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    alike = reduce(Column.bitwiseOR, [F.when(differ.bitwiseAND(F.lit(_signed(((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1)))) == 0, 1 << k).otherwise(0) for k in range(blocks)])
    near = left.hint("merge").join(right.hint("merge"), ["band", "value"]).where((F.col("x") <= F.col("y")) & (F.bit_count(differ) <= most))
    return near.where(alike.bitwiseAND(F.col("upto")) == F.col("band")).select("x", "y")  # only in the first band that the two share
