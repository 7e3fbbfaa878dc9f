"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of parts.  A mergeable pair waits in the bucket
of its merge rank; a three-level bitmap over the ranks tells by find-first-set
which bucket is the lowest non-empty one.  Entries whose pair has changed since
they were queued are stale and skipped when they come up.  A merge costs a few
dictionary and bit operations whatever the length of the pre-token, so a
pre-token of a megabyte takes n log n and not n squared.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Entries of a worker's pre-token cache; it is emptied when full, so memory stays bounded.
CACHE_ENTRIES = 600_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: one base64 token and its rank a line."""
    ranks = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    return ranks


class ByteBpe:
    """Encoder and decoder for one table of ranks (a bijection of byte strings and ids)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        most = max(ranks.values(), default=0) + 1
        # the bitmap: a bit for each rank, for each word of ranks, for each word of words; all clear between pieces
        self.low = [0] * ((most + 63) // 64)
        self.mid = [0] * ((len(self.low) + 63) // 64)
        self.table: list[bytes] = [b""] * most
        for token, rank in ranks.items():
            self.table[rank] = token

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the leftmost pair of the lowest merge rank is merged."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        find, low, mid, top = self.ranks.get, self.low, self.mid, 0
        buckets: dict[int, list[int]] = {}  # positions under each waiting rank, as a heap
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that starts here ends; the next part starts there
        before = list(range(-1, n - 1))
        waits = [-1] * (n + 1)  # rank under which the pair that starts here waits; -1: none
        for i in range(n - 1):
            r = find(piece[i : i + 2])
            if r is not None:
                waits[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 6
                    low[w] |= 1 << (r & 63)
                    mid[w >> 6] |= 1 << (w & 63)
                    top |= 1 << (w >> 6)
        while top:
            # find-first-set, from the top level down
            m = (top & -top).bit_length() - 1
            x = mid[m]
            w = (m << 6) + (x & -x).bit_length() - 1
            x = low[w]
            rank = (w << 6) + (x & -x).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[w] = x = x & (x - 1)
                if not x:
                    mid[m] = x = mid[m] & ~(1 << (w & 63))
                    if not x:
                        top &= top - 1
            if waits[i] != rank:
                continue  # stale
            j = end[i]
            k = end[i] = end[j]
            waits[j] = waits[i] = -1
            h = before[i]
            if k < n:
                before[k] = i
                changed = ((i, piece[i : end[k]]), (h, piece[h:k])) if h >= 0 else ((i, piece[i : end[k]]),)
            elif h >= 0:
                changed = ((h, piece[h:k]),)
            else:
                break
            for p, pair in changed:
                r = find(pair)
                if r is None:
                    waits[p] = -1
                    continue
                waits[p] = r
                if r in buckets:
                    heappush(buckets[r], p)
                else:
                    buckets[r] = [p]
                    w = r >> 6
                    low[w] |= 1 << (r & 63)
                    mid[w >> 6] |= 1 << (w & 63)
                    top |= 1 << (w >> 6)
        for r in buckets:  # left after the last part has merged
            low[r >> 6] = mid[r >> 12] = 0
        out, i, ranks = [], 0, self.ranks
        while i < n:
            k = end[i]
            out.append(ranks[piece[i:k]])
            i = k
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


class PieceCache(dict):
    """Pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, bpe: ByteBpe, most: int = CACHE_ENTRIES):
        self.bpe, self.most = bpe, most

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.bpe.encode_piece(piece.encode("utf-8", "replace")), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = packed
        return packed


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Encode every whole text, then decode the ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, with `with_ids`, ids (array<int>).
    A null or empty text has no tokens (hashes of the empty string); ids may be null
    and of any type.  Rows are
    independent: ties, repeated rows and extra columns have no effect; an empty
    table gives an empty result.  cache_entries: pre-tokens a worker keeps; it has no
    effect on the result.  One narrow map, no shuffle.  The rank file
    (some 50,000 lines; read once on the driver) is broadcast.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        data = f.read()
    key, shared = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(load_ranks(data))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def encode(batches):
        import regex

        cache, pieces = worker_cache(("bpe", key), lambda: PieceCache(ByteBpe(shared.value), cache_entries)), regex.compile(pattern)
        bpe = cache.bpe
        for batch in batches:
            counts, ids_hash, text_hash, ids = [], [], [], []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                packed = b"".join(map(cache.__getitem__, pieces.findall(text)))
                numbers = np.frombuffer(packed, "<u4")
                counts.append(len(numbers))
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(numbers.tolist())).hexdigest())
                if with_ids:
                    ids.append(numbers.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(encode, schema)
