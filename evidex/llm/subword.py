"""Hashed n-grams of many words at once: one pass of numpy over all their UTF-8 bytes."""

from __future__ import annotations

import zlib

import numpy as np

OPEN, CLOSE = b"\x02", b"\x03"  # mark a word's ends


def gram_ids(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners (index of the word) and bucket ids of the words' byte n-grams, ends marked, and of each whole word; by owner."""
    raw = [w.encode("utf-8", "replace") for w in words]
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(OPEN + (CLOSE + OPEN).join(raw) + CLOSE, np.uint8).astype(np.uint64)
    lengths = np.array([len(x) + 2 for x in raw], np.int64)
    owner = np.repeat(np.arange(len(raw)), lengths)
    owners, ids = [np.arange(len(raw))], [np.array([zlib.crc32(x) for x in raw], np.int64) % buckets]
    h = data.copy()
    with np.errstate(over="ignore"):
        for size in range(2, max(sizes) + 1):
            n = len(data) - size + 1
            if n <= 0:
                break
            h = h[:n] * np.uint64(0x100000001B3) + data[size - 1 :]
            if size in sizes:
                inside = owner[:n] == owner[size - 1 :]
                mixed = (h[inside] ^ np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
                owners.append(owner[:n][inside])
                ids.append(((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64))
    owners, ids = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owners, kind="stable")
    return owners[order], ids[order]
