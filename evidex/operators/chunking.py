"""Chunks of whole paragraphs, as spans of the text.

A text is cut into spans, first paragraphs, then sentences of a paragraph that is too
long, or slices where it is one sentence.  Running sums of the spans' lengths say by
binary search how many fit into a chunk, so each chunk costs one search; offsets are
the spans' own.  An Arrow map: where a chunk begins depends on the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions import text as T

_GAP, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(T.SENTENCE)
LEAST = 1000  # characters: smaller limits are raised to it

Span = tuple[int, int]


def trimmed(text: str, spans: Iterator[Span]) -> list[Span]:
    """Spans without white space at their ends; empty ones go."""
    out = []
    for a, b in spans:
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        if left < len(part):
            out.append((a + left, a + len(part.rstrip())))
    return out


def paragraphs(text: str) -> list[Span]:
    gaps = [m.span() for m in _GAP.finditer(text)]
    return trimmed(text, zip([0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(text)], strict=True))


def runs(sizes: list[int], limit: int, glue: int) -> list[Span]:
    """Consecutive items, first and past the last, that fit into limit together, each counted with its glue; one alone may be longer."""
    ends = np.cumsum(np.array(sizes, np.int64) + glue)
    out, first, before = [], 0, 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        out.append((first, last))
        first, before = last, int(ends[last - 1])
    return out


def pieces(text: str, limit: int) -> list[list[Span]]:
    """What chunks are made of: a paragraph, some sentences of a long one, or a slice; each a list of spans that a line break joins."""
    out: list[list[Span]] = []
    for a, b in paragraphs(text):
        sentences = [] if b - a <= limit else trimmed(text, ((a + m.start(), a + m.end()) for m in _SENTENCE.finditer(text[a:b])))
        if len(sentences) > 1:
            out += [sentences[i:j] for i, j in runs([y - x for x, y in sentences], limit, 1)]
        else:
            out += [[(x, min(x + limit, b))] for x in range(a, b, limit)]
    return out


def chunks_of(text: str | None, limit: int = 6000) -> list[tuple[int, int, str]]:
    """Start, end (exclusive) and content of each chunk; paragraphs are set apart by an empty line."""
    text, limit = text or "", max(LEAST, limit)
    made = pieces(text, limit)
    lines = ["\n".join(text[a:b] for a, b in p) for p in made]
    return [(made[i][0][0], made[j - 1][-1][1], "\n\n".join(lines[i:j])) for i, j in runs([len(x) for x in lines], limit, 2)]


def chunks(docs: DataFrame, limit: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, chunk (from 0), start, end, characters, content: one row a chunk; a text without content has none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, k, a, b, len(c), c) for i, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for k, (a, b, c) in enumerate(chunks_of(t, limit))]
            yield pd.DataFrame(found, columns=[id_col, "chunk", "start", "end", "characters", "content"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInPandas(cut, f"{id_col} {kind}, chunk int, start int, end int, characters int, content string")
