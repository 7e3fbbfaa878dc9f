"""Style measures of many texts at a time, from their UTF-8 bytes.

Texts lie in one array, with a byte that UTF-8 never has between them.  Classes of
bytes come from a table, and words, sentences, lines and paragraphs from the places
where the class changes, so the cost is a few passes over the bytes.  The patterns
are those of functions.text; test_style compares the two.
"""

from __future__ import annotations

import re

import numpy as np

AT_A_TIME = 1 << 20  # bytes of texts
SPACE, ALNUM, JOINT, STOP, WIDE = 1, 2, 4, 8, 16
_class = np.zeros(256, np.uint8)
for _set, _bit in ((b" \t\n\r\f\x0b", SPACE), (b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", ALNUM), (b"'_-", JOINT), (b".!?", STOP), (bytes([*range(0xE2, 0xEA), 0xEF]), WIDE)):
    _class[list(_set)] |= _bit
_words = bytes(b if _class[b] & (ALNUM | JOINT) else 32 for b in range(256)).lower()
_begins = np.isin(np.arange(256), list(b"#-*+0123456789"))
_heading = re.compile(rb"#{1,6}[ \t][ \t\f\x0b]*[^ \t\n\r\f\x0b\xff]")
_listed = re.compile(rb"[-*+] [ \t\f\x0b]*[^ \t\n\r\f\x0b\xff]|[0-9]+(?:[.)]|\xe3\x80\x81)")

COUNTS = ["characters", "cjk_characters", "ascii_words", "paragraphs", "sentences", "max_sentence", "quote_marks"]
NUMBERS = ["mean_sentence", "p25_sentence", "median_sentence", "p75_sentence", "mean_paragraph", "median_paragraph", "lexical_diversity", "question_share", "exclamation_share", "heading_share", "list_share"]
SCHEMA = ", ".join([f"{m} bigint" for m in COUNTS] + [f"{m} double" for m in NUMBERS])


def parts(texts: list[bytes], most: int):
    """The texts in runs of about `most` bytes."""
    first = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield texts[first : k + 1]
            first, size = k + 1, 0
    if first < len(texts):
        yield texts[first:]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs; neither the first nor the last flag is set."""
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    return edges[::2], edges[1::2]


class _Groups:
    """Numbers by text, sorted within it."""

    def __init__(self, values: np.ndarray, owner: np.ndarray, n: int):
        key = np.sort(owner.astype(np.int64) << 40 | values)
        self.values, self.size = key & (1 << 40) - 1, np.bincount(owner, minlength=n)
        self.ends = np.cumsum(self.size)
        self.total = np.diff(np.concatenate([[0], np.cumsum(self.values)])[np.concatenate([[0], self.ends])])
        self.mean = self.total / np.maximum(self.size, 1)

    def quantile(self, q: float) -> np.ndarray:
        out, some = np.zeros(len(self.size)), self.size > 0
        first, at = (self.ends - self.size)[some], (self.size[some] - 1) * q
        low = np.floor(at).astype(np.int64)
        lower, upper = self.values[first + low], self.values[np.minimum(first + low + 1, self.ends[some] - 1)]
        out[some] = lower + (upper - lower) * (at - low)
        return out

    def largest(self) -> np.ndarray:
        out, some = np.zeros(len(self.size), np.int64), self.size > 0
        out[some] = self.values[self.ends[some] - 1]
        return out


def measured(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS and NUMBERS of each text, not rounded."""
    n = len(texts)
    buf = b"\xff" + b"\xff".join([t.replace(b"\xff", b"\xfe") for t in texts]) + b"\xff"
    u = np.frombuffer(buf, np.uint8)
    kind = _class[u]
    sep = np.flatnonzero(u == 0xFF)
    per = lambda at: np.diff(np.searchsorted(at, sep))
    owner = lambda at: np.searchsorted(sep, at) - 1
    inside = np.flatnonzero((u & 0xC0) == 0x80)  # bytes that begin no character
    characters = lambda a, b: b - a - (np.searchsorted(inside, b) - np.searchsorted(inside, a))

    lead = np.flatnonzero(kind & WIDE)
    code = (u[lead].astype(np.int64) & 15) << 12 | (u[np.minimum(lead + 1, len(u) - 1)].astype(np.int64) & 63) << 6 | u[np.minimum(lead + 2, len(u) - 1)].astype(np.int64) & 63
    han = (code >= 0x3400) & (code <= 0x4DBF) | (code >= 0x4E00) & (code <= 0x9FFF)
    cjk, cjk_code = lead[han], code[han]
    wide = np.isin(code, [0x3002, 0xFF01, 0xFF1F])
    quotes = per(np.flatnonzero(u == 34)) + per(lead[np.isin(code, [0x201C, 0x201D, 0x2018, 0x2019])])

    starts, ends = _runs(kind & (ALNUM | JOINT) > 0)
    odd = np.flatnonzero(kind[starts] & JOINT)  # a word begins at the run's first letter or digit, if it has one
    if len(odd):
        bare = ~np.logical_or.reduceat(kind & ALNUM > 0, np.column_stack([starts[odd], ends[odd]]).ravel())[::2]
        trimmed = set(owner(starts[odd]).tolist())
        starts = np.delete(starts, odd[bare])
    else:
        trimmed = set()
    words = per(starts)

    stops = np.concatenate([np.flatnonzero(kind & STOP), lead[wide], sep])
    mark = np.concatenate([u[np.flatnonzero(kind & STOP)], np.select([code[wide] == 0xFF01, code[wide] == 0xFF1F], [33, 63], 46), np.full(len(sep), 0xFF)])
    width = np.where(kind[stops] & WIDE, 3, 1)
    order = np.argsort(stops, kind="stable")
    stops, mark, width = stops[order], mark[order], width[order]
    begin, end, mark = (stops + width)[:-1], stops[1:], mark[1:]

    blank, over = _runs(kind & SPACE > 0)  # runs of white space, and where they end
    first, last = sep[:-1] + 1, sep[1:].copy()  # of each text without outer white space
    at = np.minimum(np.searchsorted(blank, first), max(len(blank) - 1, 0))
    if len(blank):
        first = np.where(blank[at] == first, over[at], first)
        at = np.minimum(np.searchsorted(over, last), len(over) - 1)
        last = np.where(over[at] == last, blank[at], last)
    some = first < last
    whole = (end > begin) & ((mark != 0xFF) | (begin < last[np.minimum(owner(begin), n - 1)]))
    begin, end, mark = begin[whole], end[whole], mark[whole]
    of = owner(begin)
    units = np.sort(np.concatenate([starts, cjk]))
    sentence = _Groups(np.searchsorted(units, end) - np.searchsorted(units, begin), of, n)

    inner = (u[blank - 1] != 0xFF) & (u[over] != 0xFF)
    held = lambda where: np.bincount(np.searchsorted(blank, np.flatnonzero(where), "right") - 1, minlength=len(blank)) if len(blank) else np.zeros(0, np.int64)
    apart = inner & (held(u == 10) >= 2)
    a, b = np.sort(np.concatenate([first[some], over[apart]])), np.sort(np.concatenate([last[some], blank[apart]]))
    paragraph = _Groups(characters(a, b), owner(a), n)

    lines = np.concatenate([first[some], over[inner & (held((u == 10) | (u == 13)) >= 1)]])
    asked = lines[_begins[u[lines]]].tolist()
    headings, listed = (np.bincount(owner(np.array([p for p in asked if pattern.match(buf, p)], np.int64)), minlength=n) for pattern in (_heading, _listed))
    many = np.maximum(np.bincount(owner(lines), minlength=n), 1)

    distinct, pairs = np.empty(n, np.int64), per(cjk)
    upto = np.cumsum(pairs)
    for k, t in enumerate(texts):
        found = t.translate(_words).split()
        distinct[k] = len({x for w in found if (x := w.lstrip(b"'_-"))} if k in trimmed else set(found))
        if pairs[k] > 1:
            c = cjk_code[upto[k] - pairs[k] : upto[k]]
            distinct[k] += len(np.unique(c[:-1] << 16 | c[1:]))

    return {
        "characters": characters(sep[:-1] + 1, sep[1:]), "cjk_characters": pairs, "ascii_words": words, "paragraphs": paragraph.size, "sentences": sentence.size, "max_sentence": sentence.largest(), "quote_marks": quotes,
        "mean_sentence": sentence.mean, "p25_sentence": sentence.quantile(0.25), "median_sentence": sentence.quantile(0.5), "p75_sentence": sentence.quantile(0.75),
        "mean_paragraph": paragraph.mean, "median_paragraph": paragraph.quantile(0.5), "lexical_diversity": distinct / np.maximum(words + np.maximum(pairs - 1, 0), 1),
        "question_share": np.bincount(of[mark == 63], minlength=n) / np.maximum(sentence.size, 1), "exclamation_share": np.bincount(of[mark == 33], minlength=n) / np.maximum(sentence.size, 1),
        "heading_share": headings / many, "list_share": listed / many,
    }


def trigram_codes(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the distinct runs of three characters as sorted numbers: 21 bits a character, so equal numbers are equal runs."""
    out = []
    for t in texts:
        u = (np.frombuffer(t, np.uint8) if t.isascii() else np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)).astype(np.int64)
        code = np.sort(u[:-2] << 42 | u[1:-1] << 21 | u[2:])
        out.append(code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code)
    return out
