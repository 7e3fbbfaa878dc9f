"""Column functions over text: splitting, counting, tokens, normal forms, redaction.

Patterns spell their classes out, so that Java's and other engines' readings agree:
white space is [ \\t\\n\\r\\f\\x0b], CJK is the two ranges of unified ideographs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0b]"
CJK = "[㐀-䶿一-鿿]"
SENTENCE = r"[^。！？!?.]+[。！？!?.]?"
ASCII_WORD = r"[A-Za-z0-9][A-Za-z0-9'_-]*"
SEARCH_WORD = r"[a-z0-9][a-z0-9+.#_-]*"
HEADING_LINE = r"^[ \t]{0,3}#{1,6}[ \t]+[^ \t].*$"
LIST_LINE = r"^[ \t]*(?:[-*+] |[0-9]+[.)、])"
# Punctuation that the histogram counts.
PUNCTUATION = "，。！？；：、,.!?;:—-…（）()“”\"'"
# What counts as not filled in.
PLACEHOLDERS = ["", "-", "n/a", "na", "none", "null", "todo", "tbd", "unknown", "无", "未知", "待补充", "待确认", "暂无", "不详", "未填写"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), rf"^{SPACE}+|{SPACE}+$", "")


def squeezed(x: Column | str) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), rf"{SPACE}+", " "))


def compact(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), SPACE, "")


def sentences(x: Column | str) -> Column:
    """Sentences without outer white space; `.` ends one, even inside a number."""
    return F.filter(F.transform(F.regexp_extract_all(_c(x), F.lit(SENTENCE), F.lit(0)), strip), lambda s: s != "")


def paragraphs(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_c(x), rf"\n{SPACE}*\n"), strip), lambda s: s != "")


def lines(x: Column | str) -> Column:
    """Lines without outer white space, blank ones left out."""
    return F.filter(F.transform(F.split(_c(x), r"\r\n|\n|\r"), strip), lambda s: s != "")


def count_of(x: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(x), F.lit(pattern))


def word_length(x: Column | str) -> Column:
    """CJK characters and ASCII words."""
    return count_of(x, CJK) + count_of(x, ASCII_WORD)


def ngrams(x: Column | str, width: int) -> Column:
    """All runs of `width` characters, in order; a look-ahead finds them in one pass over the text."""
    return F.regexp_extract_all(_c(x), F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def tokens(x: Column | str) -> Column:
    """ASCII words in lower case, then the bigrams of all CJK characters put together."""
    x = _c(x)
    words = F.transform(F.regexp_extract_all(x, F.lit(ASCII_WORD), F.lit(0)), F.lower)
    han = F.array_join(F.regexp_extract_all(x, F.lit(CJK), F.lit(0)), "")
    return F.concat(words, ngrams(han, 2))


def search_tokens(x: Column | str) -> Column:
    """ASCII terms, and of each CJK run: itself if it has 2 to 10 characters, its bigrams and its trigrams."""
    low = F.lower(_c(x))
    runs = F.regexp_extract_all(low, F.lit(CJK + "+"), F.lit(0))
    whole = lambda r: F.when((F.length(r) >= 2) & (F.length(r) <= 10), F.array(r)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(low, F.lit(SEARCH_WORD), F.lit(0)), F.flatten(F.transform(runs, lambda r: F.concat(whole(r), ngrams(r, 2), ngrams(r, 3)))))


def query_phrases(x: Column | str) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(_c(x), rf"(?:{SPACE}|[,，;；|/])+"), lambda p: F.length(p) >= 2), F.lower))


def signature(x: Column | str) -> Column:
    """SHA-256 of the lower-cased text without white space."""
    return F.sha2(F.lower(compact(x)), 256)


def is_substantive(x: Column | str, minimum: int = 2) -> Column:
    """Filled in: at least `minimum` characters, white space collapsed, and not a placeholder; null is not."""
    s = squeezed(x)
    return F.coalesce((F.length(s) >= minimum) & ~F.lower(s).isin(PLACEHOLDERS), F.lit(False))


def punctuation(x: Column | str) -> Column:
    """The text's punctuation marks, in order."""
    marks = "".join("\\" + c if c in "-[]\\^" else c for c in PUNCTUATION)
    return F.regexp_extract_all(_c(x), F.lit(f"[{marks}]"), F.lit(0))


def slug(x: Column | str) -> Column:
    """Runs of other than letters, digits and _ become -, none at the ends, at most 80 characters; `source` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(_c(x), r"[^\p{L}\p{N}_]+", "-"), r"^[-]+|[-]+$", "")
    s = F.lower(F.substring(s, 1, 80))
    return F.when(F.length(s) > 0, s).otherwise("source")


def safe_url(x: Column | str) -> Column:
    """http(s) address without query and fragment; null for other schemes and for addresses with credentials."""
    x = _c(x)
    bare = F.regexp_replace(x, r"[?#].*$", "")
    return F.when(x.rlike(r"^https?://[^/@?#]+(?:[/?#]|$)"), bare)


# Secrets, in the order in which they are taken out.
REDACTIONS = [
    (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "<redacted-private-key>"),
    (r"\bsk-[A-Za-z0-9_-]{20,}\b", "<redacted>"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "<redacted>"),
    (r"(?i)(authorization[ \t]*:[ \t]*bearer[ \t]+)[^ \t\n\r\f`]+", "$1<redacted>"),
    (r"(?i)\b(api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret)([ \t]*[:=][ \t]*)[\"']?([^ \t\n\r\f,;\"']{12,})[\"']?", "$1$2<redacted>"),
]


def redacted(x: Column | str) -> Column:
    out = _c(x)
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    return out


# What a report must not hold.
SECRET_KINDS = {
    "api_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "repository_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "bearer": r"(?i)authorization[ \t]*:[ \t]*bearer[ \t]+[^ \t\n`]+",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "webhook": r"(?i)https://(?:hooks\.slack\.com/services|discord(?:app)?\.com/api/webhooks)/[^ \t\n`]+",
    "assignment": r"(?i)\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret)[ \t]*[:=][ \t]*[\"']?[^ \t\n,;\"']{12,}",
    "windows_path": r"(?i)(?:^|[^A-Za-z0-9])[A-Z]:\\[^ \t\n`]+",
    "home_path": r"(?:^|[^A-Za-z0-9])/(?:Users|home)/[^/ \t\n`]+",
}


def secret_flags(x: Column | str) -> dict[str, Column]:
    return {name: _c(x).rlike(pattern) for name, pattern in SECRET_KINDS.items()}


# Words that mark a turn of the argument.
RHETORIC = {
    "contrast": ["但是", "但", "然而", "不过", "反而", "yet", "however", "but"],
    "cause": ["因为", "因此", "所以", "于是", "由于", "because", "therefore", "thus"],
    "example": ["例如", "比如", "举个例子", "for example", "for instance"],
    "definition": ["所谓", "意味着", "也就是说", "指的是", "means", "defined as"],
    "conclusion": ["总之", "归根结底", "最后", "可见", "in conclusion", "ultimately"],
    "reader_address": ["你", "你们", "读者", "you", "your"],
    "self_reference": ["我", "我们", "作者", "i ", "we ", "my ", "our "],
}


def occurrences(x: Column, marker: str) -> Column:
    return ((F.length(x) - F.length(F.replace(x, F.lit(marker), F.lit("")))) / len(marker)).cast("bigint")


def rhetoric(x: Column | str) -> dict[str, Column]:
    low = F.lower(_c(x))
    return {group: sum((occurrences(low, m) for m in markers[1:]), occurrences(low, markers[0])) for group, markers in RHETORIC.items()}


def closeness(a: Column, b: Column, floor: float = 1e-6) -> Column:
    return F.exp(-F.abs(F.log((F.abs(a) + floor) / (F.abs(b) + floor))))


def bounded_similarity(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.abs(a - b) / scale))


def quantile(sorted_values: Column, q: float) -> Column:
    """Linear interpolation in a sorted array; 0 for an empty one."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    lower, upper = F.get(sorted_values, low), F.coalesce(F.get(sorted_values, low + 1), F.get(sorted_values, low))
    return F.when(F.size(sorted_values) > 0, lower + (upper - lower) * (at - low)).otherwise(0.0)


def excerpt(x: Column | str, needles: Column, limit: int) -> Column:
    """At most `limit` characters from a quarter of it before the earliest needle; dots where text is left out."""
    text = squeezed(x)
    low = F.lower(text)
    first = F.array_min(F.filter(F.transform(needles, lambda n: F.position(n, low)), lambda p: p > 0))
    start = F.greatest(F.lit(0), F.coalesce(first - 1 - limit // 4, F.lit(0)))
    end = F.least(F.length(text), start + limit)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def bounded_error(message: Column | str, source: Column | None = None, output: Column | None = None) -> Column:
    """An error on one line of at most 1,000 characters, without the paths of the source and the output folder."""
    out = strip(F.regexp_replace(_c(message), r"[\r\n]+", " "))
    for path, name in ((source, "<source>"), (output, "<output>")):
        if path is not None:
            out = F.when(F.coalesce(F.length(path), F.lit(0)) > 0, F.replace(out, path, F.lit(name))).otherwise(out)
    return F.substring(out, 1, 1000)


def ratio(x: Column | str) -> Column:
    """Value of "a/b" or of a number; 0 where it has none."""
    part = lambda i: F.try_element_at(F.split(_c(x), "/"), F.lit(i)).try_cast("double")
    return F.coalesce(F.when(F.instr(_c(x), "/") > 0, F.try_divide(part(1), part(2))).otherwise(part(1)), F.lit(0.0))


def stem(path: Column) -> Column:
    """A path without its last ending."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def relative_to(path: Column, root: Column) -> Column:
    """path as seen from the folder root; null outside it."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.length(base) + 1))
