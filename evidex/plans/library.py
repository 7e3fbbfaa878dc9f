"""Queries of the library and of form comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import compare, library
from evidex.plans.documents import STYLE, q, sql_squeezed
from evidex.sources.tables import table

QUERY = "thble erand, tion; the and"
TOKENS, PHRASES = ["thble", "erand", "tion", "the", "and"], ["thble", "erand", "tion", "the", "and"]
S = r"[ \t\n\r\f\x0b]"


def _fields(spark, d):
    """A document's first line is its title, the rest its overview."""
    t = F.col("text")
    both = F.array(F.struct(F.lit("标题").alias("field"), F.substring_index(t, "\n", 1).alias("content")), F.struct(F.lit("概览").alias("field"), t.alias("content")))
    return table(spark, d, "documents").select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.*")


def _scores(spark, d):
    f = _fields(spark, d)
    return library.field_scores(library.inverted(f), f, TOKENS, PHRASES, table(spark, d, "documents"))


def search_scores(spark, d):
    return _scores(spark, d).select("doc_id", "field", F.round("score", 6).alias("score"))


def search_topk(spark, d):
    identity = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("lang", "source")).otherwise("").alias("identity"))
    return library.ranked(_scores(spark, d), identity, 20).select("doc_id", F.round("score", 3).alias("score"))


def search_sections(spark, d):
    return library.best_sections(_scores(spark, d)).select("doc_id", "field", F.round("score", 6).alias("score"), "rank")


def search_excerpts(spark, d):
    needles = F.array(*[F.lit(x) for x in ("thble", "erand")])
    return table(spark, d, "documents").select("doc_id", T.excerpt("text", needles, 160).alias("excerpt"))


def phrase_hits(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", *[F.contains(low, F.lit(p)).alias(f"p_{p}") for p in PHRASES])


def query_terms(spark, d):
    one = table(spark, d, "region").limit(1).select(F.lit(QUERY).alias("q"))
    return one.select(F.explode(T.query_phrases("q")).alias("phrase"))


def index_delta(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), F.lit(1).alias("mtime"))
    new = docs.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"))
    return library.delta(old, new)


def markdown_sections(spark, d):
    """Sections of Markdown made of the whole texts: the opening holds the text, a numbered heading holds it again, one is empty, one is repeated."""
    text = F.concat(F.lit("# Name\n"), F.col("text"), F.lit("\n## 1. First part\n"), F.col("text"), F.lit("\n## 2、Second\n\n## First part\nmore"))
    made = table(spark, d, "documents").select("doc_id", text.alias("text"))
    return library.sections(made).select("doc_id", "section", F.md5("content").alias("content_md5"))


def benchmark_overlap(spark, d):
    """Trigram Jaccard of each benchmark item with every document that shares a trigram with it."""
    return compare.overlaps(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", digits=6)


def text_compare(spark, d):
    docs = table(spark, d, "documents")
    pairs = docs.select(F.col("doc_id").alias("reference"), (F.col("doc_id") + 1).alias("candidate"))  # each document and the next
    p = compare.profile(docs, "doc_id", "text")
    return compare.compare_texts(pairs, p, p, "style")


def punct_cosine(spark, d):
    """Cosine of the punctuation of each document and the next: counts joined on the mark, norms apart."""
    c = table(spark, d, "documents").select("doc_id", F.explode(T.punctuation("text")).alias("mark")).groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    norm = c.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    left, right = c.select("doc_id", "mark", F.col("n").alias("a")), c.select((F.col("doc_id") - 1).alias("doc_id"), "mark", F.col("n").alias("b"))
    dot = left.join(right, ["doc_id", "mark"]).groupBy("doc_id").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    after = norm.select((F.col("doc_id") - 1).alias("doc_id"), F.col("norm").alias("after"))
    return norm.join(after, "doc_id").join(dot, "doc_id", "left").select("doc_id", F.round(F.coalesce("dot", F.lit(0)) / (F.col("norm") * F.col("after")), 6).alias("cosine"))


_redact = "text"
for _p, _to in T.REDACTIONS:
    _redact = f"regexp_replace({_redact}, {q(_p)}, {q(_to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
_lits = ", ".join(q(t) for t in TOKENS)
SCORES = f"""
WITH f AS (SELECT doc_id, '标题' AS field, 8.0 AS w, split_part(text, chr(10), 1) AS content FROM documents UNION ALL SELECT doc_id, '概览', 2.0, text FROM documents),
t AS (SELECT doc_id, field, w, unnest(regexp_extract_all(lower(content), {q(T.SEARCH_WORD)})) AS token FROM f),
c AS (SELECT doc_id, field, w, token, count(*) AS tf FROM t WHERE token IN ({_lits}) GROUP BY ALL),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM c GROUP BY token), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT doc_id, field, w * ln(1 + (n + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * (1 + ln(tf)) AS s FROM c JOIN df USING (token) CROSS JOIN n
  UNION ALL SELECT doc_id, field, 2.5 * w * ({' + '.join(f'CAST(contains(lower(content), {q(p)}) AS INTEGER)' for p in PHRASES)}) FROM f),
fs AS (SELECT doc_id, field, sum(CAST(s AS DOUBLE)) AS score FROM s GROUP BY doc_id, field HAVING sum(CAST(s AS DOUBLE)) > 0)
"""
_tri = "list_distinct(list_transform(range(1, greatest(1, length({c}) - 1)), lambda i: substring({c}, i, 3)))"
_cmp = lambda a, b: f"exp(-abs(ln((abs({a}) + 1e-6) / (abs({b}) + 1e-6))))"
_bnd = lambda a, b: f"greatest(0.0, least(1.0, 1.0 - abs({a} - {b}) / 0.25))"
_dot = lambda l, r: " + ".join(f"{l}.{g} * {r}.{g}" for g in T.RHETORIC)
_occ = lambda m: f"CAST((length(x) - length(replace(x, {q(m)}, ''))) / {len(m)} AS BIGINT)"
_m = {
    "sentence_length": _cmp("a.mean_sentence", "b.mean_sentence"), "paragraph_length": _cmp("a.mean_paragraph", "b.mean_paragraph"),
    "sentence_length_distribution": "(" + " + ".join(_cmp(f"a.{c}", f"b.{c}") for c in ("p25_sentence", "median_sentence", "p75_sentence")) + ") / 3",
    "lexical_diversity": _cmp("a.lexical_diversity", "b.lexical_diversity"), **{m: _bnd(f"a.{m}", f"b.{m}") for m in ("question_share", "exclamation_share", "heading_share", "list_share")},
    "rhetorical_marker_profile": f"CASE WHEN ({_dot('x', 'x')}) > 0 AND ({_dot('y', 'y')}) > 0 THEN ({_dot('x', 'y')}) / (sqrt({_dot('x', 'x')}) * sqrt({_dot('y', 'y')})) ELSE 0.0 END",
    "length": _cmp("a.characters", "b.characters"), "surface_content_overlap": "len(list_intersect(g.g, h.g)) / CAST(greatest(1, len(list_distinct(list_concat(g.g, h.g)))) AS DOUBLE)",
}
_w = compare.WEIGHTS["style"]

QUERIES = {
    "search_scores": (search_scores, SCORES + "SELECT doc_id, field, round(score, 6) AS score FROM fs"),
    "search_topk": (search_topk, SCORES + ", t2 AS (SELECT doc_id, sum(score) AS score FROM fs GROUP BY doc_id), i AS (SELECT t2.*, CASE WHEN doc_id % 3 = 0 THEN lang || source ELSE '' END AS identity FROM t2 JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY score DESC, doc_id) AS r FROM i) SELECT doc_id, round(score, 3) AS score FROM r WHERE identity = '' OR r = 1 ORDER BY r.score DESC, doc_id LIMIT 20"),
    "search_sections": (search_sections, SCORES + "SELECT doc_id, field, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fs.score DESC, field DESC) AS INTEGER) AS rank FROM fs"),
    "search_excerpts": (search_excerpts, f"WITH c AS (SELECT doc_id, {sql_squeezed('text')} AS c FROM documents), p AS (SELECT *, list_min(list_filter([strpos(lower(c), 'thble'), strpos(lower(c), 'erand')], lambda x: x > 0)) AS p FROM c), s AS (SELECT *, greatest(0, coalesce(p - 1 - 40, 0)) AS a FROM p), e AS (SELECT *, least(length(c), a + 160) AS b FROM s) SELECT doc_id, CASE WHEN length(c) <= 160 THEN c ELSE CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substring(c, a + 1, b - a)) || CASE WHEN b < length(c) THEN '...' ELSE '' END END AS excerpt FROM e"),
    "phrase_hits": (phrase_hits, "SELECT doc_id, " + ", ".join(f"contains(lower(text), {q(p)}) AS p_{p}" for p in PHRASES) + " FROM documents"),
    "query_terms": (query_terms, f"SELECT unnest(list_distinct(list_transform(list_filter(string_split_regex({q(QUERY)}, '([ \\t\\n\\r\\f]|[,，;；|/])+'), lambda p: length(p) >= 2), lambda p: lower(p)))) AS phrase"),
    "index_delta": (index_delta, "WITH a AS (SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS s FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS path, n_chars AS s FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'removed' WHEN a.path IS NULL THEN 'added' WHEN a.s = b.s THEN 'reused' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path"),
    "markdown_sections": (markdown_sections, f"WITH r AS (SELECT doc_id, {_redact} AS t FROM documents), p AS (SELECT doc_id, regexp_replace(t, '^{S}+|{S}+$', '', 'g') AS a FROM r) SELECT doc_id, '概览' AS section, md5(a) AS content_md5 FROM p WHERE a <> '' UNION ALL SELECT doc_id, 'First part', md5(CASE WHEN a <> '' THEN a || chr(10) || 'more' ELSE 'more' END) FROM p"),
    "benchmark_overlap": (benchmark_overlap, ""),  # SQL takes minutes over whole tables; tested by brute force
    "text_compare": (text_compare, STYLE + f", x0 AS (SELECT doc_id, lower(text) AS x FROM documents), r AS (SELECT doc_id, {', '.join(f'{chr(43).join(map(_occ, ms))} AS {g}' for g, ms in T.RHETORIC.items())} FROM x0), c AS (SELECT doc_id, lower(regexp_replace(text, '{S}', '', 'g')) AS c FROM documents), g AS (SELECT doc_id, {_tri.format(c='c')} AS g FROM c) SELECT a.doc_id AS reference, b.doc_id AS candidate, round(100.0 * ({' + '.join(f'({e}) * {_w[m]}' for m, e in _m.items())}) / {sum(_w[m] for m in _m)}, 2) AS form_proxy_score, {', '.join(f'round(({e}) * 100, 2) AS {m}' for m, e in _m.items())} FROM style a JOIN style b ON b.doc_id = a.doc_id + 1 JOIN r x ON x.doc_id = a.doc_id JOIN r y ON y.doc_id = b.doc_id JOIN g ON g.doc_id = a.doc_id JOIN g h ON h.doc_id = b.doc_id"),
    "punct_cosine": (punct_cosine, f"WITH m AS (SELECT doc_id, unnest(list_filter(string_split(text, ''), lambda c: contains({q(T.PUNCTUATION)}, c) AND c <> '')) AS mark FROM documents), c AS (SELECT doc_id, mark, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id), d AS (SELECT a.doc_id, sum(a.n * b.n) AS dot FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND a.mark = b.mark GROUP BY a.doc_id) SELECT s.doc_id, round(coalesce(dot, 0) / (s.norm * t.norm), 6) AS cosine FROM s JOIN s t ON t.doc_id = s.doc_id + 1 LEFT JOIN d ON d.doc_id = s.doc_id"),
}
