"""Queries over documents, pages and embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import chunking, corpus
from evidex.sources import html
from evidex.sources.tables import table

S = r"[ \t\n\r\f\x0b]"
SQL_CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def sql_squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'))"


def sql_sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, {q(T.SENTENCE)}), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_lines(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\r\n|\n|\r'), lambda s: {sql_strip('s')}), lambda s: s <> '')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(T.ASCII_WORD)})"


def sql_tokens(x: str) -> str:
    return f"list_transform({sql_words(x)}, lambda w: lower(w))"


def sql_quantile(sorted_list: str, p: float) -> str:
    at = f"((len({sorted_list}) - 1) * CAST({p} AS DOUBLE))"
    low = f"CAST(floor({at}) AS BIGINT)"
    a, b = f"{sorted_list}[{low} + 1]", f"coalesce({sorted_list}[{low} + 2], {sorted_list}[{low} + 1])"
    return f"CASE WHEN len({sorted_list}) > 0 THEN {a} + ({b} - {a}) * ({at} - {low}) ELSE 0.0 END"


STYLE = f"""
WITH p AS (SELECT doc_id, lang, text AS t, {sql_sentences('text')} AS s,
    list_filter(list_transform(string_split_regex(text, '\\n{S}*\\n'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p,
    {sql_tokens('text')} AS k, {sql_lines('text')} AS l FROM documents),
m AS (SELECT *, list_sort(list_transform(s, lambda x: len({sql_words('x')}) + len(regexp_extract_all(x, '{SQL_CJK}')))) AS n, list_sort(list_transform(p, lambda x: length(x))) AS pl FROM p),
style AS (SELECT doc_id, CAST(length(t) AS BIGINT) AS characters, CAST(len(regexp_extract_all(t, '{SQL_CJK}')) AS BIGINT) AS cjk_characters,
    CAST(len({sql_words('t')}) AS BIGINT) AS ascii_words, CAST(len(p) AS BIGINT) AS paragraphs, CAST(len(s) AS BIGINT) AS sentences,
    round(coalesce(list_sum(n), 0) / CAST(greatest(len(n), 1) AS DOUBLE), 2) AS mean_sentence, round({sql_quantile('n', 0.25)}, 2) AS p25_sentence,
    round({sql_quantile('n', 0.5)}, 2) AS median_sentence, round({sql_quantile('n', 0.75)}, 2) AS p75_sentence, CAST(coalesce(list_max(n), 0) AS BIGINT) AS max_sentence,
    round(coalesce(list_sum(pl), 0) / CAST(greatest(len(pl), 1) AS DOUBLE), 2) AS mean_paragraph, round({sql_quantile('pl', 0.5)}, 2) AS median_paragraph,
    round(len(list_distinct(k)) / CAST(greatest(len(k), 1) AS DOUBLE), 4) AS lexical_diversity,
    round(len(list_filter(s, lambda x: regexp_matches(x, '[?？]$'))) / CAST(greatest(len(s), 1) AS DOUBLE), 4) AS question_share,
    round(len(list_filter(s, lambda x: regexp_matches(x, '[!！]$'))) / CAST(greatest(len(s), 1) AS DOUBLE), 4) AS exclamation_share,
    round(len(list_filter(l, lambda x: regexp_matches(x, {q(T.HEADING_LINE)}))) / CAST(greatest(len(l), 1) AS DOUBLE), 4) AS heading_share,
    round(len(list_filter(l, lambda x: regexp_matches(x, {q(T.LIST_LINE)}))) / CAST(greatest(len(l), 1) AS DOUBLE), 4) AS list_share,
    CAST(len(regexp_extract_all(t, '[“”"‘’]')) AS BIGINT) AS quote_marks FROM m)
"""


def exact_dup_groups(spark, d):
    return corpus.exact_duplicates(table(spark, d, "documents"))


def style_metrics(spark, d):
    return corpus.style_metrics(table(spark, d, "documents"))


def style_distributions(spark, d):
    return corpus.distributions(corpus.style_metrics(table(spark, d, "documents")))


def style_by_lang(spark, d):
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    each = docs.select("lang", F.length(text).alias("c"), F.size(T.sentences(text)).alias("s"), T.count_of(text, T.ASCII_WORD).alias("w"))
    return each.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("c").alias("characters"), F.sum("s").alias("sentences"), F.sum("w").alias("words"))


def top_tokens_per_doc(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.tokens("text")).alias("token"))
    return corpus.top_per_group(rows, ["doc_id"], "token", 30).select("doc_id", "token", "n", "rank")


def punctuation_hist(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.punctuation("text")).alias("mark")).groupBy("doc_id", "mark").agg(F.count("*").alias("n"))


def sentence_quantiles(spark, d):
    lengths = table(spark, d, "documents").select("lang", F.explode(T.sentences("text")).alias("s")).select("lang", T.word_length("s").alias("n"))
    found = corpus.quantiles(lengths, ["lang"], "n", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return found.select("lang", F.col("n").alias("sentences"), "p25", "median", "p75", F.col("largest").cast("bigint").alias("longest"))


def doc_samples(spark, d):
    t, n = F.col("text"), F.length("text")
    mid = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - 450)
    long = n > 2700
    return table(spark, d, "documents").select("doc_id", F.when(long, F.substring(t, 1, 900)).otherwise(t).alias("opening"), F.when(long, F.substring(t, mid + 1, F.lit(900))).alias("middle"), F.when(long, F.substring(t, -900, 900)).alias("ending"))


def doc_chunks(spark, d):
    return chunking.chunks(table(spark, d, "documents"), 1000).select("doc_id", "chunk", "characters", F.md5("content").alias("content_md5"))


def boilerplate_lines(spark, d):
    return corpus.boilerplate(table(spark, d, "documents"), least_share=0.002)


def near_dup_pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.signature("text").alias("signature"), corpus.simhash_md5("text").alias("simhash"))
    return corpus.hamming_pairs(docs, "doc_id", "simhash", 5, "signature")


def near_dup_embeddings(spark, d):
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))
    return corpus.hamming_pairs(table(spark, d, "embeddings").select("vec_id", bits.alias("h")), "vec_id", "h", 16)


def embedding_cosine(spark, d):
    """Mean cosine of each label's vectors to the label's centre: the centre is summed before the shuffle, its table is broadcast by size only."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select("vec_id", "label", "i", F.col("x").cast("double").alias("x"))
    centre = e.groupBy("label", "i").agg(F.avg("x").alias("c"))
    both = e.join(centre, ["label", "i"])
    each = both.groupBy("vec_id", "label").agg((F.sum(F.col("x") * F.col("c")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("c") * F.col("c")))).alias("cosine"))
    return each.select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


def redacted_documents(spark, d):
    t = F.concat(F.col("text"), F.lit("\napi_key = abcdef0123456789 sk-"), F.sha2("text", 256))
    return table(spark, d, "documents").select("doc_id", F.md5(T.redacted(t)).alias("redacted_md5"))


def secret_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in T.secret_flags("text").items()])


def rhetoric_profile(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in T.rhetoric("text").items()])


def html_outline(spark, d):
    return html.outline(table(spark, d, "pages"), "page_id", "html")


def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(html.text("html")).alias("text_md5"), F.length(html.text("html")).cast("bigint").alias("characters"))


def safe_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_url("url").alias("safe_url"))


def slug_ids(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug("url").alias("slug"))


def token_df(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(F.array_distinct(T.search_tokens("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("documents"))


_redact = "text || E'\\napi_key = abcdef0123456789 sk-' || sha256(text)"
for _p, _to in T.REDACTIONS:
    _redact = f"regexp_replace({_redact}, {q(_p)}, {q(_to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
_occ = lambda m: f"CAST((length(x) - length(replace(x, {q(m)}, ''))) / {len(m)} AS BIGINT)"
_bits = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CASE WHEN i = 64 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << CAST(i - 1 AS INTEGER) END ELSE CAST(0 AS BIGINT) END)), lambda a, b: a | b)"



def sql_runs(rows: str, key: str, glue: int, limit: int) -> str:
    """Recursive tables z (running sizes) and r (key, first and last item, run) of consecutive items (key, k, x) that fit into the limit."""
    return f"""z{glue} AS (SELECT {key}, k, x, sum(length(x) + {glue}) OVER (PARTITION BY {key} ORDER BY k) AS upto, sum(length(x) + {glue}) OVER (PARTITION BY {key} ORDER BY k) - length(x) - {glue} AS before FROM {rows}),
r{glue}({key}, run, a, start) AS (SELECT {key}, 0, min(k), CAST(0 AS HUGEINT) FROM z{glue} GROUP BY {key}
  UNION ALL SELECT r.{key}, r.run + 1, n.k, n.before FROM r{glue} r JOIN LATERAL (SELECT min(z.k) AS k, min(z.before) AS before FROM z{glue} z WHERE z.{key} = r.{key} AND z.k > r.a AND z.upto - r.start > {limit}) n ON n.k IS NOT NULL)"""


#: Paragraphs, long ones as runs of sentences or as slices; then runs of these.
CHUNKS = f"""
WITH RECURSIVE g AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n{S}*\\n'), lambda x: {sql_strip('x')}), lambda x: x <> '') AS p FROM documents)),
h AS (SELECT *, doc_id || ':' || i AS id, {sql_sentences('p')} AS s FROM g),
e AS (SELECT id, unnest(range(len(s))) AS k, unnest(s) AS x FROM h WHERE length(p) > 1000 AND len(s) > 1),
{sql_runs('e', 'id', 1, 1000)},
q AS (SELECT id, run, a, lead(a) OVER (PARTITION BY id ORDER BY run) AS b FROM r1),
f AS (SELECT doc_id, i, 0 AS j, p AS x FROM h WHERE length(p) <= 1000
  UNION ALL SELECT doc_id, i, j, substring(p, CAST(j * 1000 + 1 AS INTEGER), 1000) FROM (SELECT *, unnest(range(CAST(ceil(length(p) / 1000.0) AS BIGINT))) AS j FROM h WHERE length(p) > 1000 AND len(s) <= 1)
  UNION ALL SELECT h.doc_id, h.i, q.run, array_to_string(h.s[q.a + 1:coalesce(q.b, len(h.s))], chr(10)) FROM q JOIN h USING (id)),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS k, x FROM f),
{sql_runs('o', 'doc_id', 2, 1000)},
m AS (SELECT doc_id, run, a, lead(a) OVER (PARTITION BY doc_id ORDER BY run) AS b FROM r2),
c AS (SELECT m.doc_id, m.run, string_agg(o.x, chr(10) || chr(10) ORDER BY o.k) AS c FROM m JOIN o ON o.doc_id = m.doc_id AND o.k >= m.a AND (m.b IS NULL OR o.k < m.b) GROUP BY m.doc_id, m.run)
SELECT doc_id, CAST(run AS INTEGER) AS chunk, CAST(length(c) AS INTEGER) AS characters, md5(c) AS content_md5 FROM c
"""

QUERIES = {
    "exact_dup_groups": (exact_dup_groups, f"SELECT sha256(lower(regexp_replace(text, '{S}', '', 'g'))) AS signature, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "style_metrics": (style_metrics, STYLE + "SELECT * FROM style"),
    "style_distributions": (style_distributions, STYLE + ", long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM style" for m in corpus.METRICS) + ") SELECT metric, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75 FROM long GROUP BY metric"),
    "style_by_lang": (style_by_lang, f"SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len({sql_sentences('text')})) AS BIGINT) AS sentences, CAST(sum(len({sql_words('text')})) AS BIGINT) AS words FROM documents GROUP BY lang"),
    "top_tokens_per_doc": (top_tokens_per_doc, f"WITH t AS (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, token, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS INTEGER) AS rank FROM c QUALIFY rank <= 30"),
    "punctuation_hist": (punctuation_hist, f"SELECT doc_id, mark, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(string_split(text, ''), lambda c: contains({q(T.PUNCTUATION)}, c) AND c <> '')) AS mark FROM documents) GROUP BY ALL"),
    "sentence_quantiles": (sentence_quantiles, f"WITH s AS (SELECT lang, unnest({sql_sentences('text')}) AS s FROM documents), n AS (SELECT lang, len({sql_words('s')}) + len(regexp_extract_all(s, '{SQL_CJK}')) AS n FROM s) SELECT lang, count(*) AS sentences, quantile_cont(CAST(n AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median, quantile_cont(CAST(n AS DOUBLE), 0.75) AS p75, CAST(max(n) AS BIGINT) AS longest FROM n GROUP BY lang"),
    "doc_samples": (doc_samples, "SELECT doc_id, CASE WHEN length(text) > 2700 THEN substring(text, 1, 900) ELSE text END AS opening, CASE WHEN length(text) > 2700 THEN substring(text, greatest(0, length(text) // 2 - 450) + 1, 900) END AS middle, CASE WHEN length(text) > 2700 THEN right(text, 900) END AS ending FROM documents"),
    "doc_chunks": (doc_chunks, CHUNKS),
    "boilerplate_lines": (boilerplate_lines, f"WITH l AS (SELECT unnest(list_distinct(list_transform({sql_lines('text')}, lambda s: {sql_squeezed('s')}))) AS line FROM documents), c AS (SELECT line, count(*) AS documents_with FROM l WHERE length(regexp_replace(line, '{S}', '', 'g')) BETWEEN 8 AND 240 GROUP BY line ORDER BY documents_with DESC, line LIMIT 100) SELECT * FROM c WHERE documents_with >= greatest(2, ceil((SELECT count(*) FROM documents) * CAST(0.002 AS DOUBLE)))"),
    "near_dup_pairs": (near_dup_pairs, f"""
WITH c AS (SELECT doc_id, lower(regexp_replace(text, '{S}', '', 'g')) AS c FROM documents),
g AS (SELECT doc_id, sha256(c) AS sig, c, greatest(1, length(c) - 4) AS n FROM c),
s AS (SELECT doc_id, ('0x' || substr(md5(substring(c, CAST(i + 1 AS INTEGER), 5)), 1, 16))::UBIGINT AS h FROM (SELECT doc_id, c, unnest(range(0, n)) AS i FROM g)),
b AS (SELECT doc_id, {', '.join(f'CASE WHEN 2 * count(*) FILTER ((h & CAST({1 << k} AS UBIGINT)) <> 0) >= count(*) THEN CAST({1 << k} AS UBIGINT) ELSE CAST(0 AS UBIGINT) END AS b{k}' for k in range(64))} FROM s GROUP BY doc_id),
f AS (SELECT doc_id, {' | '.join(f'b{k}' for k in range(64))} AS h FROM b), x AS (SELECT f.doc_id, h, sig FROM f JOIN g USING (doc_id))
SELECT a.doc_id AS left_id, b.doc_id AS right_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM x a JOIN x b ON a.doc_id < b.doc_id AND a.sig <> b.sig AND bit_count(xor(a.h, b.h)) <= 5"""),
    "near_dup_embeddings": (near_dup_embeddings, f"WITH h AS (SELECT vec_id, {_bits} AS h FROM embeddings) SELECT a.vec_id AS left_id, b.vec_id AS right_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 16"),
    "embedding_cosine": (embedding_cosine, "WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY ALL) SELECT vec_id, label, round(sum(x * c) / sqrt(sum(x * x) * sum(c * c)), 6) AS cosine FROM e JOIN c USING (label, i) GROUP BY vec_id, label"),
    "redacted_documents": (redacted_documents, f"SELECT doc_id, md5({_redact}) AS redacted_md5 FROM documents"),
    "secret_flags": (secret_flags, "SELECT doc_id, " + ", ".join(f"regexp_matches(text, {q(p)}) AS {n}" for n, p in T.SECRET_KINDS.items()) + " FROM documents"),
    "rhetoric_profile": (rhetoric_profile, "SELECT doc_id, " + ", ".join(f"{' + '.join(map(_occ, ms))} AS {g}" for g, ms in T.RHETORIC.items()) + " FROM (SELECT doc_id, lower(text) AS x FROM documents)"),
    "html_outline": (html_outline, html.OUTLINE_SQL),
    "html_text": (html_text, f"SELECT page_id, md5({html.text_sql('html')}) AS text_md5, CAST(length({html.text_sql('html')}) AS BIGINT) AS characters FROM pages"),
    "safe_urls": (safe_urls, "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/@?#]+([/?#]|$)') THEN regexp_replace(url, '[?#].*$', '') END AS safe_url FROM pages"),
    "slug_ids": (slug_ids, r"SELECT page_id, CASE WHEN length(s) > 0 THEN s ELSE 'source' END AS slug FROM (SELECT page_id, lower(substring(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)) AS s FROM pages)"),
    "token_df": (token_df, f"SELECT token, count(*) AS documents FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), {q(T.SEARCH_WORD)}))) AS token FROM documents) GROUP BY token"),
}
