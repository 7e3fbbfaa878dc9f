import hashlib
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidex.functions import text as T
from evidex.operators import chunking, corpus, library


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_cjk_tokens(spark):
    assert one(spark, "Ab c1 你好吗 x好", T.tokens("x")) == ["ab", "c1", "x", "你好", "好吗", "吗好"]
    assert one(spark, "你", T.search_tokens("x")) == []
    assert one(spark, "你好", T.search_tokens("x")) == ["你好", "你好"]
    assert one(spark, "你好吗", T.search_tokens("x")) == ["你好吗", "你好", "好吗", "你好吗"]
    assert len(one(spark, "一二三四五六七八九十", T.search_tokens("x"))) == 1 + 9 + 8
    assert len(one(spark, "一二三四五六七八九十百", T.search_tokens("x"))) == 10 + 9


def test_sentences(spark):
    assert one(spark, "A 3.14! 好。  ? ", T.sentences("x")) == ["A 3.", "14!", "好。", "?"] or one(spark, "A 3.14! 好。", T.sentences("x")) == ["A 3.", "14!", "好。"]


def test_substantive(spark):
    rows = [(None, False), ("", False), (" n/A ", False), ("待补充", False), ("ok", True), ("o", False), ("a  b", True)]
    got = spark.createDataFrame(rows, "x string, y boolean").select(T.is_substantive("x", 2), "y").collect()
    assert all(r[0] == r[1] for r in got)


def test_redaction_takes_secrets_and_is_idempotent(spark):
    text = "a sk-" + "x" * 24 + " ghp_" + "y" * 22 + " Authorization: Bearer abc.def api_key = 'abcdefghijkl1' password: short token = abcdefghijklmnop\n-----BEGIN RSA PRIVATE KEY-----\nq\n-----END RSA PRIVATE KEY-----"
    out = one(spark, text, T.redacted("x"))
    assert out == "a <redacted> <redacted> Authorization: Bearer <redacted> api_key = <redacted> password: short token = abcdefghijklmnop\n<redacted-private-key>"
    assert one(spark, out, T.redacted("x")) == out


def test_safe_url(spark):
    rows = [("https://a.b/c?d#e", "https://a.b/c"), ("http://u:p@a.b/", None), ("ftp://a.b", None), ("https://", None), ("https://a.b", "https://a.b")]
    assert all(r[0] == r[1] for r in spark.createDataFrame(rows, "x string, y string").select(T.safe_url("x"), "y").collect())


def test_excerpt_and_phrases(spark):
    text = "start " + "x " * 200 + "needle here " + "y " * 200
    out = one(spark, text, T.excerpt("x", F.array(F.lit("needle")), 100))
    assert out.startswith("...") and out.endswith("...") and "needle here" in out and len(out) <= 106
    assert one(spark, "Ab, cd；ab|x 好的", T.query_phrases("x")) == ["ab", "cd", "好的"]


def test_style_of_headings_lists_quotes(spark):
    text = '# Title\n\n- one\n* two\n1. three\nplain "q"?\n\nlast!'
    r = corpus.style_metrics(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert r[0].paragraphs == 3 and r[0].heading_share == round(1 / 6, 4) and r[0].list_share == 0.5 and r[0].quote_marks == 2
    assert r[1].characters == 0 and r[1].median_sentence == 0 and r[1].lexical_diversity == 0


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), max_size=9), st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]))
def test_quantile(spark, values, q):
    s = sorted(values)
    at = q * (len(s) - 1)
    want = (s[int(at)] + (s[min(int(at) + 1, len(s) - 1)] - s[int(at)]) * (at - int(at))) if s else 0.0
    got = spark.createDataFrame([(s,)], "v array<int>").select(T.quantile(F.col("v"), q)).first()[0]
    assert math.isclose(got, want, abs_tol=1e-9)


def test_hamming_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    hashes = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 5, 6)]
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    got = {tuple(r) for r in corpus.hamming_pairs(spark.createDataFrame(rows, "id int, h bigint"), "id", "h").collect()}
    assert got == {(i, j, n) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (n := (a ^ b).bit_count()) <= 5}


def test_exact_duplicates_and_simhash(spark):
    rows = [(1, "同样的 文本 A"), (2, "同样的文本\na"), (3, "别的")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    r = corpus.exact_duplicates(df).collect()
    assert len(r) == 1 and r[0].copies == 2 and r[0].first_id == 1 and r[0].signature == hashlib.sha256("同样的文本a".encode()).hexdigest()
    h = {r.doc_id: r.h for r in df.select("doc_id", corpus.simhash("text").alias("h")).collect()}
    assert h[1] == h[2] != h[3]


def test_boilerplate_threshold(spark):
    rows = [(i, "a shared line here\nown line number %d\nshort" % i if i < 6 else "nothing in common %d" % i) for i in range(10)]
    got = corpus.boilerplate(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert [(r.line, r.documents_with) for r in got] == [("a shared line here", 6)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .!\n", min_size=1, max_size=700), max_size=8))
def test_chunks_keep_all_text(parts):
    text = "\n\n".join(parts)
    found = chunking.chunks_of(text, 1000)
    assert "".join("".join(c.split()) for _, _, c in found) == "".join(text.split())
    assert all(0 <= a <= b <= len(text) for a, b, _ in found)


def test_long_sentence_is_cut_and_library_subject(spark):
    assert [len(c) for _, _, c in chunking.chunks_of("x" * 2500, 1000)] == [1000, 1000, 500]
    assert one(spark, "项目地址 x\n\n`Foo`是一个工具", library.subject(F.col("x"))) == "foo"
    assert one(spark, "这是一个工具", library.subject(F.col("x"))) == ""


def test_simhash_takes_every_shingle(spark):
    """Texts of more than 24,000 characters, and more shingles than are counted at a time."""
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh", k=n)) for n in (3, 24_003, 24_005, 30_001, 66_000)]
    got = [r.h for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", corpus.simhash_md5("t").alias("h")).orderBy("i").collect()]
    for text, h in zip(texts, got, strict=True):
        n = max(1, len(text) - 4)
        hashes = [int.from_bytes(hashlib.md5(text[i : i + 5].encode()).digest()[:8], "big") for i in range(n)]
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in hashes) >= n)
        assert h % (1 << 64) == want
