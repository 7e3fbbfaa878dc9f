import random

import pytest
from oracle import differences

from evidex.operators import style
from evidex.plans import catalogue

ODD = ["", " ", "\n", "\n\n", ".", "..", " . ", "a", "-", "'_-", "-a-b 'c' _", "a.b?c!d", "a\n\nb", "\n\n a \n \n\n b\n", "# h\n#\n# \n####### no\n#x\n  ## y z", "- a\n-\n- \n* b\r\n+ c\r1. d\n12) e\n3、f\n4 g", "你好。再见？好！", "中文 ab 中, 文中文", "“a” ‘b’ \"c\"", "é.É? ñ", "x" * 40 + ".", "a\x0b\n\x0c\nb", "tail  ", "a. ", "a.\n", "Word word WORD wor-d", "😀. 😀?"]


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_odd_texts_equal_sql(spark, tmp_path, monkeypatch, most):
    """Every edge alone, at random together, and in parts of a few bytes."""
    monkeypatch.setattr(style, "AT_A_TIME", most)
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choices([*ODD, " ", "\n", ". ", "word ", "字"], k=rng.randint(1, 12))) for _ in range(300)]
    spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id bigint, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.execute(catalogue.oracle_sql()["style_metrics"])
    names = [d[0] for d in rel.description]
    want = {r[0]: dict(zip(names, r)) for r in rel.fetchall()}
    got = {r.doc_id: r.asDict() for r in catalogue.queries()["style_metrics"](spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        assert {c: v for c, v in got[k].items() if c != "lexical_diversity"} == {c: v for c, v in want[k].items() if c != "lexical_diversity"}, repr(t)
        words = style.re.findall(r"[A-Za-z0-9][A-Za-z0-9'_-]*", t)
        han = "".join(style.re.findall("[㐀-䶿一-鿿]", t))
        tokens = [w.lower() for w in words] + [han[i : i + 2] for i in range(len(han) - 1)]
        assert got[k]["lexical_diversity"] == round(len(set(tokens)) / max(1, len(tokens)), 4), repr(t)


def test_text_compare_of_odd_texts_equals_sql(spark, tmp_path, monkeypatch):
    """Trigrams of any characters, markers in capitals, texts without trigrams; one pass over the texts of each side."""
    monkeypatch.setattr(style, "AT_A_TIME", 50)
    rng = random.Random(7)
    parts = [*ODD, "However, YOU ", "但是 你们 ", "i we my ", "yyouyou", "例如", "für ", "😀😃 ", "in conclusion"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(250)]
    texts = [t for t in texts if not style.re.search("[㐀-䶿一-鿿]{2}", "".join(style.re.findall("[㐀-䶿一-鿿]", t)))]  # the SQL has no pairs of these among its tokens
    spark.createDataFrame([(k, "en", t) for k, t in enumerate(texts)], "doc_id bigint, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    n, found = differences(spark, "text_compare", catalogue.queries()["text_compare"], catalogue.oracle_sql()["text_compare"], str(tmp_path))
    assert n == len(texts) - 1 and not found, found
    plan = catalogue.queries()["text_compare"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("Join") == 2


def test_measures_take_no_pass_of_patterns(spark):
    plan = catalogue.queries()["style_distributions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan


def test_distributions_equal_sql(spark):
    assert differences(spark, "style_distributions", catalogue.queries()["style_distributions"], catalogue.oracle_sql()["style_distributions"], "/root/testdata/sf0.01")[1] == []
