import pytest
from oracle import differences

from evidex.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_license": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op3_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op4_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_exact_topk": {"query_id", "rank", "vec_id", "score"},
    "op7_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op8_bpe_roundtrip": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    _, found = differences(spark, name, Q.queries()[name], Q.oracle_sql()[name], SF)
    assert not found, found


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, name):
    df = Q.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    if name not in ("op6_exact_topk", "op9_embedding_dedup"):
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_language_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = Q.op10_language_id(spark, sf).where("held_out").join(lang, "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
