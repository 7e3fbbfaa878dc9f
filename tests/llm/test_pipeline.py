import hashlib
import re

import corpus_pipeline as p
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in p.STAGES:
        out.append(p.written(stage(spark, out[-1], SF), "test"))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "personal_data", "mixing", "encoding"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxic_and_copies_go(stages):
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in stages]
    assert ids[1] <= ids[0] and len(ids[1]) > 0.7 * len(ids[0])
    rows = {r.doc_id: r.text.encode().lower().split() for r in stages[1].collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in rows.items()}
    up = {i: i for i in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and sets[b]:
                s = len(sets[a] & sets[b])
                if 100 * s >= 80 * (len(sets[a]) + len(sets[b]) - s):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    assert ids[2] == {i for i in rows if find(i) == i}


def test_personal_data_is_replaced(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert any(email.search(r.text) for r in before.values()) and not any(email.search(r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_mixing_drops_nothing(stages):
    a, b = ([r[0] for r in s.select("doc_id").collect()] for s in stages[3:5])
    assert set(a) == set(b) and len(b) >= len(a)


def test_encoding_round_trip(stages):
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in rows)


def test_run(spark, stages):
    assert p.run(spark, SF).count() == stages[5].count()


CLASH = ["spans", "_copies", "copies", "score", "kept", "rate", "_row", "_times", "_at", "_id", "_text", "_key", "domain", "component_id", "base_spans", "n_email"]


def test_odd_rows_and_clashing_names_pass_all_stages(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(900_001, None, None, None, None), (900_002, "", "en", None, 0), (900_003, " \t ", None, "web", 3), (None, "a text without an id", "en", "web", 20), (900_004, long, "en", "web", len(long)), (900_005, "mail a.b@c.example.org now", None, None, None)]
    rows += [(900_006, "one and the same short text that comes again and again", "en", "web", 54)] * 3
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = base.limit(60).unionByName(spark.createDataFrame(rows, base.schema))
    for c in CLASH:
        docs = docs.withColumn(c, p.F.lit("kept"))
    docs = p.written(docs, "test")
    for _, stage in p.STAGES[:-1]:
        then = p.written(stage(spark, docs, SF), "test")
        assert then.columns == docs.columns and not then.where(" OR ".join(f"`{c}` <> 'kept'" for c in CLASH)).count()
        docs = then
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert {900_001, 900_002, 900_003, None, 900_004, 900_005, 900_006} <= set(ids)
    texts = {r.doc_id: r.text for r in docs.where("doc_id > 900000").collect()}
    assert texts[900_001] is None and texts[900_002] == "" and "@" not in texts[900_005]
    assert p.encoding(spark, docs, SF).count() == len(ids)


def test_a_row_repeated_under_its_id_stays_once(spark):
    rows = [(i, f"document number {i} speaks of {i * 7} other things entirely") for i in (1, 2, 3)]
    docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in p.near_dedup(spark, docs, SF).collect()) == [1, 2, 3]


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0
