"""From raw documents to token ids: toxic texts out, near duplicates out, personal data replaced, languages mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows into the shared folder and
reads them again for the next.  No SQL expresses the first stage, so none is given for the whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.bpe import bpe_encode
from evidex.llm.common import read_table, written
from evidex.llm.mixing import mix_to_targets, repeated
from evidex.llm.neardup import BROADCAST_IDS, near_duplicates
from evidex.llm.pii import sanitised
from evidex.llm.toxicity import without_toxic


#: Rows that go to a Python worker at once: texts can be long, and two workers share an executor with its heap.
BATCH_ROWS = 1000
#: Pre-tokens that a worker keeps: half of what encoding alone keeps, as the stages before it have used memory too.
CACHED_PIECES = 300_000


def _bounded(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learned from all labelled rows, stays below 0.5.

    Null and empty texts stay; repeated rows are judged alike; long texts are judged
    by all their windows; an empty table stays empty.  All columns, whatever their
    names, pass through.
    """
    _bounded(spark)
    return without_toxic(docs, read_table(spark, sf_dir, "labels"), F.lit(True))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked at 0.8 on five-word shingles.

    Texts without words (null, empty, blank) are linked with nothing and stay, as do
    rows without an id.  A row repeated under its own id stays once; different texts
    of one id are one document and stay together.  All columns pass through.
    """
    _bounded(spark)
    gone = written(near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct(), "pipeline-gone")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-again")
    n = again.count()
    if not n:
        return left
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    return left.join(again, "doc_id", "left_anti").select(docs.columns).unionAll(left.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data and the terms that reveal it replaced; n_chars follows the text.

    A null text stays null; every row stays, repeated ones alike; all other columns
    stay as they are, whatever their names.
    """
    clean = sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the rarer languages repeated: token shares follow the square root of what they are; none is dropped.

    Rows without text, language or id stay at least once; rows that share an id are
    repeated alike.  All columns pass through.
    """
    rates = mix_to_targets(docs, docs, weights=0.5, min_rate=1.0, among=read_table(spark, sf_dir, "labels"))
    return repeated(docs, rates).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, their number, and hashes of the ids and of what they decode to; none for a null or empty text."""
    _bounded(spark)
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, cache_entries=CACHED_PIECES)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
