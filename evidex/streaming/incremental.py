"""Structured Streaming forms (an extension): exactly-once file intake, windowed counts, incremental index refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.operators import library


def files(spark: SparkSession, folder: str, schema, per_trigger: int = 64) -> DataFrame:
    """A stream of Parquet files; the checkpoint remembers which were read, which is what resuming a run needs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Fixed segments of event time with a count and a sum; rows later than the watermark are left out in append mode."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def index_writer(folder: str):
    """For foreachBatch: puts a batch's fields (doc_id, field, content) into the inverted table, one folder a batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        library.inverted(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
