"""Where results go: whole JSON and text files, written once unless a run is resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def prepared(spark: SparkSession, path: str, resume: bool = False) -> str:
    """The folder, made if it isn't there; one that holds something is refused unless the run is resumed."""
    at, files = _folder(spark, path)
    if files.exists(at) and not resume and len(files.listStatus(at)):
        raise FileExistsError(f"{path} is not empty; resume the run or choose another folder")
    files.mkdirs(at)
    return path


def write_json(rows: DataFrame, path: str, resume: bool = False) -> None:
    """One JSON object a line; committed as a whole, so a reader never sees half of it."""
    rows.write.mode("overwrite" if resume else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_texts(rows: DataFrame, path: str, name: str = "name", text: str = "text", resume: bool = False) -> None:
    """A folder a name, with its text in a file: the name is a partition, the text its content."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite" if resume else "errorifexists").partitionBy("name").text(path)


def exit_status(items: DataFrame, status: str = "status") -> int:
    """1 when any item failed, else 0."""
    return int(items.where(F.col(status) == "failed").limit(1).count() > 0)
