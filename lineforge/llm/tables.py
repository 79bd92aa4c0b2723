"""Tables and session settings the text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.session import prepare

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BATCH_ROWS = 500  # rows a Python worker holds at once, texts included


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; the folds of the learning operators."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor
