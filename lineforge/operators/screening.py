"""Cleaning and screening of incoming text and of model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineforge.functions import text as tx


def sanitize_text(rows: DataFrame, col: str = "text") -> DataFrame:
    return rows.withColumn(col, tx.sanitize(F.col(col)))


def check_injection(rows: DataFrame, col: str = "text", dialect: str = "py") -> DataFrame:
    """Adds ``matched``: the description of the first rule that hits, or null."""
    return rows.withColumn("matched", tx.screen(F.col(col), dialect))


def strip_fences(rows: DataFrame, col: str = "text") -> DataFrame:
    return rows.withColumn("cleaned", tx.strip_fences(F.col(col)))


def extract_fenced(rows: DataFrame, col: str = "text") -> DataFrame:
    return rows.withColumn("cleaned", tx.extract_fenced(F.col(col)))


def off_task_flag(rows: DataFrame, col: str = "text", anywhere: bool = False) -> DataFrame:
    """Cleans a reply (fences at the ends, or the first fence anywhere) and flags it if off task."""
    clean = tx.extract_fenced if anywhere else tx.strip_fences
    return rows.withColumn("cleaned", clean(F.col(col))).withColumn("suspicious", tx.off_task(F.col("cleaned")))
