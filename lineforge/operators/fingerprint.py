"""Structural fingerprints of log lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineforge.functions import text as tx
from lineforge.operators import ranking
from lineforge.session import materialize


def line_skeleton(lines: DataFrame, col: str = "raw") -> DataFrame:
    return lines.withColumn("skeleton", tx.skeleton(F.col(col)))


def line_signature(lines: DataFrame, col: str = "raw") -> DataFrame:
    return lines.withColumn("signature", tx.signature(F.col(col)))


def signature_rollup(
    lines: DataFrame, group: Sequence[str] = ("source",), col: str = "raw", order: str = "line_id"
) -> DataFrame:
    """Lines per signature with the first of them as sample.

    Counts and first ids are numbers, so they combine in hash maps, map-side: a shape that makes up a third of
    all lines leaves each map task as one row. The sample texts are fetched afterwards, for the first ids only: these are
    written first, so that Spark knows their size and broadcasts them, or a Bloom filter of them, to the lines.
    """
    keys = [*group, "signature"]
    counts = line_signature(lines, col).groupBy(*keys).agg(F.count("*").alias("lines"), F.min(order).alias(order))
    counts = materialize(counts, "signatures").filter("lines > 0")  # a filter on its side lets Spark add a Bloom filter
    wanted = counts.withColumnRenamed("signature", "__wanted")
    fetched = ranking.join_on(lines.select(*group, order, col), wanted, [*group, order])
    # lines that share an id are told apart by their signature
    own = line_signature(fetched, col).filter(F.col("signature") == F.col("__wanted"))
    return own.groupBy(*keys, "lines", F.col(order).alias("first_id")).agg(
        F.array_min(F.collect_set(col)).alias("sample"))
