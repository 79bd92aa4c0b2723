"""Sinks: events and dead letters, and text encodings of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS, DEAD_LETTERS = "events", "dead_letter"


def with_route(parsed: DataFrame) -> DataFrame:
    """Adds ``route``: where a parsed row goes."""
    return parsed.withColumn("route", F.when(F.col("ok"), EVENTS).otherwise(DEAD_LETTERS))


def write_routed(parsed: DataFrame, path: str, mode: str = "append") -> None:
    """Parsed rows to ``path/route=events``, the rest with their reason to ``path/route=dead_letter``.

    One write partitioned by route: the data is read and parsed once, not once per sink.
    """
    with_route(parsed).write.mode(mode).partitionBy("route").parquet(path)


def json_text(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns))


def logfmt_value(value: Column) -> Column:
    """Quoted where blank, empty, ``=`` or a quote would break it."""
    escaped = F.regexp_replace(F.regexp_replace(value, r'([\\"])', r"\\$1"), "\n", r"\\n")
    return F.when(value.rlike(r'[\s="\\]') | (value == ""), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(value)


def logfmt_text(columns: Sequence[str]) -> Column:
    """``key=value`` pairs of the non-null columns, in order."""
    pairs = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), logfmt_value(F.col(c).cast("string"))))
             for c in columns]
    return F.concat_ws(" ", *pairs)


def encode_events(rows: DataFrame, columns: Sequence[str], encoding: str = "json") -> DataFrame:
    """Adds ``encoded``: the named columns as JSON or logfmt text."""
    encoders = {"json": json_text, "logfmt": logfmt_text}
    return rows.withColumn("encoded", encoders[encoding](columns))
