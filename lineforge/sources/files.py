"""Scans of text and JSON files."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.functions import text as tx
from lineforge.session import materialize
from lineforge.sources import arrays


def _numbered_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and a position that orders them within it, from a split scan."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("row")).alias("position"))


def scan_lines(spark: SparkSession, path: str, mode: str = "lines") -> DataFrame:
    """Text files as log lines: ``lines`` (blank ones dropped), ``first`` (first non-blank line per
    file), or ``whole`` (each file one stripped message; one file is then one row of one task).
    """
    if mode == "whole":
        return spark.read.text(path, wholetext=True).select(tx.strip(F.col("value")).alias("raw")).filter("raw != ''")
    if mode == "lines":
        return spark.read.text(path).filter(tx.strip(F.col("value")) != "").withColumnRenamed("value", "raw")
    if mode != "first":
        raise ValueError(f"unknown mode {mode!r}")
    kept = _numbered_text(spark, path).filter(tx.strip(F.col("value")) != "")
    return kept.groupBy("file").agg(F.min_by("value", "position").alias("raw"))


def _array_texts(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """``text`` and ``fault`` of the events of array files, and of the other files by shape."""
    records = arrays.records(spark, path)
    begins = materialize(arrays.blocks(records), "array-files")
    inner = arrays.elements(records, begins).select("text", F.when(F.col("outside"), "outside the array").alias("fault"))
    open_files = begins.filter("is_array AND NOT ends").select("file").distinct()
    texts = inner.unionByName(open_files.select(F.lit("").alias("text"), F.lit("array does not end").alias("fault")))
    # the driver holds the paths of the files that it listed
    listed = spark.createDataFrame([(p,) for p in spark.read.text(path).inputFiles()], "path string")
    others = listed.withColumn("file", arrays.file_number(F.col("path"))).join(
        begins.filter("is_array").select("file").distinct(), "file", "left_anti")
    paths = [unquote(r["path"]) for r in others.select("path").collect()]
    if not paths:
        return texts
    if shape == "auto":
        rest = _lines(spark, paths).select("text", F.lit(None).cast("string").alias("fault"))
    else:
        rest = spark.read.text(paths, wholetext=True).select(
            tx.strip(F.col("value")).alias("text"), F.lit("not an array").alias("fault")).filter("text != ''")
    return texts.unionByName(rest)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(tx.strip(F.col("value")).alias("text")).filter("text != ''")


def scan_events(spark: SparkSession, path: str, shape: str = "ndjson", mode: str = "permissive") -> DataFrame:
    """JSON events as ``event`` (variant), ``ok``, ``reason`` and the text they came from.

    ``ndjson`` takes an event per line, ``array`` each file as one JSON array, ``auto`` what a file's first character
    says. Files are split either way; see ``sources.arrays`` for how an array is. Bad lines and elements stay as
    rejects, also text outside the array, and an array that does not end adds one; or ``mode="failfast"`` raises. Line numbers are not
    kept, since files are split.
    """
    if shape == "ndjson":
        texts = _lines(spark, path).withColumn("fault", F.lit(None).cast("string"))
    elif shape in ("array", "auto"):
        texts = _array_texts(spark, path, shape)
    else:
        raise ValueError(f"unknown shape {shape!r}")
    if mode == "failfast":
        event = F.when(F.col("fault").isNotNull(), F.raise_error("fault")).otherwise(F.parse_json("text"))
    else:
        event = F.when(F.col("fault").isNull(), F.try_parse_json("text"))
    parsed = texts.withColumn("event", event)
    ok = F.col("event").isNotNull()
    return parsed.select("text", "event", ok.alias("ok"), F.when(~ok, F.coalesce("fault", F.lit("not valid JSON"))).alias("reason"))


def detect_input_shape(spark: SparkSession, path: str) -> DataFrame:
    """Per file: ``batch`` if its text starts with ``[`` or more than three lines start with ``{``.

    Counts lines from a split scan, so no file is read whole by one task.
    """
    lines = _numbered_text(spark, path).withColumn("head", F.substring(tx.strip(F.col("value")), 1, 1))
    filled = lines.filter("head != ''").groupBy("file").agg(
        F.min_by("head", "position").alias("first"), F.count_if(F.col("head") == "{").alias("objects"))
    shape = F.when((F.col("first") == "[") | (F.col("objects") > 3), "batch").otherwise("single")
    return filled.select("file", "objects", shape.alias("shape"))
