"""Shards along a Hilbert curve over several metadata dimensions.

Every dimension is quantised to ``2**bits`` cells; the cell's index on the curve orders the rows, so that a run
of rows spans few values of every dimension and readers can skip files by any of them. The order is exact: one
range shuffle of narrow rows, whose bounds Spark samples over the whole key, ids included, so that a cell
with a third of all rows is cut as well. Positions are offsets of the partitions plus places in them. Runs
of equal length become shards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineforge.session import materialize

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of each row of cell coordinates (rows, dimensions)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    # undo the rotations, from the coarsest bit down
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            swap = np.where(x[i] & bit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(x[i] & bit, low, swap)
            if i:
                x[i] ^= swap
        bit >>= 1
    # Gray code
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[dims - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> b) & 1
    return index


def curve(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The curve index of a row from its cell in each dimension."""

    @F.pandas_udf("long")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return index(*cells)


def hashed_cell(value: Column, bits: int = BITS) -> Column:
    """A cell for values without order; equal values share one, null has the first."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value), F.lit(1 << bits))).cast("int")


def size_cell(size: Column, bits: int = BITS) -> Column:
    """A cell per doubling of a size."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))), F.lit((1 << bits) - 1)).cast("int")


def ranked(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """Adds ``rank`` from 0 in the order of ``keys``, and the number of rows. Equal rows follow each other."""
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # written, so that places and counts are of one and the same order
    placed = materialize(ordered.withColumn("__place", F.monotonically_increasing_id()), "hilbert")
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row per shuffle partition
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")
    offsets = materialize(sizes.withColumn("__before", before), "hilbert-offsets")
    total = offsets.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    joined = placed.join(F.broadcast(offsets), F.shiftright("__place", 33) == F.col("__part"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn("rank", F.col("__before") + inside).drop("__place", "__part", "__n", "__before"), total


def shards(docs: DataFrame, count: int = 8, bits: int = BITS) -> DataFrame:
    """Puts the rows of ``docs(doc_id, text, lang, source, ...)`` into ``count`` runs along the curve.

    Dimensions: language, source and the size class of the text. Returns ``doc_id``, ``size`` (UTF-8 bytes plus 1),
    ``text_crc32``, ``curve_index``, ``shard`` and ``slot`` (from 0, gapless). Row counts of shards are at most one apart.
    In a cell, equal texts stand together, then ids ascend. A null text has no bytes and the checksum of an
    empty one; null languages and sources have the first cell. Repeated rows take slots of their own. Other columns are
    not read. No rows: no rows; fewer rows than shards: some shards are empty.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    cells = [hashed_cell(F.col("lang"), bits), hashed_cell(F.col("source"), bits), size_cell(F.col("size"), bits)]
    keyed = narrow.withColumn("curve_index", curve(cells, bits)).drop("lang", "source")
    rows, total = ranked(keyed, ["curve_index", "text_crc32", "doc_id", "size"])
    rows = rows.withColumn("shard", F.expr(f"cast(rank * {count} div {max(total, 1)} as int)"))
    # the first rank of a shard is shard * total / count, rounded up
    first = F.expr(f"(cast(shard as long) * {total} + {count - 1}) div {count}")
    return rows.withColumn("slot", F.col("rank") - first).drop("rank")


def shard_ranges(docs: DataFrame, placed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per shard: rows, and the least and greatest value of each column; what a reader prunes files by."""
    rows = docs.join(placed.select("doc_id", "shard"), "doc_id")
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), *[
        f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])
