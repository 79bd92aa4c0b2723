"""Importance resampling towards a target text: hashed word n-grams, weighted by how much likelier the target makes them.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes modulo the number of buckets. The
distinct features of a block of texts are grouped by length into matrices of bytes, one row a feature. The checksums of
all rows of a matrix are updated column by column, a table look-up each, and the buckets are scattered back to the
features' places. Bucket counts are added up inside each task before they are shuffled, so at most ``buckets`` rows
leave a task. A document's weight is the sum of its features' gains; with noise from its id added, the largest scores
are a draw without replacement in proportion to the importance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineforge.llm.tokens import LOWER, column_bytes
from lineforge.session import materialize

BLOCK = 4 << 20  # bytes of text whose features are looked at together
CELLS = 1 << 22  # bytes of one matrix
RANGES = 2048  # score ranges that are ranked on their own

# Fixed value: bytes of a word are ASCII letters and digits and all bytes beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x41:0x5B] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)  # the reflected polynomial
    return table


CRC_TABLE = _crc_table()


@dataclass(frozen=True)
class Settings:
    shortest: int = 1  # words of a feature, from
    longest: int = 1  # to
    buckets: int = 10_000
    least_words: int = 20  # of a document that can be drawn
    percent: int = 10  # of those that are drawn
    seed: int = 2024


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes, one column of all rows at a time."""
    crc = np.full(len(matrix), 0xFFFFFFFF, dtype=np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = CRC_TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crc32_strings(strings: pa.Array) -> np.ndarray:
    """CRC-32 of every byte string of an Arrow array, by matrices of equal length."""
    data, offsets = column_bytes(strings)
    starts, lengths = offsets[:-1], np.diff(offsets)
    out = np.zeros(len(lengths), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for rows in np.split(order, cuts):
        width = int(lengths[rows[0]]) if len(rows) else 0
        for part in np.array_split(rows, max(1, len(rows) * width // CELLS)):
            out[part] = crc32_rows(data[starts[part][:, None] + np.arange(width)])
    return out


def _blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``BLOCK`` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, first = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > BLOCK:
            yield first, i
            total, first = 0, i
        total += int(size)
    if first < len(sizes):
        yield first, len(sizes)


def features(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature of some texts, and the number of words of each text."""
    data, offsets = column_bytes(column)
    data = LOWER[data]
    solid = IN_WORD[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # a word ends where its text does
    first[cuts], last[cuts - 1] = solid[cuts], solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    ends = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=ends[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])])
    rows, buckets = [], []
    for size in range(settings.shortest, settings.longest + 1):
        count = max(0, len(words) - size + 1)
        inside = row[:count] == row[len(row) - count:]
        runs = words.slice(0, count)
        if size > 1:
            parts = [words.slice(i, count) for i in range(size)]
            runs = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        distinct = runs.dictionary_encode()
        bucket = crc32_strings(distinct.dictionary) % np.uint32(settings.buckets)
        places = distinct.indices.to_numpy(zero_copy_only=False)[inside]
        rows.append(row[:count][inside])
        buckets.append(bucket[places].astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets), np.bincount(row, minlength=len(column))


def bucket_counts(texts: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Features of a whole table of ``text`` per bucket; the result has ``settings.buckets`` numbers, whatever the table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.buckets, dtype=np.int64)
        for batch in batches:
            for lo, hi in _blocks(batch.column(0)):
                total += np.bincount(features(batch.column(0).slice(lo, hi - lo), settings)[1], minlength=settings.buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(settings.buckets, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the source, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (source.sum() + len(s)) / ((s + 1) * float(target.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every row of ``docs(doc_id, text)``."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _blocks(batch.column(1)):
                row, bucket, words = features(batch.column(1).slice(lo, hi - lo), settings)
                count = np.bincount(row, minlength=hi - lo)
                sums = np.zeros(len(row) + 1, dtype=np.int64)
                order = np.argsort(row, kind="stable")
                np.cumsum(gain[bucket[order]], out=sums[1:])
                upto = np.cumsum(count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array(count.astype(np.int64)),
                     pa.array(sums[upto] - sums[upto - count])], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its importance towards ``target(text)``, and the rank of the drawn ones.

    Columns: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank`` (from 1 by score descending, then
    doc_id ascending; null if not drawn). Of the rows with ``least_words`` words, ``percent`` of a hundred are drawn,
    rounded down. Null and empty texts have no features, weight 0 and are never drawn unless ``least_words`` is 0. A null id
    takes part in the noise as an empty text and ranks before the others of its score. Repeated rows count as often
    as they occur, and each has a rank of its own. Other columns are not read. No documents: no rows; an empty
    target: all its buckets are as likely.

    The rank is exact without a single sorted partition: the draw's share of a quantile sketch cuts the scores into
    ranges, those above the last drawn one are counted, and rows are numbered inside their range only.
    """
    gain = gains(bucket_counts(docs, settings), bucket_counts(target, settings))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = materialize(weighted(docs, gain, settings).withColumn("score", F.col("weight") + gumbel), "importance")
    able = F.col("n_words") >= settings.least_words
    shares = [i / RANGES for i in range(1, RANGES)]
    seen = scored.where(able).agg(F.count("*").alias("n"), F.percentile_approx("score", shares, 20 * RANGES).alias("cuts")).first()
    drawn = seen["n"] * settings.percent // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not drawn:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(seen["cuts"]), reverse=True)])
    # ranges from the best scores down; a score that equals a cut belongs to the range above it
    within = scored.where(able).withColumn("__range", F.size(F.filter(cuts, lambda c: c > F.col("score"))))
    sizes = {r["__range"]: r["count"] for r in within.groupBy("__range").count().collect()}  # at most RANGES rows
    before, offsets = 0, []
    for part in range(RANGES):
        offsets.append(before)
        before += sizes.get(part, 0)
    last = max(part for part, offset in enumerate(offsets) if offset < drawn)
    inside = Window.partitionBy("__range").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "n_words")
    rank = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("__range") + 1) + F.row_number().over(inside)
    ranked = within.where(F.col("__range") <= last).withColumn("__rank", rank).select(
        *columns, F.when(F.col("__rank") <= drawn, F.col("__rank")).alias("rank"))
    rest = within.where(F.col("__range") > last).unionByName(
        scored.where(~able | able.isNull()).withColumn("__range", F.lit(None).cast("int")))
    return ranked.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
