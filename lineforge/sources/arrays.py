"""JSON arrays cut into their elements in parallel, however large one file is.

Files are read as records between commas, which Spark splits into blocks at any comma. A first scan sums each block up:
whether its quotes leave a string open, and how far its brackets go up or down, for both cases of how it may begin. A running
sum over the blocks of a file (a few numbers each) tells how every block really begins. The second scan then cuts each block
on its own, at the commas one bracket deep and outside strings. Only the pieces at the edges of blocks, two a block at
most, are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineforge.session import materialize

QUOTE, BACKSLASH, COMMA, OPEN, CLOSE = (ord(c) for c in '"\\,[]')
DEPTH = np.zeros(256, dtype=np.int8)
DEPTH[[ord("["), ord("{")]] = 1
DEPTH[[ord("]"), ord("}")]] = -1
SPACES = b" \t\r\n"
PIECES = "file long, block long, text string, head boolean, tail boolean, outside boolean"


def file_number(path: Column) -> Column:
    """A file's number, whichever way its local path is spelled."""
    return F.xxhash64(F.regexp_replace(path, r"\Afile:/+", "file:/"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The text between commas, in order within a block; files go by a number."""
    return spark.read.option("lineSep", ",").text(path).select(
        "value", file_number(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Runs of rows of one block: its file and start, first and last row."""
    file = batch.column("file").to_numpy(zero_copy_only=False)
    block = batch.column("block").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(file)]):
        if hi > lo:
            yield (int(file[lo]), int(block[lo])), lo, hi


def _bytes(values: pa.Array, first_of_file: bool) -> np.ndarray:
    """The records with the comma before each; a file's first one has none."""
    nothing, comma = pa.scalar("", pa.large_string()), pa.scalar(",", pa.large_string())
    joined = pc.binary_join_element_wise(nothing, values.cast(pa.large_string()), comma)
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset:joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] + first_of_file:offsets[-1]]


def _quoted(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are quotes that begin or end a string, and how many came up to each byte."""
    place = np.arange(len(data))
    other = np.maximum.accumulate(np.where(data != BACKSLASH, place, -1))
    before = np.concatenate([[-1], other[:-1]])
    quote = (data == QUOTE) & ((place - 1 - before) % 2 == 0)  # an even number of backslashes before it
    return quote, np.cumsum(quote)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: parity of quotes, change of depth if it begins outside or inside a string, first byte that is no space."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for key, lo, hi in _runs(batch):
            data = _bytes(batch.column("value").slice(lo, hi - lo), key[1] == 0 and key not in found)
            quote, count = _quoted(data)
            plain = (count - quote) % 2 == 0
            steps = DEPTH[data] * ~quote
            total = found.setdefault(key, [0, 0, 0, None])
            outside, inside = int(steps[plain].sum()), int(steps[~plain].sum())
            if total[0]:
                outside, inside = inside, outside
            total[1] += outside
            total[2] += inside
            total[0] ^= int(count[-1]) & 1 if len(count) else 0
            if total[3] is None:
                solid = data[~np.isin(data, np.frombuffer(SPACES, dtype=np.uint8))]
                total[3] = chr(solid[0]) if len(solid) else None
    rows = [[*key, *total] for key, total in found.items()]
    names = ["file", "block", "parity", "outside", "inside", "first"]
    types = [pa.int64()] * 5 + [pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def blocks(records: DataFrame) -> DataFrame:
    """How each block begins: ``file``, ``block``, ``in_string`` (0 or 1), ``depth``; and of its file ``is_array``, ``ends``.

    ``ends``: all strings and brackets are closed. The summaries are written, as many as the scan has splits.
    """
    summary = materialize(records.mapInArrow(
        _summarise, "file long, block long, parity long, outside long, inside long, first string"), "array-blocks")
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    began = summary.withColumn("in_string", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))
    deep = began.withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
    first = F.first("first", ignorenulls=True).over(everything)
    closed = (F.sum("parity").over(everything) % 2 == 0) & (F.sum("change").over(everything) == 0)
    return deep.withColumns({"is_array": F.coalesce(first == "[", F.lit(False)), "ends": closed}).select(
        "file", "block", "in_string", "depth", "is_array", "ends")


class _Cutter:
    """Cuts the bytes of one block into pieces, batch by batch."""

    def __init__(self, key: tuple[int, int], in_string: int, depth: int) -> None:
        self.key, self.in_string, self.depth, self.parts = key, in_string, depth, []
        self.head, self.outside = True, depth <= 0

    def add(self, data: np.ndarray) -> list[tuple[bytes, bool, bool, bool]]:
        """Pieces that end here: text, whether it began before the block, false, whether it lies outside the array."""
        quote, count = _quoted(data)
        plain = ((count - quote + self.in_string) % 2 == 0) & ~quote
        depth = self.depth + np.cumsum(DEPTH[data] * plain, dtype=np.int64)
        cut = plain & (((data == COMMA) & (depth == 1)) | ((data == OPEN) & (depth == 1)) | ((data == CLOSE) & (depth == 0)))
        self.in_string = (self.in_string + int(count[-1])) % 2 if len(count) else self.in_string
        self.depth = int(depth[-1]) if len(depth) else self.depth
        whole, out, start = data.tobytes(), [], 0
        for end in np.flatnonzero(cut).tolist():
            out.append((b"".join([*self.parts, whole[start:end]]), self.head, False, self.outside))
            self.parts, start, self.head, self.outside = [], end + 1, False, data[end] == CLOSE
        self.parts.append(whole[start:])
        return out

    def last(self) -> tuple[bytes, bool, bool, bool]:
        return b"".join(self.parts), self.head, True, bool(self.outside)


def _cut(edges: bool):
    """Whole elements of blocks, or the pieces at their edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter: _Cutter | None = None

        def rows(pieces: list[tuple[bytes, bool, bool, bool]]) -> pa.RecordBatch:
            kept = [piece for piece in pieces if (piece[1] or piece[2]) == edges]
            text, *flags = zip(*kept) if kept else ((), (), (), ())
            text = [t.decode() if edges else t.strip(SPACES).decode() for t in text]
            return pa.RecordBatch.from_arrays(
                [pa.array([cutter.key[i]] * len(kept), pa.int64()) for i in (0, 1)]
                + [pa.array(text, pa.string())] + [pa.array(list(map(bool, f)), pa.bool_()) for f in flags],
                ["file", "block", "text", "head", "tail", "outside"])

        for batch in batches:
            for key, lo, hi in _runs(batch):
                new = cutter is None or cutter.key != key
                if new:
                    if cutter is not None:
                        yield rows([cutter.last()])
                    cutter = _Cutter(key, batch.column("in_string")[lo].as_py(), batch.column("depth")[lo].as_py())
                yield rows(cutter.add(_bytes(batch.column("value").slice(lo, hi - lo), new and key[1] == 0)))
        if cutter is not None:
            yield rows([cutter.last()])

    return run


def elements(records: DataFrame, begins: DataFrame) -> DataFrame:
    """``text`` of every element of the array files among the records, and whether it lies ``outside`` the array.

    Blank texts are no elements.
    """
    # as many rows as the scan has splits, which the driver holds anyway
    known = F.broadcast(begins.filter("is_array").select("file", "block", "in_string", "depth"))
    placed = records.join(known, ["file", "block"])
    inner = placed.mapInArrow(_cut(False), PIECES).select("text", "outside")
    edges = placed.mapInArrow(_cut(True), PIECES)
    # a piece that did not begin before its block begins an element; the later blocks' first pieces go on with it
    order = Window.partitionBy("file").orderBy("block", "tail")
    numbered = edges.withColumn("element", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "tail", "text", "outside")))
    joined = numbered.groupBy("file", "element").agg(parts.alias("parts")).select(
        F.array_join("parts.text", "").alias("text"), F.col("parts")[0]["outside"].alias("outside"))
    trimmed = F.regexp_replace("text", r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")
    return inner.unionByName(joined).withColumn("text", trimmed).filter("text != ''")
