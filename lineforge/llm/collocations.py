"""Phrase collocations by SETM: sorted occurrence relations, merge-joined, counted and semi-joined length by length.

The occurrence relation holds a row per word: piece, position in the piece, word. It is written once, sorted by piece and
position, in units of some megabytes of text of one language that never cut a piece; within a unit its columns are packed arrays
and words are numbers into the unit's dictionary. For each further length

1. the relation is semi-joined with the frequent groups of the length before, and written again (it shrinks),
2. it is merge-joined with itself by piece and adjacent position, which extends each remaining occurrence by a word,
3. the groups are counted in the unit, then over all units by a shuffle, and the frequent ones kept.

A frequent group is part of frequent groups only, so nothing frequent is lost. Frequent groups are sent to all tasks if their
measured size is below ``broadcast_bytes``; beyond it each unit gets those that it holds by joins. Words are compared by
64-bit codes of language and word; the codes of frequent words are checked to be unique, else other codes are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineforge.llm.tokens import BASE, LOWER, column_bytes, mix
from lineforge.session import delete_table, materialize

# What separates pieces, and what separates words inside a piece.
ENDS_PIECE = np.zeros(256, dtype=bool)
ENDS_PIECE[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
ENDS_WORD = ENDS_PIECE.copy()
ENDS_WORD[[ord(" "), ord("\t")]] = True

UNKNOWN = "und"  # the language of rows without one
# Packed columns compress by their many zero bytes, and a file's row group ends after some large rows.
PACKED = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1,
          "parquet.page.size.row.check.min": 1}
SALTS = 64  # parts of a language that are ranked on their own first

RELATION = "unit long, lang string, code array<long>, piece binary, pos binary, word binary, start binary"


@dataclass(frozen=True)
class Settings:
    longest: int = 3  # words of a phrase
    least: int = 10  # occurrences of a phrase
    covered_percent: int = 50  # a phrase goes if a longer one around it has this share of its occurrences
    top: int = 2000  # phrases per language
    unit_bytes: int = 2 << 20  # of text
    broadcast_bytes: int = 16 << 20


def occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Piece and position of every word of some texts, in order, and the lower-cased words."""
    data = LOWER[data]
    solid = ~ENDS_WORD[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]  # a piece ends where its text does
    first[cuts], last[cuts - 1] = solid[cuts], solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    breaks = np.flatnonzero(ENDS_PIECE[data])
    piece = np.searchsorted(breaks, start) + np.searchsorted(offsets, start, side="right")
    new = np.ones(len(start), dtype=bool)
    new[1:] = piece[1:] != piece[:-1]
    heads = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    ends = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=ends[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])])
    return number.astype(np.int32), (np.arange(len(start)) - heads[number]).astype(np.int32), words


def _list(values: np.ndarray | pa.Array) -> pa.Array:
    """An array as a column of one row."""
    return pa.ListArray.from_arrays([0, len(values)], values if isinstance(values, pa.Array) else pa.array(values))


def _packed(*columns: np.ndarray) -> list[pa.Array]:
    """Numbers as bytes, a column of one row each."""
    return [pa.array([c.astype(np.int32).tobytes()], pa.binary()) for c in columns]


def _unpacked(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.int32)


def relation(docs: DataFrame, unit_bytes: int = Settings.unit_bytes) -> DataFrame:
    """The occurrence relation of ``docs(text, lang)`` in units: ``unit``, ``lang``, the dictionary ``words`` with
    occurrences ``n``, and as 32-bit numbers ``piece`` (steps from row to row), ``pos`` and ``word`` (into the dictionary).
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        unit = (context.partitionId() if context else 0) << 32
        held: dict[str, tuple[list[pa.Array], int]] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal unit
            data, offsets = column_bytes(pa.concat_arrays(held.pop(lang)[0]))
            piece, pos, words = occurrences(data, offsets)
            if len(words):
                coded = words.dictionary_encode()
                at = coded.indices.to_numpy(zero_copy_only=False)
                count = np.bincount(at, minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit]), pa.array([lang]), _list(coded.dictionary.cast(pa.string())), _list(count),
                     *_packed(np.diff(piece, prepend=0), pos, at)],
                    ["unit", "lang", "words", "n", "piece", "pos", "word"])
                unit += 1

        for batch in batches:
            langs = batch.column(1)
            for lang in langs.unique().to_pylist():
                texts = batch.column(0).filter(pc.equal(langs, lang)).cast(pa.large_string())
                parts, size = held.get(lang, ([], 0))
                held[lang] = (parts + [texts], size + texts.nbytes)
                if held[lang][1] >= unit_bytes:
                    yield from flush(lang)
        for lang in list(held):
            yield from flush(lang)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    return docs.where("text is not null").select("text", lang.alias("lang")).mapInArrow(
        cut, "unit long, lang string, words array<string>, n array<long>, piece binary, pos binary, word binary")


def code_of(lang: Column, word: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), lang, word)


class Unit:
    """A row of the relation: sorted by piece and position, with the starts of the groups that are still frequent."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        self.unit, self.lang = batch.column("unit")[i].as_py(), batch.column("lang")[i].as_py()
        self.code = batch.column("code")[i].values.to_numpy(zero_copy_only=False)
        self.step, self.pos, self.word = (_unpacked(batch.column(name)[i]) for name in ("piece", "pos", "word"))
        self.piece = np.cumsum(self.step, dtype=np.int64)
        start = batch.column("start")[i]
        self.start = np.unpackbits(np.frombuffer(start.as_buffer(), dtype=np.uint8), count=len(self.word)).astype(bool) \
            if start.is_valid else np.ones(len(self.word), dtype=bool)

    def groups(self, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Starts of the occurrences of all groups of ``size`` words, and the words (codes) of each."""
        place = self.piece << 32 | self.pos
        begins = np.flatnonzero(self.start)
        if size > 1:  # the merge-join by piece and adjacent position: the group one word on has to be frequent too
            after = np.minimum(np.searchsorted(place, place[begins] + 1), len(place) - 1)
            begins = begins[(place[after] == place[begins] + 1) & self.start[after]]
        return begins, [self.code[self.word[begins + i]] for i in range(size)]

    def counted(self, size: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Distinct groups, as columns of codes, and their occurrences."""
        begins, _ = self.groups(size)
        label = self.word[begins].astype(np.int64)
        for i in range(1, size):
            if i > 1:
                _, label = np.unique(label, return_inverse=True)
            label = label.astype(np.int64) << 32 | self.word[begins + i]
        _, first, count = np.unique(label, return_index=True, return_counts=True)
        return [self.code[self.word[begins[first] + i]] for i in range(size)], count

    def kept(self, size: int, frequent: np.ndarray) -> pa.RecordBatch | None:
        """The rows that lie in an occurrence of a frequent group of ``size`` words; its starts are marked."""
        begins, codes = self.groups(size)
        keys = group_key(codes)
        at = np.minimum(np.searchsorted(frequent, keys), max(0, len(frequent) - 1))
        begins = begins[frequent[at] == keys] if len(frequent) else begins[:0]
        if not len(begins):
            return None
        start, inside = np.zeros(len(self.word), dtype=bool), np.zeros(len(self.word), dtype=bool)
        start[begins] = True
        for i in range(size):
            inside[begins + i] = True
        word = self.word[inside]
        used = np.bincount(word, minlength=len(self.code)) > 0  # the dictionary shrinks as well
        number = np.cumsum(used) - 1
        return pa.RecordBatch.from_arrays(
            [pa.array([self.unit]), pa.array([self.lang]), _list(self.code[used]),
             *_packed(np.diff(self.piece[inside], prepend=0), self.pos[inside], number[word]),
             pa.array([np.packbits(start[inside]).tobytes()], pa.binary())],
            ["unit", "lang", "code", "piece", "pos", "word", "start"])


def group_key(codes: list[np.ndarray]) -> np.ndarray:
    """One number per group. Groups that share one by chance stay in the relation, which costs work and changes no count."""
    key = codes[0].view(np.uint64)
    for code in codes[1:]:
        key = mix(key * np.uint64(BASE) + code.view(np.uint64))
    return key


def _code_columns(size: int) -> list[str]:
    return [f"c{i}" for i in range(1, size + 1)]


def group_counts(rel: DataFrame, size: int) -> DataFrame:
    """``unit``, the codes ``c1``... and occurrences ``n`` of every group of ``size`` words in every unit."""
    names = ["unit", *_code_columns(size), "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                unit = Unit(batch, i)
                codes, n = unit.counted(size)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(n), unit.unit), *codes, n)], names)

    return rel.mapInArrow(count, ", ".join(f"{name} long" for name in names))


def semi_join(rel: DataFrame, frequent: DataFrame, size: int, broadcast_bytes: int = Settings.broadcast_bytes) -> DataFrame:
    """The relation without rows outside all occurrences of the ``frequent`` groups (codes ``c1``...) of ``size`` words."""
    names = _code_columns(size)
    frequent = frequent.select(*names)
    if frequent.count() * 8 * size <= broadcast_bytes:
        table = frequent.toArrow()
        keys = np.sort(group_key([table[c].to_numpy().astype(np.int64) for c in names]))
        shared = rel.sparkSession.sparkContext.broadcast(keys)

        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    if (out := Unit(batch, i).kept(size, shared.value)) is not None:
                        yield out

        return rel.mapInArrow(by_broadcast, RELATION)
    # beyond that: the groups that a unit holds, as many as it has rows at most, come to it by its number
    held = group_counts(rel, size).join(frequent, names, "left_semi")
    own = held.groupBy(F.col("unit").alias("__unit")).agg(F.collect_list(F.struct(*names)).alias("groups"))

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                groups = batch.column("groups")[i].values
                keys = np.sort(group_key([groups.field(c).to_numpy(zero_copy_only=False) for c in names]))
                if (out := Unit(batch, i).kept(size, keys)) is not None:
                    yield out

    return rel.join(own, F.col("unit") == F.col("__unit")).drop("__unit").mapInArrow(by_unit, RELATION)


def mine(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of ``docs(text, lang)``, frequent words, and all words of each language.

    The phrases are ``codes array<long>, a``, single words included; the words ``code, lang, word``; the totals ``lang, n``.
    """
    spark = docs.sparkSession
    raw = materialize(relation(docs, settings.unit_bytes), "setm-relation", **PACKED)
    counted = materialize(raw.select("lang", F.explode(F.arrays_zip("words", "n")).alias("w")).groupBy(
        "lang", F.col("w.words").alias("word")).agg(F.sum("w.n").alias("a")), "setm-words")
    totals = materialize(counted.groupBy("lang").agg(F.sum("a").alias("n")), "setm-totals")
    seed, clashes = 0, True
    while clashes:
        seed += 1
        coded = counted.withColumn("code", code_of(F.col("lang"), F.col("word"), seed))
        clashes = not coded.groupBy("code").agg(F.count("*").alias("n"), F.max("a").alias("a")).where(
            (F.col("n") > 1) & (F.col("a") >= settings.least)).isEmpty()
    words = materialize(coded.where(F.col("a") >= settings.least), "setm-frequent")
    delete_table(counted)
    found = [words.select(F.col("code").alias("c1"), "a")]
    rel = raw.select(
        "unit", "lang", F.transform("words", lambda w: code_of(F.col("lang"), w, seed)).alias("code"), "piece", "pos", "word",
        F.lit(None).cast("binary").alias("start"))  # null: every row starts a group of one word
    held = raw
    for size in range(2, settings.longest + 1):
        joined = semi_join(rel, found[-1], size - 1, settings.broadcast_bytes)
        with large_rows(spark):
            rel = materialize(joined, "setm-relation", **PACKED)
            counts = group_counts(rel, size).groupBy(*_code_columns(size)).agg(F.sum("n").alias("a"))
            found.append(materialize(counts.where(F.col("a") >= settings.least), "setm-groups"))
        delete_table(held)
        held = rel
    delete_table(held)
    tables = [t.select(F.array(*_code_columns(i + 1)).alias("codes"), "a") for i, t in enumerate(found)]
    return reduce(DataFrame.unionByName, tables), words.select("code", "lang", "word"), totals


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """Units are large rows: readers and Python workers hold one each."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _lowest_cut(phrases: DataFrame) -> DataFrame:
    """Per phrase of two words and more the cut of the lowest score: ``codes``, ``a``, ``l``, ``r``, ``score``."""
    part = phrases.select(F.col("codes").alias("part"), F.col("a").alias("of_part"))
    cut = phrases.where("size(codes) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)))
    cut = cut.withColumn("left", F.slice("codes", F.lit(1), F.col("k"))).withColumn(
        "right", F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")))
    cut = cut.join(part.withColumnsRenamed({"part": "left", "of_part": "l"}), "left").join(
        part.withColumnsRenamed({"part": "right", "of_part": "r"}), "right")
    # counts below 10^15: the products fit 38 digits
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)"), exact("l") * exact("r"))
    return cut.withColumn("score", score).groupBy("codes", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best")).select("codes", "a", "best.l", "best.r", "best.score")


def _longer(phrases: DataFrame) -> DataFrame:
    """Per phrase inside longer ones the most occurrences of one of these: ``inner``, ``longer``."""
    sized = phrases.where("size(codes) > 2").select(
        "codes", "a", F.explode(F.sequence(F.lit(2), F.size("codes") - 1)).alias("m"))
    inside = F.transform(F.sequence(F.lit(1), F.size("codes") - F.col("m") + 1), lambda i: F.slice("codes", i, F.col("m")))
    return sized.select("a", F.explode(inside).alias("inner")).groupBy("inner").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The best phrases of 2 to ``longest`` words per language of ``docs(text, lang)``.

    Columns ``lang``, ``rank`` (from 1), ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those of the parts at the cut of
    the lowest score, ties to the shortest first part), ``n`` (all words of the language), ``score``
    (``floor(1000000*a*a/(l*r))``, exact). Ranked by score and a descending, then phrase in byte order; the report holds
    ``top`` rows per language. Null texts are empty, a null language is ``und``; empty texts have no words. Repeated rows
    count as often as they occur; other columns are not read. No documents: no rows.
    """
    found, words, totals = mine(docs, settings)
    phrases = materialize(found, "setm-phrases")
    best, inner = _lowest_cut(phrases), _longer(phrases)
    own = best.join(inner, best["codes"] == inner["inner"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * settings.covered_percent)).drop("inner", "longer")
    spelled = own.select("*", F.posexplode("codes").alias("at", "code")).join(words, "code").groupBy(
        "codes", "lang", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("parts"))
    spelled = spelled.withColumn("phrase", F.array_join("parts.word", " ")).withColumn(
        "salt", F.pmod(F.xxhash64("codes"), F.lit(SALTS))).drop("parts", "codes")
    # each part of a language hands on as many rows as the report has
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = spelled.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(
        F.col("rank") <= settings.top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= settings.top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
