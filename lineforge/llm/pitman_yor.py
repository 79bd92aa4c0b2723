"""Hierarchical Pitman-Yor language model: seatings sampled by Gibbs, texts scored by averaged predictions.

A word follows a context: the word before it (0 at the start of a text). Every context is a restaurant whose customers are the
occurrences of words in it. The contexts that end in the same two bytes share a parent, the restaurant of their class, whose customers are
their tables; the classes share one parent, whose customers are the classes' tables, and whose base is uniform over the known
words and one unknown. A context with few customers so draws on what its class has seen, and a class on all of them.

Given the totals of the restaurants the seating of a word touches that word alone, so a sweep is a map over words. It is a
blocked Gibbs step: all customers of a dish leave their tables and are seated anew at once, by a draw from the exact
conditional that sweeps over single customers settle to. Seatings of ``c`` customers at ``t`` tables weigh
``weight**t`` times a generalised Stirling number, and nothing but ``t`` is asked of a seating, so the draw is of ``t``. Totals are
summed between rounds: those of the classes, at most 65,536, on the driver; those of the contexts, as many as there are words, by context.
Words are dealt to buckets by hash; a bucket sends its sums of each context it holds, and gets the context's totals back. Draws are
seeded by word and context, so that results don't depend on partitions.

Texts are packed into units of some megabytes. A unit asks once for each of its distinct words, with the contexts it needs. Requests
are gathered by word once: their counts are the word's customers, and the answers return to the units that ask. Both travel as
arrays, a row for each unit and range of word hashes, or for each unit that a run of words answers: rows of single words took most of
an executor's heap. A seating is drawn again from its seed where it is read a second time, instead of being kept. Counts and
requests grow with the corpus; nothing but class totals passes the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineforge.llm.tables import remainder
from lineforge.llm.tokens import Words, column_bytes, mix, words
from lineforge.session import delete_table, materialize

CONTEXTS = 1 << 16  # classes of contexts
BUCKETS = 16  # of words, or two for each shuffle partition if these are more
END = np.uint64(0x0E4D)  # stands for the end of a text
UNIT_BYTES = 8 << 20
SLICE_ROWS = 256
TABULATED = 2048  # customers of a dish up to which the Stirling numbers are tabulated
NODES = 24  # of a contour integral
DEGREE = 32  # of the polynomial through the integrals of a dish
SERIES = 64  # customers beyond the first of a table, up to which a power series is written out
BLOCK = 1 << 18  # numbers weighed at once
GATHERED = 1 << 14  # requests gathered at once
RANGES = 2048  # of word hashes, or two for each shuffle partition if these are more
ANSWERED = 1 << 16  # answers sorted by unit at once
REQUEST = "unit long, packed binary, range int, words array<long>, widths array<int>, contexts array<long>, counts array<int>"
ANSWER = "unit long, words array<long>, n array<long>, widths array<int>, logs array<float>"
GATHER = "bucket int, word long, contexts array<long>, counts array<int>, units array<long>, widths array<int>, places array<int>"


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    strength: float = 1.0
    rounds: int = 2  # of seating everything with the totals of the round before
    samples: int = 3


# ---- seating -----------------------------------------------------------------------------------

@functools.cache
def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers up to ``TABULATED``; those of ``c`` customers at 1 to ``c`` tables start at ``c * (c - 1) / 2``."""
    rows = [np.zeros(1)]
    for c in range(1, TABULATED):
        joined = rows[-1] + np.log(c - discount * np.arange(1, c + 1))
        rows.append(np.logaddexp(np.append(joined, -np.inf), np.append(-np.inf, rows[-1])))
    return np.concatenate(rows)


def _series(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """Log of the coefficient of ``x**c`` in ``((1 - (1 - x)**d) / d)**t`` for ``c - t`` of at most ``SERIES``, by the recurrence for powers of series."""
    more = customers - tables
    one = np.cumprod([1.0, *((m - discount) / (m + 1) for m in range(1, SERIES + 1))])  # of a single table
    terms = [np.ones(len(more))]
    for k in range(1, int(more.max()) + 1):
        terms.append(sum((i * tables - k + i) * one[i] * terms[k - i] for i in range(1, k + 1)) / k)
    return np.log(np.stack(terms)[more, np.arange(len(more))])


def _contour(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The same log for any larger ``c - t``, by Cauchy's integral with ``x = exp(-z)``.

    The contour is a parabola round the cut along the negative axis. It passes the saddle point, or stays off the cut by some ``1 / c``;
    the steps follow the width of the peak there. The tests hold it against the table to ten digits.
    """
    d, aim = discount, np.log(customers / tables)
    v = np.minimum(aim / (d - 1), -1e-12)  # log of 1 - x at the saddle
    for _ in range(8):  # Newton's steps on a slope between d - 1 and half of that
        near, far = np.expm1(v), np.expm1(d * v)
        off = np.log(d) + (d - 1) * v + np.log(near / far) - aim
        v = np.minimum(v - off / (d - 1 + (1 + near) / near - d * (1 + far) / far), -1e-12)
    across = np.maximum(-np.log(-np.expm1(v)), 4.2 / customers)
    u = -np.expm1(-across)
    mean = d * u ** (d - 1) * (1 - u) / (1 - u ** d)
    curved = tables * mean * ((1 - d) * (1 / u - 1) + 1 - mean)
    step = np.minimum(3.84 / NODES, 1 / (5 * across * np.sqrt(curved)))
    turn = 1 + 1j * (np.arange(NODES) + 0.5)[:, None] * step
    z = across * turn ** 2
    log = tables * np.log((1 - (-np.expm1(-z)) ** d) / d) + customers * z
    top = log[0].real
    return top + np.log((np.exp(log - top) * turn).real.sum(axis=0) * 2 * across * step / np.pi)


def _large(dish: np.ndarray, customers: np.ndarray, tables: np.ndarray, first: np.ndarray, discount: float) -> np.ndarray:
    """The same log for the ranges of large dishes: ``dish`` says whose ``customers`` and ``first`` an entry of ``tables`` goes with.

    The integral is as smooth in the logarithm of ``t`` as its polynomial through Chebyshev's points needs; the last ``SERIES`` are series.
    """
    out = np.zeros(len(tables))
    near = customers[dish] - tables <= SERIES
    if near.any():
        out[near] = _series(customers[dish][near], tables[near], discount)
    if near.all():
        return out
    last = np.zeros(len(customers), dtype=np.int64)
    np.maximum.at(last, dish[~near], tables[~near])
    some = np.flatnonzero(last)
    low, high = np.log(first[some]), np.log(last[some])
    half = np.maximum(high - low, 1e-9) / 2
    angles = np.pi * (np.arange(DEGREE) + 0.5) / DEGREE
    points = np.exp((low + half)[:, None] + half[:, None] * np.cos(angles))
    values = _contour(np.repeat(customers[some], DEGREE).astype(np.float64), points.reshape(-1), discount).reshape(points.shape)
    factors = values @ np.cos(np.outer(angles, np.arange(DEGREE))) * 2 / DEGREE
    row = np.searchsorted(some, dish[~near])
    x = (np.log(tables[~near]) - (low + half)[row]) / half[row]
    one = two = np.zeros(len(x))
    for k in range(DEGREE - 1, 0, -1):  # Clenshaw's sum
        one, two = factors[row, k] + 2 * x * one - two, one
    out[~near] = factors[row, 0] / 2 + x * one - two
    return out


def _likely(count: np.ndarray, weight: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of tables of a large dish: eight deviations and 20 on either side of the mean, beyond which a double adds nothing."""
    low, high = np.full(len(count), -600.0), np.zeros(len(count))
    for _ in range(60):
        middle = (low + high) / 2
        more = np.log(weight) + (discount - 1) * middle + np.log(-np.expm1(middle)) > np.log(count)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    mean = weight * -np.expm1(discount * low) / discount
    wide = 8 * np.sqrt(mean) + 20
    return np.clip(mean - wide, 1, count).astype(np.int64), np.clip(mean + wide, 1, count).astype(np.int64)


def seat(count: np.ndarray, weight: np.ndarray, key: np.ndarray, s: Settings, samples: int) -> np.ndarray:
    """Tables per dish, one row per sample. ``weight``: what a new table weighs against a customer."""
    out = np.ones((samples, len(count)), dtype=np.int64)
    few, many = np.flatnonzero((count > 1) & (count <= TABULATED)), np.flatnonzero(count > TABULATED)
    least, most = _likely(count[many], weight[many], s.discount)
    for dishes, first, last, block in ((few, np.ones(len(few), dtype=np.int64), count[few], BLOCK), (many, least, most, BLOCK // 64)):
        width = last - first + 1
        cuts = np.flatnonzero(np.diff(np.cumsum(width) // block)) + 1
        for at in np.split(np.arange(len(dishes)), cuts) if len(dishes) else ():
            dish, start = dishes[at], np.cumsum(width[at]) - width[at]
            c = np.repeat(count[dish], width[at])
            place = np.arange(len(c)) - np.repeat(start, width[at])
            tables = place + np.repeat(first[at], width[at])
            log = tables * np.repeat(np.log(weight[dish]), width[at])
            if dishes is few:
                log += _stirling(s.discount)[c * (c - 1) // 2 + place]
            else:
                log += _large(np.repeat(np.arange(len(at)), width[at]), count[dish], tables, first[at], s.discount)
                factors = np.cumsum(np.log(tables))  # logs of factorials, but for a constant of the dish
                log -= factors - np.repeat(factors[start], width[at])
            log -= np.repeat(np.maximum.reduceat(log, start), width[at])
            total = np.cumsum(np.exp(log))
            before = np.append(0, total)[start]
            whole = total[start + width[at] - 1] - before
            for i in range(samples):
                chance = ((mix(key[dish] + np.uint64(i + 1)) >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)
                found = np.searchsorted(total, before + chance * whole, side="right") - start
                out[i, dish] = first[at] + np.clip(found, 0, width[at] - 1)
    return out


@dataclass
class Totals:
    """Customers and tables of the classes and of their parent, one row per sample; the parent's are scalars."""

    customers: np.ndarray  # samples, classes
    tables: np.ndarray  # samples, classes
    parent_customers: np.ndarray
    parent_tables: np.ndarray
    known: int  # distinct words
    tokens: int

    def parent_probability(self, s: Settings, customers, tables, sample: int):
        rest = (s.strength + s.discount * self.parent_tables[sample]) / (self.known + 1)
        return (np.maximum(customers - s.discount * tables, 0) + rest) / (s.strength + self.parent_customers[sample])

    def class_probability(self, s: Settings, kind, customers, tables, parent, sample: int):
        rest = (s.strength + s.discount * self.tables[sample, kind]) * parent
        return (np.maximum(customers - s.discount * tables, 0) + rest) / (s.strength + self.customers[sample, kind])


# ---- packing -----------------------------------------------------------------------------------

def _contexts(found: Words) -> np.ndarray:
    """Last two bytes of each word."""
    tail = found.data[found.end - 1].astype(np.uint16)
    double = found.end - found.start > 1
    tail[double] |= found.data[found.end[double] - 2].astype(np.uint16) << 8
    return tail


def _befores(found: Words) -> np.ndarray:
    """Each word as the context of the next: its class in the upper 16 bits, then 48 bits of its hash."""
    return _contexts(found).astype(np.uint64) << np.uint64(48) | found.hash >> np.uint64(16)


def _tokens(batch: pa.RecordBatch, contexts) -> tuple[np.ndarray, ...]:
    """Of the texts of a batch: ids, which of them are known, which are learnt from, words of each; of each word its hash and the context it makes."""
    found = words(*column_bytes(batch.column("text")))
    row = batch.column("row")
    return (row.fill_null(0).to_numpy().astype(np.int64), row.is_valid().to_numpy(zero_copy_only=False),
            batch.column("learn").to_numpy().astype(np.float64), np.diff(found.bounds), found.hash, contexts(found))


def _unit(waiting: list[tuple[np.ndarray, ...]]) -> tuple[bytes, np.ndarray, np.ndarray, list]:
    """A unit's texts as indices of its distinct (word, context) pairs, and its requests by word. Takes what is ``waiting``."""
    learn, n_words, hashes, after = (np.concatenate(x) for x in list(zip(*waiting))[2:])
    waiting.clear()
    texts, total = len(n_words), len(hashes) + len(n_words)
    is_end = np.zeros(total, dtype=bool)
    is_end[np.cumsum(n_words + 1) - 1] = True  # the end of each text goes there
    word = np.full(total, END, dtype=np.uint64)
    word[~is_end] = hashes
    context = np.zeros(total, dtype=after.dtype)
    context[1:][~is_end[:-1]] = after  # of the token after each word; a text always has one
    del hashes, after, is_end
    order = np.lexsort((context, word.view(np.int64)))
    w, c = word[order], context[order]
    del word, context
    first = np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]))
    w, c = w[first], c[first]
    index = np.empty(total, dtype=np.int32)
    index[order] = np.cumsum(first, dtype=np.int32) - 1
    del order, first
    counts = np.bincount(index, weights=np.repeat(learn, n_words + 1), minlength=len(w)).astype(np.int64)
    head = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
    # frequent pairs first: small numbers pack well
    rank = np.empty(len(w), dtype=np.int32)
    by_use = np.argsort(-np.bincount(index), kind="stable")
    rank[by_use] = np.arange(len(w), dtype=np.int32)
    stream = rank[index].view(np.uint8).reshape(-1, 4).T
    packed = zstandard.compress(np.concatenate([
        np.array([texts, total, len(w)], dtype=np.int64).view(np.uint8), (n_words + 1).astype(np.int64).view(np.uint8),
        by_use.astype(np.int32).view(np.uint8), np.ascontiguousarray(stream).reshape(-1)]).tobytes(), 3)
    return packed, w[head].view(np.int64), np.append(head, len(w)), [c.view(np.int64) if c.itemsize == 8 else c.astype(np.int32), counts.astype(np.int32)]


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per text, and for each token which pair of the unit it is."""
    raw = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
    docs, total, pairs = raw[:24].view(np.int64)
    at = 24 + 8 * docs
    lengths = raw[24:at].view(np.int64)
    by_use = raw[at:at + 4 * pairs].view(np.int32)
    stream = raw[at + 4 * pairs:].reshape(4, total)
    return lengths, by_use[np.ascontiguousarray(stream.T).view(np.int32).reshape(-1)]


def _ranged(unit: int, word: np.ndarray, heads: np.ndarray, lists: list, ranges: int) -> pa.RecordBatch:
    """A unit's requests, its ``word`` ascending: a row for each range of hashes that has any."""
    least = [(i << 64) // ranges - (1 << 63) for i in range(ranges)]
    cuts = np.append(np.searchsorted(word, np.array(least, dtype=np.int64)), len(word))
    some = np.flatnonzero(np.diff(cuts)).astype(np.int32)
    cuts = np.append(cuts[some], len(word)).astype(np.int32)
    per_word = pa.array(cuts)
    per_pair = pa.array(np.asarray(heads, dtype=np.int32)[cuts])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(some), unit, dtype=np.int64)), pa.nulls(len(some), pa.binary()), pa.array(some),
         pa.ListArray.from_arrays(per_word, pa.array(word, pa.int64())), pa.ListArray.from_arrays(per_word, pa.array(np.diff(heads), pa.int32())),
         *[pa.ListArray.from_arrays(per_pair, pa.array(x)) for x in lists]],
        names=["unit", "packed", "range", "words", "widths", "contexts", "counts"])


def _packer(ranges: int, contexts=_contexts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: a unit's texts with their ids (no range), and its requests (nothing packed), by what ``contexts`` makes of a word."""
        waiting: list[tuple[np.ndarray, ...]] = []  # words only: texts would be some times as large
        size, number = 0, TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            ids, known = (np.concatenate(x) for x in list(zip(*waiting))[:2])
            packed, word, heads, lists = _unit(waiting)
            whole = zstandard.compress(ids.tobytes() + known.astype(np.uint8).tobytes(), 3)
            whole = len(whole).to_bytes(8, "little") + whole + packed
            asked = _ranged(number, word, heads, lists, ranges)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([whole], pa.binary()), *[pa.nulls(1, f.type) for f in asked.schema][2:]],
                names=asked.schema.names)
            for at in range(0, asked.num_rows, SLICE_ROWS):
                yield asked.slice(at, SLICE_ROWS)

        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            waiting.append(_tokens(batch, contexts))
            size += batch.nbytes
            if size >= UNIT_BYTES:
                yield from flush()
                size, number = 0, number + 1
        if waiting:
            yield from flush()

    return run


# ---- passes over words -------------------------------------------------------------------------

def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _lists(values: np.ndarray, width: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)).astype(np.int32)), pa.array(values))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums along the last axis of the runs between ``cuts``, which may be empty."""
    total = np.concatenate([np.zeros((*values.shape[:-1], 1), dtype=np.int64), np.cumsum(values, axis=-1)], axis=-1)
    return total[..., cuts[1:]] - total[..., cuts[:-1]]


def _gathered(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row a word: its customers by context, and who asks (units, with how many contexts and which)."""
    table = pa.Table.from_batches(batches).combine_chunks()
    batch = table.to_batches()[0]
    word, unit = (batch.column(name).to_numpy() for name in ("word", "unit"))
    asked, cuts = _flat(batch, "contexts")
    count, _ = _flat(batch, "counts")
    width = np.diff(cuts)
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    asks = np.diff(np.append(first, len(word)))
    row = np.repeat(np.repeat(np.arange(len(first)), asks), width)
    learnt = count > 0
    known, rank = np.unique(asked, return_inverse=True)
    key = row[learnt] * len(known) + rank[learnt]
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[learnt][order].astype(np.int64)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    total = np.add.reduceat(count, head) if len(head) else count
    per_word = np.bincount(key[head] // len(known), minlength=len(first))
    return pa.RecordBatch.from_arrays(
        [pa.array(word[first]), _lists(known[key[head] % len(known)], per_word), _lists(total.astype(np.int32), per_word),
         _lists(unit, asks), _lists(width.astype(np.int32), asks), _lists(asked, np.bincount(row, minlength=len(first)))],
        names=["word", "contexts", "counts", "units", "widths", "asked"])


def _by_word(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each unit and word of whole ranges, by word."""
    batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    word, cuts = _flat(batch, "words")
    width, _ = _flat(batch, "widths")
    unit = np.repeat(batch.column("unit").to_numpy(), np.diff(cuts))
    whole = pa.RecordBatch.from_arrays(
        [pa.array(word), pa.array(unit), *[_lists(_flat(batch, name)[0], width) for name in ("contexts", "counts")]],
        names=["word", "unit", "contexts", "counts"])
    return whole.take(pa.array(np.argsort(word, kind="stable")))


def _opener(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests as rows of single words, sorted by word. They come sorted by range; ranges are passed on when the next one has begun."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        ranges = batch.column("range").to_numpy()
        _, ends = _flat(batch, "words")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [batch.num_rows]])
        for at, upto in zip(cuts[:-1], cuts[1:]) if batch.num_rows else ():
            if size >= GATHERED and waiting[-1].column("range")[0].as_py() != ranges[at]:
                yield _by_word(waiting)
                waiting, size = [], 0
            waiting.append(batch.slice(at, upto - at))
            size += int(ends[upto] - ends[at])
    if waiting:
        yield _by_word(waiting)


def _gatherer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests come sorted by word; a word is passed on when the next one has begun."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        word = batch.column("word").to_numpy()
        whole = int(np.searchsorted(word, word[-1]))  # rows before the last word
        if size >= GATHERED and (whole or word[0] != waiting[-1].column("word")[-1].as_py()):
            yield _gathered([*waiting, batch.slice(0, whole)])
            waiting, size, batch = [], 0, batch.slice(whole)
        waiting.append(batch)
        size += batch.num_rows
    if waiting:
        yield _gathered(waiting)


def _dealt(buckets: int):
    """Gathered words with all contexts that are asked for, unlearnt ones with a count of 0; what units ask are places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, cuts = _flat(batch, "asked")
            known, rank = np.unique(asked, return_inverse=True)
            key, place = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(cuts)) * len(known) + rank, return_inverse=True)
            width = np.bincount(key // len(known), minlength=batch.num_rows)
            learnt, learnt_cuts = _flat(batch, "contexts")
            counts = np.zeros(len(key), dtype=np.int32)
            at = np.repeat(np.arange(batch.num_rows), np.diff(learnt_cuts)) * len(known) + np.searchsorted(known, learnt)
            counts[np.searchsorted(key, at)] = _flat(batch, "counts")[0]
            place = place - np.repeat(np.cumsum(width) - width, np.diff(cuts))
            word = batch.column("word")
            bucket = (word.to_numpy().view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), word, _lists(known[key % len(known)], width), _lists(counts, width),
                 batch.column("units"), batch.column("widths"), _lists(place.astype(np.int32), np.diff(cuts))],
                names=["bucket", "word", "contexts", "counts", "units", "widths", "places"])

    return run


@dataclass
class Seating:
    """The words of a batch as they are seated."""

    word: np.ndarray
    context: np.ndarray
    cuts: np.ndarray  # where the contexts of a word end
    count: np.ndarray
    tables: np.ndarray  # samples, contexts; of the words in ``context`` order
    row: np.ndarray  # the word of each class
    kind: np.ndarray  # which class it is
    of_class: np.ndarray  # the class of each context
    above: np.ndarray  # samples, classes: customers
    class_tables: np.ndarray  # samples, classes
    parent: np.ndarray  # samples, words: customers of the parent
    root: np.ndarray  # samples, words: tables of the parent

    @staticmethod
    def of(batch: pa.RecordBatch, given: np.ndarray | None, t: Totals | None, s: Settings, samples: int) -> Seating:
        """Seated by draws, given the totals of the round before (``given``: tables of each context); without totals one table for each dish."""
        word = batch.column("word").to_numpy().view(np.uint64)
        context, cuts = _flat(batch, "contexts")
        context, count = context.view(np.uint64), _flat(batch, "counts")[0].astype(np.int64)
        of_word = np.repeat(np.arange(len(word)), np.diff(cuts))
        kind = (context >> np.uint64(48)).astype(np.int64)
        fresh = np.append(True, (of_word[1:] != of_word[:-1]) | (kind[1:] != kind[:-1]))[:len(kind)]
        head, of_class = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        row, kind = of_word[head], kind[head]
        ends = np.append(head, len(context))
        word_ends = np.searchsorted(row, np.arange(len(word) + 1))
        one = np.minimum(count, 1)
        some = _sums(one, ends)  # contexts of a class that have the word
        classes = _sums(np.minimum(some, 1), word_ends)
        if t is None:
            tables = np.repeat(one[None], samples, axis=0)
            above = np.repeat(some[None], samples, axis=0)
            class_tables = np.minimum(above, 1)
            parent = np.repeat(classes[None], samples, axis=0)
            return Seating(word, context, cuts, count, tables, row, kind, of_class, above, class_tables, parent, np.minimum(parent, 1))
        base = t.parent_probability(s, classes, 1, 0)[row]
        new = (s.strength + s.discount * t.tables[0, kind]) * base  # a table of a class
        weight = (s.strength + s.discount * given) * t.class_probability(s, kind, some, 1, base, 0)[of_class]
        key = mix(word[of_word] ^ mix(context))
        tables = np.minimum(seat(count, weight, key, s, samples), count)
        above = _sums(tables, ends)
        key = mix(word[row] ^ mix(kind.astype(np.uint64)))
        class_tables = np.stack([np.minimum(seat(above[i], new, mix(key + np.uint64(i + 1)), s, 1)[0], above[i]) for i in range(samples)])
        parent = _sums(class_tables, word_ends)
        new = np.full(len(word), (s.strength + s.discount * t.parent_tables[0]) / (t.known + 1))
        root = np.stack([np.minimum(seat(parent[i], new, mix(word + np.uint64(i + 1)), s, 1)[0], parent[i]) for i in range(samples)])
        return Seating(word, context, cuts, count, tables, row, kind, of_class, above, class_tables, parent, root)


def _one_batch(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def _given(totals: pa.Table, context: np.ndarray, names: list[str]) -> np.ndarray:
    """Totals of each context of a bucket, a row for each of ``names``."""
    have = totals["context"].to_numpy()
    order = np.argsort(have)
    at = order[np.searchsorted(have, context, sorter=order)]
    return np.stack([totals[name].to_numpy()[at] for name in names])


def _sum_names(samples: int) -> list[str]:
    return [f"tables{i}" for i in range(samples)]


def _sum_schema(samples: int) -> str:
    return ", ".join(["bucket int, context long, customers long, given long", *(f"{name} long" for name in _sum_names(samples))])


def _summer(totals, s: Settings, samples: int):
    """Sums of a bucket by context, with the tables they were ``given``; rows without bucket are sums of the classes and of the parent.

    Those have slot ``sample * (2 * CONTEXTS + 2)`` on: tables and customers by class, the parent's customers and tables; at last known words and tokens.
    """

    def run(words: pa.Table, before: pa.Table | None = None) -> pa.Table:
        batch = _one_batch(words)
        given = None if before is None else _given(before, _flat(batch, "contexts")[0], ["tables0"])[0]
        found = Seating.of(batch, given, totals.value if totals else None, s, samples)
        sums = np.zeros((samples, 2 * CONTEXTS + 2), dtype=np.int64)
        for i in range(samples):
            np.add.at(sums[i], found.kind, found.class_tables[i])
            np.add.at(sums[i], found.kind + CONTEXTS, found.above[i])
        sums[:, -2], sums[:, -1] = found.parent.sum(axis=1), found.root.sum(axis=1)
        flat = np.concatenate([sums.reshape(-1), [(found.parent[0] > 0).sum(), found.count.sum()]])
        slots = np.flatnonzero(flat)
        context, first, rank = np.unique(found.context.view(np.int64), return_index=True, return_inverse=True)

        def by_context(values: np.ndarray) -> np.ndarray:
            return np.bincount(rank, weights=values, minlength=len(context)).astype(np.int64)

        none = np.zeros(len(slots), dtype=np.int64)
        columns = {"context": (context, slots), "customers": (by_context(found.count), flat[slots]),
                   "given": (context * 0 if given is None else given[first], none)}
        columns |= {name: (by_context(found.tables[i]), none) for i, name in enumerate(_sum_names(samples))}
        bucket = pa.concat_arrays([pa.array(np.full(len(context), batch.column("bucket")[0].as_py(), dtype=np.int32)), pa.nulls(len(slots), pa.int32())])
        return pa.table({"bucket": bucket, **{name: np.concatenate(x) for name, x in columns.items()}})

    return (lambda words: run(words)) if totals is None else (lambda words, before: run(words, before))


def _by_unit(answers: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each unit that asked, with its words, their counts and the logs of their contexts."""
    batch = pa.Table.from_batches(answers).combine_chunks().to_batches()[0]
    batch = batch.take(pa.array(np.argsort(batch.column("unit").to_numpy(), kind="stable")))
    unit = batch.column("unit").to_numpy()
    logs, cuts = _flat(batch, "logs")
    head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    per_word = np.diff(np.append(head, len(unit)))
    return pa.RecordBatch.from_arrays(
        [pa.array(unit[head]), _lists(batch.column("word").to_numpy(), per_word), _lists(batch.column("n").to_numpy(), per_word),
         _lists(np.diff(cuts).astype(np.int32), per_word), _lists(logs, np.diff(np.append(cuts[head], cuts[-1])))],
        names=["unit", "words", "n", "widths", "logs"])


def _answerer(answers: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to single words, gathered by unit some at a time."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in answers:
        waiting.append(batch)
        size += batch.num_rows
        if size >= ANSWERED:
            yield _by_unit(waiting)
            waiting, size = [], 0
    if waiting:
        yield _by_unit(waiting)


def _scorer(before, totals, s: Settings):
    def run(words: pa.Table, sums: pa.Table) -> pa.Table:
        t: Totals = totals.value
        samples, batch = len(t.tables), _one_batch(words)
        context, cuts = _flat(batch, "contexts")
        given, customers, *tables = _given(sums, context, ["given", "customers", *_sum_names(samples)])
        found = Seating.of(batch, given, before.value, s, samples)
        p = np.zeros(len(context))
        for i in range(samples):
            parent = t.parent_probability(s, found.parent[i], found.root[i], i)[found.row]
            shared = t.class_probability(s, found.kind, found.above[i], found.class_tables[i], parent, i)[found.of_class]
            p += np.maximum(found.count - s.discount * found.tables[i], 0) + (s.strength + s.discount * tables[i]) * shared
        logs = np.log10(p / samples / (s.strength + customers)).astype(np.float32)
        place, place_cuts = _flat(batch, "places")
        units, unit_cuts = _flat(batch, "units")
        asks = np.diff(unit_cuts)
        answers = pa.RecordBatch.from_arrays(
            [pa.array(units), pa.array(np.repeat(found.word.view(np.int64), asks)), pa.array(np.repeat(_sums(found.count, cuts), asks)),
             _lists(logs[np.repeat(cuts[:-1], np.diff(place_cuts)) + place], _flat(batch, "widths")[0])],
            names=["unit", "word", "n", "logs"])
        return pa.Table.from_batches(_answerer(iter([answers])))

    return run


def _answer(tokens: int, known: int):
    def run(units: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        batch = answers.combine_chunks().to_batches()[0]
        word, n, width, logs = (_flat(batch, name)[0] for name in ("words", "n", "widths", "logs"))
        order = np.argsort(word)
        logs = _lists(logs, width).take(pa.array(order)).flatten().to_numpy()
        n = np.repeat(n[order], width[order])
        base = np.log10((n + 0.1) / (tokens + 0.1 * (known + 1)))
        for whole in units["packed"].to_pylist():
            size = int.from_bytes(whole[:8], "little")
            raw = np.frombuffer(zstandard.decompress(whole[8:8 + size]), dtype=np.uint8)
            count = len(raw) // 9
            ids, named = raw[:8 * count].view(np.int64), raw[8 * count:].astype(bool)
            lengths, pair = _unpack(whole[8 + size:])
            cuts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            out.append(pa.table({
                "id": ids, "named": named, "n_tokens": lengths, "n_known": np.add.reduceat((n[pair] > 0).astype(np.int64), cuts),
                "base_score": np.add.reduceat(base[pair], cuts), "score": np.add.reduceat(logs[pair].astype(np.float64), cuts)}))
        return pa.concat_tables(out)

    return run


def score_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Learns from the rows of ``docs(doc_id, text, ...)`` that are not held out and scores all of them.

    Returns ``doc_id``, ``held_out`` (crc32 of the id modulo 10 is 0), ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (smoothed unigrams), ``score`` (log10 probability of the text, its end included) and
    ``perplexity``. A null text is empty: one token, its end. Rows pass one to one, repeated ones alike; a null id is
    not held out. Other columns are not read. No rows: no rows; no row to learn from: every word is unknown.
    """
    spark = docs.sparkSession
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), "text", (~held).cast("int").alias("learn"))
    ranges = max(RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    units = materialize(rows.mapInArrow(_packer(ranges, _befores), REQUEST), "lm-units")
    requests = units.where("range is not null").select("range", "unit", "words", "widths", "contexts", "counts")
    deal = _dealt(buckets)
    gathered = materialize(requests.repartition("range").sortWithinPartitions("range").mapInArrow(
        lambda batches: deal(_gatherer(_opener(batches))), GATHER), "lm-words", clean=True)
    packed = materialize(units.where("packed is not null").select("unit", "packed"), "lm-packed")
    delete_table(units)
    learnt = gathered.select("bucket", "word", "contexts", "counts")

    def of_contexts(sums: DataFrame, samples: int) -> DataFrame:
        """The totals of each context, for every bucket that holds it, in place of the sums."""
        everywhere = Window.partitionBy("context")
        found = materialize(sums.where("bucket is not null").select(
            "bucket", "context", "given", *[F.sum(name).over(everywhere).alias(name) for name in ("customers", *_sum_names(samples))]),
            "lm-contexts", clean=True)
        delete_table(sums)
        return found

    def of_classes(sums: DataFrame, samples: int) -> Totals:
        flat = np.zeros(samples * (2 * CONTEXTS + 2) + 2, dtype=np.int64)
        for slot, total in sums.where("bucket is null").groupBy("context").agg(F.sum("customers")).collect():
            flat[slot] = total
        by = flat[:-2].reshape(samples, 2 * CONTEXTS + 2)
        return Totals(by[:, CONTEXTS:-2], by[:, :CONTEXTS], by[:, -2], by[:, -1], int(flat[-2]), int(flat[-1]))

    sums = materialize(learnt.groupBy("bucket").applyInArrow(_summer(None, s, 1), _sum_schema(1)), "lm-sums", clean=True)
    now, before = of_classes(sums, 1), None
    shared = spark.sparkContext.broadcast(now)
    for turn in range(s.rounds):
        samples = s.samples if turn == s.rounds - 1 else 1
        given = of_contexts(sums, 1)
        sums = materialize(learnt.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(
            _summer(shared, s, samples), _sum_schema(samples)), "lm-sums", clean=True)
        delete_table(given)
        now = of_classes(sums, samples)
        before, shared = shared, spark.sparkContext.broadcast(now)
    given = of_contexts(sums, s.samples)
    answers = materialize(gathered.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(
        _scorer(before, shared, s), ANSWER), "lm-answers", clean=True)
    delete_table(gathered)
    delete_table(given)
    scored = packed.groupBy("unit").cogroup(
        answers.groupBy("unit")).applyInArrow(
        _answer(now.tokens, now.known), "id long, named boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("row", F.when(F.col("named"), F.col("id"))).select(
        F.col("row").alias("doc_id"), F.coalesce(F.crc32(F.col("row").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", F.lit(now.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
