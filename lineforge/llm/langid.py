"""Language of whole texts: averaged embeddings of hashed character n-grams and a linear softmax.

Texts are lower-cased; letters are kept and everything else is a mark between words. Every 1- to 4-gram
that holds letters, with a mark at most at its ends, has an embedding by its hash. Their mean goes through
a linear layer and a softmax. Embeddings and layer are trained by stochastic gradient descent in numpy. For
scoring they fold into one table of class scores per bucket, as both are linear.

A part of the sample that training does not see sets the temperature and the rejection level: the
lowest score from which on predictions are right often enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lineforge.llm.tables import remainder
from lineforge.session import materialize
from lineforge.llm.tokens import BASE, mix

BUCKETS, DIM = 1 << 14, 12
GRAMS = (1, 2, 3, 4)
PIECE = 1 << 18  # code points looked at together
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """``rows`` bounds the labelled rows fitted on; their texts are whole."""

    rows: int = 4000
    epochs: int = 6
    rate: float = 8.0
    precision: float = 0.995  # wanted of accepted predictions
    seed: int = 5


class _Letters:
    """Which code points are letters; made once per process."""

    table: np.ndarray | None = None

    def get(self) -> np.ndarray:
        if self.table is None:
            self.table = np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)
        return self.table


LETTERS = _Letters()


def buckets(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: the positions where one starts, and their buckets. ``points``: 0 is a mark."""
    letter = points != 0
    values = points.astype(np.uint64)
    for n in GRAMS:
        if len(points) < n:
            return
        count = len(points) - n + 1
        good = letter[:count] | letter[n - 1:n - 1 + count]
        for j in range(1, n - 1):
            good = good & letter[j:j + count]
        at = np.flatnonzero(good)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(BASE) + values[at + j]
        yield at, (mix(h) % np.uint64(BUCKETS)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(LETTERS.get()[points], points, 0)


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # class scores by bucket
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class logits of each text, and whether it has a letter. Long runs are read piece by piece."""
        total = np.zeros((len(texts), len(self.names)))
        count = np.zeros(len(texts))
        letters = np.zeros(len(texts), dtype=bool)
        mark = np.zeros(1, dtype=np.uint32)
        reach = max(GRAMS) - 1

        def add(points: np.ndarray, owner: np.ndarray, upto: int) -> None:
            """n-grams that start before ``upto``."""
            for at, bucket in buckets(points):
                inside = at < upto
                at, bucket = at[inside], bucket[inside]
                if len(at):
                    who = owner[at]
                    cuts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                    total[who[cuts]] += np.add.reduceat(self.table[bucket], cuts)
                    count[who[cuts]] += np.diff(np.append(cuts, len(at)))

        waiting: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if waiting:
                joined = np.concatenate(waiting)
                add(joined, np.concatenate(owners), len(joined))
            waiting.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            points = code_points(text)
            letters[i] = points.any()
            points = np.concatenate([mark, points, mark])
            if len(points) > PIECE:
                for at in range(0, len(points), PIECE):
                    part = points[at:at + PIECE + reach]
                    add(part, np.full(len(part), i), PIECE)
                continue
            waiting.append(points)
            owners.append(np.full(len(points), i))
            size += len(points)
            if size > PIECE:
                flush()
        flush()
        return total / np.maximum(count, 1)[:, None] + self.bias, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and acceptance of each text."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        logits, letters = self.logits(texts)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(letters, p[np.arange(len(texts)), best], 0.0)
        names = [self.names[b] if known else UNKNOWN for b, known in zip(best, letters, strict=True)]
        return names, score, letters & (score >= self.accept)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    points = np.concatenate([[0], code_points(text), [0]])
    found = [b for _, b in buckets(points)]
    used, n = np.unique(np.concatenate(found), return_counts=True)
    return used, (n / max(1, n.sum())).astype(np.float32)


def train(texts: list[str], langs: list[str], how: Training = Training()) -> Model:
    """Fits a model on labelled texts, and on a short piece of each; a fifth of the texts only calibrates it.

    No text with a letter: a model that knows no language.
    """
    rows = [(t, lang) for t, lang in zip(texts, langs, strict=True) if code_points(t).any()]
    names = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(how.seed)
    model = Model(names, np.zeros((BUCKETS, len(names)), dtype=np.float32), np.zeros(len(names)))
    if not rows:
        return model
    aside = rng.random(len(rows)) < 0.2 if len(rows) >= 50 else np.zeros(len(rows), dtype=bool)
    bags = []
    for (text, lang), kept in zip(rows, aside, strict=True):
        if not kept:
            bags.append((*_bag(text), names.index(lang)))
            at = int(rng.integers(0, max(1, len(text) - 40)))
            if code_points(text[at:at + 40]).any():
                bags.append((*_bag(text[at:at + 40]), names.index(lang)))
    embed = (rng.standard_normal((BUCKETS, DIM)) / DIM).astype(np.float32)
    layer = np.zeros((DIM, len(names)), dtype=np.float32)
    layer += rng.standard_normal(layer.shape).astype(np.float32) * 0.1
    bias = np.zeros(len(names), dtype=np.float32)
    steps = how.epochs * len(bags)
    done = 0
    for _ in range(how.epochs):
        for i in rng.permutation(len(bags)):
            used, share, label = bags[i]
            rate = how.rate * (1 - done / steps)
            done += 1
            mean = share @ embed[used]
            error = _softmax(mean @ layer + bias)
            error[label] -= 1
            back = layer @ error
            layer -= 0.02 * rate * np.outer(mean, error)
            bias -= 0.002 * rate * error
            embed[used] -= rate * share[:, None] * back
    model.table, model.bias = embed @ layer, bias.astype(np.float64)
    held = [row for row, kept in zip(rows, aside, strict=True) if kept] or rows
    logits, _ = model.logits([t for t, _ in held])
    truth = np.array([names.index(lang) for _, lang in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), truth], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-top)
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    enough = np.flatnonzero(precise >= how.precision)
    model.accept = float(top[order][enough[-1]]) if len(enough) else 1.0
    return model


def labelled_sample(docs: DataFrame, how: Training) -> pa.Table:
    """At most ``rows`` labelled rows from the folds to learn from, as many of each language, by the hash of the id.

    Languages with fewer rows give all they have. The few shares are written, so that they are broadcast and no text is
    shuffled but those of somewhat more rows than wanted; of these each language keeps its first by the hash, also
    where many rows share an id.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 3) != 1)).select(
        "doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    each = F.ceil(how.rows / F.greatest(F.lit(1), F.count("*").over(_all())))
    shares = materialize(counts.select("lang", each.alias("each"), (each * 1.2 / F.col("n") + 1e-9).alias("share")), "languages")
    place = (F.xxhash64("doc_id") / float(1 << 64) + 0.5).alias("u")
    drawn = rows.select("*", place).join(shares, "lang").where("u < share")
    order = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    chosen = drawn.withColumn("rank", F.row_number().over(order)).where("rank <= each")
    return chosen.select("doc_id", "text", "lang").orderBy("doc_id", "text").limit(how.rows).toArrow()


def _all() -> WindowSpec:
    return Window.partitionBy(F.lit(0))  # of one row per language


def identify(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """Trains on labelled rows of ``docs(doc_id, text, lang, ...)`` and predicts the language of every row.

    Returns ``doc_id``, ``held_out`` (not among the folds to learn from), ``lang_pred``, ``score`` (its
    probability), ``accepted`` (the score reaches the calibrated level). ``und`` with score 0 where the text
    is null or has no letter, or where no labelled row exists. Rows pass one to one, repeated ones
    alike, null ids too (never held out). Other columns are not read. No rows: no rows.
    """
    sample = labelled_sample(docs, how)
    model = train(sample["text"].to_pylist(), sample["lang"].to_pylist(), how)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, accepted = shared.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(accepted)],
                names=["doc_id", "lang_pred", "score", "accepted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(
        predict, f"doc_id {id_type}, lang_pred string, score double, accepted boolean")
    return found.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred",
                        "score", "accepted")
