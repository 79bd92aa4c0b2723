"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, in numpy.

A step's input is a word: the embedding of its hash beside the mean embedding of its hashed character
3- and 4-grams. Two gated recurrent layers, one per direction, run over a window of words; attention pools
their states, and a logistic unit scores the pool. Windows of ``WINDOW`` words overlap by half and cover
every word of a text; the text's score is that of its highest window, calibrated (Platt) on labelled rows
that training did not see.

Labels are of texts, not of windows. Training takes random windows first, then for each text the window
that scores highest at the time (and a random one of clean texts).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineforge.llm.tables import remainder
from lineforge.llm.tokens import BASE, Words, column_bytes, mix, words

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 16
WORD_BUCKETS, CHAR_BUCKETS = 1 << 13, 1 << 14
FORWARD = 1024  # windows scored at once
BLOCK = 4096  # distinct words whose inputs are made at once
THRESHOLD = 0.7


@dataclass(frozen=True)
class Training:
    """``rows_per_label`` bounds the labelled rows that are fitted on; their texts are whole."""

    rows_per_label: int = 1000
    random_epochs: int = 3
    epochs: int = 9
    batch: int = 128
    rate: float = 0.015
    seed: int = 11


# ---- input -------------------------------------------------------------------------------------

def _char_grams(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of some words, and how many each word has."""
    # bytes of the words, each between marks of its start and end
    cuts = np.concatenate([[0], np.cumsum(length + 2)])
    flat = np.zeros(cuts[-1], dtype=np.uint64)
    inner = np.arange(cuts[-1]) - np.repeat(cuts[:-1], length + 2) - 1
    body = (inner >= 0) & (inner < np.repeat(length, length + 2))
    flat[body] = data[np.repeat(start, length) + inner[body]]
    flat[cuts[:-1]], flat[cuts[1:] - 1] = 1, 2
    grams, owners = [], []
    left = np.repeat(cuts[1:], length + 2) - np.arange(cuts[-1])  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(start)), length + 2)
    for n in (3, 4):
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(BASE) + flat[at + j]
        grams.append((mix(h) % np.uint64(CHAR_BUCKETS)).astype(np.int32))
        owners.append(owner[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")  # every word has a 3-gram with its marks
    return np.concatenate(grams)[order], np.bincount(owner, minlength=len(start))


def word_features(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch: which one each word is, its word bucket, and its character n-grams.

    The n-gram buckets of all distinct words are one array, cut by the last result. They are made block by block.
    """
    _, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
    word_ids = (found.hash[first] % np.uint64(WORD_BUCKETS)).astype(np.int32)
    grams, counts = [np.empty(0, dtype=np.int32)], [np.zeros(1, dtype=np.int64)]
    for at in range(0, len(first), BLOCK):
        part = first[at:at + BLOCK]
        gram, count = _char_grams(found.data, found.start[part], (found.end - found.start)[part])
        grams.append(gram)
        counts.append(count)
    return which.reshape(-1).astype(np.int32), word_ids, np.concatenate(grams), np.cumsum(np.concatenate(counts))


def window_starts(n_words: int) -> np.ndarray:
    """Starts of the windows of a text: every half window, the last one flush with the end."""
    if n_words <= WINDOW:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n_words - WINDOW, STRIDE), n_words - WINDOW)


def cut_windows(which: np.ndarray, bounds: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts as rows of distinct-word numbers (``blank`` beyond a text) and their text."""
    starts = [window_starts(int(b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    text = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    at = (np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)) + bounds[text]
    padded = np.append(which, blank).astype(np.int32)
    out = np.empty((len(at), WINDOW), dtype=np.int32)
    for step in range(WINDOW):
        place = at + step
        out[:, step] = np.where(place < bounds[text + 1], padded[np.minimum(place, len(which))], blank)
    return out, text


# ---- network -----------------------------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Parameters by name; ``a`` and ``b`` turn the highest window's logit into a probability."""

    p: dict[str, np.ndarray]
    a: float = 1.0
    b: float = 0.0
    folded: np.ndarray | None = None
    steps: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shape = {
            "word": (WORD_BUCKETS, WORD_DIM), "char": (CHAR_BUCKETS, CHAR_DIM),
            "input": (WORD_DIM + CHAR_DIM, 6 * HIDDEN), "bias": (6 * HIDDEN,), "state": (2, HIDDEN, 3 * HIDDEN),
            "attend": (2 * HIDDEN,), "out": (2 * HIDDEN,), "shift": (1,)}
        scale = {"word": 0.1, "char": 0.3, "input": 0.3, "state": 0.3, "attend": 0.3, "out": 0.5, "bias": 0, "shift": 0}
        return Network({k: (scale[k] * rng.standard_normal(s)).astype(np.float32) for k, s in shape.items()})

    def inputs(self, word_ids: np.ndarray, grams: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Embedding of each distinct word."""
        out = np.empty((len(word_ids), WORD_DIM + CHAR_DIM), dtype=np.float32)
        out[:, :WORD_DIM] = self.p["word"][word_ids]
        for lo in range(0, len(word_ids), BLOCK):
            hi = min(lo + BLOCK, len(word_ids))
            own = self.p["char"][grams[cuts[lo]:cuts[hi]]]
            out[lo:hi, WORD_DIM:] = np.add.reduceat(own, cuts[lo:hi] - cuts[lo]) / np.diff(cuts[lo:hi + 1])[:, None]
        return out

    def forward(self, gates: np.ndarray, inside: np.ndarray, keep: bool = False):
        """Logits of windows from their gate inputs (windows, steps, 6 * HIDDEN); what backward needs if ``keep``."""
        count, h3 = len(gates), 3 * HIDDEN
        state = np.zeros((2, count, HIDDEN), dtype=np.float32)
        states = np.zeros((2, WINDOW, count, HIDDEN), dtype=np.float32)
        saved = []
        for t in range(WINDOW):
            u = WINDOW - 1 - t
            gx = np.stack([gates[:, t, :h3], gates[:, u, h3:]])
            gh = state @ self.p["state"]
            rz = _sigmoid(gx[..., :2 * HIDDEN] + gh[..., :2 * HIDDEN])
            r, z = rz[..., :HIDDEN], rz[..., HIDDEN:]
            n = np.tanh(gx[..., 2 * HIDDEN:] + r * gh[..., 2 * HIDDEN:])
            live = np.stack([inside[:, t], inside[:, u]])[..., None]
            fresh = np.where(live, n + z * (state - n), state)
            if keep:
                saved.append((state, gh, r, z, n, live))
            state = fresh
            states[0, t], states[1, u] = fresh[0], fresh[1]
        both = np.concatenate([states[0], states[1]], axis=-1)  # steps, windows, 2 * HIDDEN
        weight = np.where(inside.T, both @ self.p["attend"], -1e9)
        weight = np.exp(weight - weight.max(axis=0)) * inside.T
        weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
        pool = (weight[..., None] * both).sum(axis=0)
        logit = pool @ self.p["out"] + self.p["shift"][0]
        return (logit, (saved, both, weight, pool)) if keep else logit

    def gradients(self, x: np.ndarray, inside: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by parameter; ``inputs`` is the gradient of ``x``."""
        count, h3 = len(x), 3 * HIDDEN
        logit, (saved, both, weight, pool) = self.forward(x @ self.p["input"] + self.p["bias"], inside, keep=True)
        d = (_sigmoid(logit) - target) / count
        g = {"out": pool.T @ d, "shift": np.array([d.sum()])}
        d_pool = d[:, None] * self.p["out"]
        d_weight = (both * d_pool).sum(axis=-1)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", d_score, both)
        d_both = weight[..., None] * d_pool + d_score[..., None] * self.p["attend"]
        d_states = np.stack([d_both[..., :HIDDEN], d_both[..., HIDDEN:]])
        d_gates = np.zeros((count, WINDOW, 6 * HIDDEN), dtype=np.float32)
        g["state"] = np.zeros_like(self.p["state"])
        d_next = np.zeros((2, count, HIDDEN), dtype=np.float32)
        for t in range(WINDOW - 1, -1, -1):
            u = WINDOW - 1 - t
            state, gh, r, z, n, live = saved[t]
            d_h = d_next + np.stack([d_states[0, t], d_states[1, u]])
            d_new = np.where(live, d_h, 0)
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (state - n) * z * (1 - z)
            d_r = d_n * gh[..., 2 * HIDDEN:] * r * (1 - r)
            d_gh = np.concatenate([d_r, d_z, d_n * r], axis=-1)
            d_gx = np.concatenate([d_r, d_z, d_n], axis=-1)
            d_gates[:, t, :h3], d_gates[:, u, h3:] = d_gx[0], d_gx[1]
            g["state"] += state.transpose(0, 2, 1) @ d_gh
            d_next = d_gh @ self.p["state"].transpose(0, 2, 1) + np.where(live, d_new * z, d_h)
        flat = d_gates.reshape(-1, 6 * HIDDEN)
        g["input"] = x.reshape(-1, x.shape[-1]).T @ flat
        g["bias"] = flat.sum(axis=0)
        g["inputs"] = d_gates @ self.p["input"].T
        return g

    def descend(self, g: dict[str, np.ndarray], rate: float) -> None:
        """One Adagrad step."""
        for name, value in g.items():
            past = self.steps.setdefault(name, np.full_like(self.p[name], 1e-8))
            past += value * value
            self.p[name] -= rate * value / np.sqrt(past)

    def score_windows(self, word_ids, grams, cuts, windows: np.ndarray) -> np.ndarray:
        """Logits of the windows of one batch of texts. The input layer is applied once per distinct word."""
        gates = np.zeros((len(word_ids) + 1, 6 * HIDDEN), dtype=np.float32)
        gates[:-1] = self.inputs(word_ids, grams, cuts) @ self.p["input"] + self.p["bias"]
        blank = len(gates) - 1
        out = np.empty(len(windows), dtype=np.float32)
        for at in range(0, len(windows), FORWARD):
            part = windows[at:at + FORWARD]
            out[at:at + FORWARD] = self.forward(gates[part], part != blank)
        return out

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.a * np.asarray(logit, dtype=np.float64) + self.b)


def _highest(logits: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The highest logit of each text; every text has a window."""
    cuts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.empty(0, dtype=np.int64)
    return np.maximum.reduceat(logits, cuts) if len(cuts) else logits[:0]


def _platt(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make logits probabilities, by Newton steps towards smoothed targets."""
    positive, negative = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([logit, np.ones_like(logit)], axis=1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-4 * (w - [1.0, 0.0])), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def train(texts: pa.Array, labels: np.ndarray, how: Training = Training(), odds: float | None = None) -> Network:
    """Fits a network on labelled texts; a fifth of them only calibrates it.

    ``odds`` are those of label 1 in the data the texts were drawn from (default: as among the texts).
    Without texts of both labels the result is a constant: the share of label 1, smoothed.
    """
    net = Network.fresh(how.seed)
    rng = np.random.default_rng(how.seed)
    if len(set(labels.tolist())) < 2 or min(labels.sum(), (1 - labels).sum()) < 5:
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        net.a, net.b = 0.0, float(np.log(share / (1 - share)))
        return net
    found = words(*column_bytes(texts))
    del texts
    which, word_ids, grams, cuts = word_features(found)
    blank = len(word_ids)
    windows, text = cut_windows(which, found.bounds, blank)
    del found, which  # only windows over numbers of distinct words are left
    first = np.searchsorted(text, np.arange(len(labels) + 1))
    aside = rng.random(len(labels)) < 0.2
    fitted = np.flatnonzero(~aside)
    lengths = np.diff(cuts)
    for epoch in range(how.epochs):
        if epoch < how.random_epochs:
            chosen = np.concatenate([rng.integers(first[fitted], first[fitted + 1]) for _ in range(4)])
        else:
            logits = net.score_windows(word_ids, grams, cuts, windows)
            top = np.array([first[i] + np.argmax(logits[first[i]:first[i + 1]]) for i in fitted])
            clean = fitted[labels[fitted] == 0]
            chosen = np.concatenate([top, top, rng.integers(first[clean], first[clean + 1])])
        chosen = rng.permutation(chosen)
        for at in range(0, len(chosen), how.batch):
            part = windows[chosen[at:at + how.batch]]
            used, local = np.unique(part, return_inverse=True)
            local, inside = local.reshape(part.shape), part != blank
            used = used[used != blank]
            own = np.repeat(np.arange(len(used)), lengths[used])
            gram_at = np.repeat(cuts[used] - np.concatenate([[0], np.cumsum(lengths[used])[:-1]]), lengths[used])
            own_grams = grams[gram_at + np.arange(len(own))]
            own_cuts = np.concatenate([[0], np.cumsum(lengths[used])])
            base = net.inputs(word_ids[used], own_grams, own_cuts)
            x = np.concatenate([base, np.zeros((1, base.shape[1]), dtype=np.float32)])[np.minimum(local, len(used))]
            g = net.gradients(x, inside, labels[text[chosen[at:at + how.batch]]])
            d_words = np.zeros((len(used) + 1, x.shape[-1]), dtype=np.float32)
            np.add.at(d_words, np.minimum(local, len(used)).reshape(-1), g.pop("inputs").reshape(-1, x.shape[-1]))
            d_words = d_words[:-1]
            g["word"] = np.zeros_like(net.p["word"])
            np.add.at(g["word"], word_ids[used], d_words[:, :WORD_DIM])
            g["char"] = np.zeros_like(net.p["char"])
            np.add.at(g["char"], own_grams, (d_words[:, WORD_DIM:] / lengths[used][:, None])[own])
            net.descend(g, how.rate * (10 if epoch < 1 else 4))
    net.steps = {}
    top = _highest(net.score_windows(word_ids, grams, cuts, windows), text)
    check = aside if 0 < labels[aside].sum() < aside.sum() else np.ones_like(aside)
    net.a, net.b = _platt(top[check], labels[check])
    if odds:
        net.b += float(np.log(odds * (1 - labels[check]).sum() / labels[check].sum()))
    return net


# ---- Spark -------------------------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, how: Training) -> tuple[pa.Table, float | None]:
    """A sample to learn from, and the odds of label 1 among all rows that may be learned from.

    At most ``rows_per_label`` rows of either label from the folds to learn from, by the hash of their ids."""
    rows = labels.where(F.col("toxic").isin(0, 1) & (remainder("doc_id", 3) != 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = dict(rows.groupBy("toxic").count().collect())
    odds = counts[1] / counts[0] if len(counts) == 2 else None
    ids = [r for value in (0, 1) for r in rows.where(F.col("toxic") == value).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(how.rows_per_label).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, rows.schema)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(chosen), "doc_id")
    # rows that share a chosen id do not add to the bound
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * how.rows_per_label).select(
        "doc_id", "text", "toxic").toArrow(), odds


def _scores(net: Network, texts: pa.Array) -> np.ndarray:
    found = words(*column_bytes(texts))
    which, word_ids, grams, cuts = word_features(found)
    windows, text = cut_windows(which, found.bounds, len(word_ids))
    return net.probability(_highest(net.score_windows(word_ids, grams, cuts, windows), text))


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns.

    Null texts count as empty. Repeated rows stay or go together. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id``, ``score`` (0 to 1, higher: more toxic), ``predicted``.

    A null text is empty and scores as one without words. Repeated rows score alike. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {id_type}, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Network:
    sample, odds = labelled_sample(docs, labels, how)
    label = sample["toxic"].to_numpy().astype(np.int64)
    texts = sample.column("text")
    del sample
    return train(texts.combine_chunks(), label, how, odds)


def toxicity(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """Trains on labelled rows (``labels(doc_id, toxic)``) and scores every row of ``docs``.

    Returns ``doc_id``, ``held_out`` (not among the folds to learn from), ``score``, ``predicted``. A null text
    is empty and scores as a text without words. Rows pass one to one, repeated ones alike, null ids too
    (never held out). Other columns are not read. No labels, or of one value only: a constant score.
    """
    return score_documents(docs, fit(docs, labels, how)).select(
        "doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
