"""Near-duplicate documents: banded MinHash, odd sketches, and a check on the full sets.

The set of a document is its distinct word shingles. ``k = bands * rows`` MinHash samples are cut
into bands; documents that agree on a band are candidates. All samples of a document are also folded
into an odd sketch: each sample flips one bit of a bitmap, so that the XOR of two bitmaps holds only the
samples that differ, and its population count estimates high similarities closely. Candidates
whose bitmaps differ too much are dropped; the others are compared on their full sets.

Copies of a text are one class from the start, found by a 128-bit hash of their words. The members
of a band's bucket are first compared with its most central member alone (which agrees with the most documents
over all bands), which is linear in the bucket. Only members that did not come together that way are
compared with the rest of their bucket, inside a join that Spark can split on hot buckets. It lets through only
pairs of different components whose sizes allow the similarity and whose longer second sketches, made for these
documents alone, are close enough. Nothing is capped.

With 30 bands of 5 rows a pair at a similarity of 0.8 is missed with a probability of 7e-6; the
sketch bound lies five standard deviations off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineforge.llm.components import components
from lineforge.llm.tokens import column_bytes, mix, sequence_hash, shingles, words
from lineforge.session import materialize

SKETCH_WORDS, FINE_WORDS = 8, 128  # of 64 bits
FINE_SAMPLES = 4000
SLICE = 2048  # shingles hashed at once against all permutations
MEMBERS = 64  # documents compared with one copy of a hub's text


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 80  # link where 100 * intersection >= percent * union
    bands: int = 30
    rows: int = 5
    seed: int = 7

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def max_flips(self, samples: int, words: int) -> int:
        """Most bits in which the sketches of a pair at the threshold differ, five deviations up."""
        bits, j = 64 * words, self.percent / 100
        differ = samples * (1 - j) + 5 * sqrt(samples * j * (1 - j))
        share = (1 - (1 - 2 / bits) ** (2 * differ)) / 2
        return int(bits * share + 5 * sqrt(bits * share * (1 - share)) / 2) + 1


def _permutations(seed: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 1 << 32, samples, dtype=np.uint32)


def min_samples(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of every permutation over a set of 64-bit hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), SLICE):
        np.minimum(best, (low[at:at + SLICE, None] * factors + shifts).min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray, size: int = SKETCH_WORDS) -> np.ndarray:
    """Parity bitmap of the (position, value) pairs of the samples, as 64-bit words."""
    place = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32)))
    bit = (place % np.uint64(64 * size)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _signer(s: Settings):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _permutations(s.seed, s.samples)
        salt = np.arange(s.bands, dtype=np.uint64) << np.uint64(48)
        for batch in batches:
            found = words(*column_bytes(batch.column(1)))
            rows = []
            for i in range(batch.num_rows):
                own = found.hash[found.bounds[i]:found.bounds[i + 1]]
                one, two = sequence_hash(own)
                grams = np.sort(shingles(own, s.shingle))
                grams = grams[np.append(True, grams[1:] != grams[:-1])] if len(grams) else grams
                if not len(grams):
                    rows.append((0, one, two, [], []))
                    continue
                best = min_samples(grams, factors, shifts)
                keys = np.zeros(s.bands, dtype=np.uint64)
                for row in best.reshape(s.bands, s.rows).T:
                    keys = mix(keys * np.uint64(31) + row)
                rows.append((len(grams), one, two, mix(keys ^ salt).view(np.int64), odd_sketch(best).view(np.int64)))
            n, one, two, keys, sketch = zip(*rows, strict=True) if rows else ([],) * 5
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(list(keys), longs), pa.array(list(sketch), longs)],
                names=["doc_id", "text_hash", "n_shingles", "hash1", "hash2", "bands", "sketch"])

    return sign


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """Per document: hash of its text, set size, hash of its word sequence, band keys and odd sketch."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _signer(s), "doc_id long, text_hash long, n_shingles long, hash1 long, hash2 long, bands array<long>, sketch array<long>")


def _may_link(s: Settings, a: str, b: str, samples: int, width: int) -> Column:
    """Whether set sizes and sketches of two rows allow the similarity."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    flips = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda total, n: total + n)
    return (small * 100 >= large * s.percent) & (flips <= s.max_flips(samples, width))


def _comparer(s: Settings):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base = None, None
        for batch in batches:
            found = words(*column_bytes(batch.column(2)))
            hubs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, (hub, doc) in enumerate(zip(hubs, ids, strict=True)):
                grams = np.unique(shingles(found.hash[found.bounds[i]:found.bounds[i + 1]], s.shingle))
                if doc == hub:
                    key, base = hub, grams
                    continue
                if key != hub:
                    raise ValueError("a pair came without the text of its hub")
                shared = len(np.intersect1d(base, grams, assume_unique=True))
                if shared and 100 * shared >= s.percent * (len(base) + len(grams) - shared):
                    out.append((hub, doc))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return compare


def _finer(s: Settings):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _permutations(s.seed + 1, FINE_SAMPLES)
        for batch in batches:
            found = words(*column_bytes(batch.column(1)))
            out = [odd_sketch(min_samples(shingles(found.hash[found.bounds[i]:found.bounds[i + 1]], s.shingle),
                                          factors, shifts), FINE_WORDS).view(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))],
                                             names=["doc_id", "sketch"])

    return sketch


def fine_sketches(texts: DataFrame, s: Settings) -> DataFrame:
    """``(doc_id, sketch)`` of more samples and bits, for the few documents that need a closer estimate."""
    return texts.select("doc_id", "text").mapInArrow(_finer(s), "doc_id long, sketch array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets link; ``texts`` has one row per ``doc_id``.

    The texts travel once: to the groups of their hub ``a``. A hub with many partners is dealt
    over several groups of about ``MEMBERS``, each with its own copy of the hub's text, and a task
    streams its groups with one set in memory.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    hubs = parts.select(F.col("a").alias("hub"), F.col("a").alias("id"),
                        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    members = pairs.join(parts, "a").select(
        F.col("a").alias("hub"), F.col("b").alias("id"),
        F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    wanted = hubs.unionByName(members)
    rows = wanted.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("hub", "id", "text", "part")
    grouped = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))
    return grouped.mapInArrow(_comparer(s), "a long, b long")


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest doc_id reachable over links; ``kept`` marks that document. A null,
    empty or blank text has an empty set and is linked with nothing. A text of fewer words than a
    shingle is one shingle. Rows with the same doc_id are one document: each of their texts links it. A null doc_id stays
    alone, with a null component. Other columns are not read. No rows: no rows.
    """
    s = settings or Settings()
    signed = materialize(signatures(docs, s), "minhash")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # One text stands for all of the same words: that of the smallest id, which names the class unless it names another.
    low = F.min(F.struct("doc_id", "text_hash")).alias("low")
    classes = materialize(full.groupBy("hash1", "hash2").agg(low).select("hash1", "hash2", "low.doc_id", "low.text_hash"), "minhash-low")
    several = materialize(classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("doc_id").alias("id")), "minhash-ids")
    classes = classes.join(several, F.col("doc_id") == F.col("id"), "left").select(
        "hash1", "hash2", F.col("doc_id").alias("low"), "text_hash",
        F.when(F.col("id").isNotNull(), F.col("hash1")).otherwise(F.col("doc_id")).alias("rep"))
    copies = materialize(full.select("doc_id", "hash1", "hash2").join(classes, ["hash1", "hash2"]).select(
        "doc_id", "rep").distinct(), "minhash-copies")
    reps = full.join(classes, ["hash1", "hash2", "text_hash"]).where("doc_id = low").select(
        F.col("rep").alias("doc_id"), "low", "text_hash", F.col("n_shingles").alias("n"), "bands", "sketch")
    reps = materialize(reps.dropDuplicates(["doc_id"]), "minhash-reps")  # repeated rows are equal
    key = reps.select("doc_id", F.col("low").alias("__low"), F.col("text_hash").alias("__hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(
        key, (F.col("__id") == F.col("__low")) & (F.xxhash64("text") == F.col("__hash"))).select("doc_id", "text").dropDuplicates(["doc_id"])

    slots = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = slots.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    slots = materialize(slots.join(shared, "bucket"), "minhash-buckets")
    # The text that the others derive from agrees with most of them in every band.
    central = slots.groupBy("doc_id").agg(F.sum("size").alias("central"))
    hubs = slots.join(central, "doc_id").groupBy("bucket").agg(
        F.max(F.struct("central", (-F.col("doc_id")).alias("doc"))).alias("top"))
    slots = materialize(slots.join(hubs, "bucket").select("bucket", "doc_id", (-F.col("top.doc")).alias("hub")), "minhash-hubs")
    facts = reps.select("doc_id", F.struct("n", "sketch").alias("f"))

    def screened(pairs: DataFrame) -> DataFrame:
        left = facts.select(F.col("doc_id").alias("a"), F.col("f").alias("fa"))
        right = facts.select(F.col("doc_id").alias("b"), F.col("f").alias("fb"))
        return pairs.join(left, "a").join(right, "b").where(_may_link(s, "fa", "fb", s.samples, SKETCH_WORDS)).select("a", "b")

    stars = slots.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = materialize(screened(stars), "minhash-stars")
    # a document of several texts joins their classes
    firsts = copies.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1")
    same = copies.join(firsts, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    links = materialize(confirm(stars, texts, s).unionByName(same), "minhash-links")
    labels = components(links)

    # Members of a bucket that are not yet together, against all of their bucket.
    labelled = slots.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "bucket", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    open_slots = materialize(labelled.join(mixed.select("bucket", "low"), "bucket"), "minhash-open")
    open_docs = open_slots.select("doc_id").distinct()
    fine = materialize(fine_sketches(texts.join(open_docs, "doc_id", "left_semi"), s), "minhash-fine")
    open_facts = fine.join(reps.select("doc_id", "n", "bands"), "doc_id").select(
        "doc_id", F.struct("n", "sketch", "bands").alias("f"))
    open_slots = open_slots.join(open_facts, "doc_id")
    one, two = open_slots.where("label <> low").alias("x"), open_slots.alias("y")
    rest = one.join(two, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") != F.col("y.label")) & (
        (F.col("y.label") == F.col("y.low")) | (F.col("x.doc_id") < F.col("y.doc_id"))) & _may_link(
        s, "x.f", "y.f", FINE_SAMPLES, FINE_WORDS) & (
        # of all buckets that hold both, one lets the pair through
        F.array_min(F.array_intersect("x.f.bands", "y.f.bands")) == F.col("x.bucket")))
    rest = rest.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
    rest = materialize(rest.join(stars, ["a", "b"], "left_anti"), "minhash-rest")
    if not rest.isEmpty():
        labels = components(links.unionByName(confirm(rest, texts, s)))

    # a copy takes the label of its class, and a component the smallest id of its documents
    own = copies.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("label", "rep").alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    named = own.groupBy("label").agg(F.min("doc_id").alias("component"))
    own = own.join(named, "label").select("doc_id", "component")
    return signed.select("doc_id", "n_shingles").join(own, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
