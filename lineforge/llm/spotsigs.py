"""SpotSigs fingerprints: chains of content words that follow common words.

A spot is a common word (an anchor) and the next ``CHAIN`` words after it that are not common ones. The set of a
text's spots is its fingerprint: layout, case and short insertions of function words leave it as it is. A text
without a spot has its whole word sequence as the only signature. Similarity is Jaccard.

For similar pairs, sets are partitioned by length so that sets whose lengths alone rule out the threshold
never meet, and within a partition only sets that share one of their rarest signatures are compared: a pair above the
threshold must share one among the first ``length - ceil(threshold * length) + 1``. Everything is built-in expressions.
"""

from __future__ import annotations

from decimal import Decimal
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineforge.operators import ranking
from lineforge.session import materialize

CHAIN = 2
# Common words of four languages.
COMMON = (
    "the of and to in is was for with that on as by at from this it be are or an "
    "der die das und den von zu mit ist des auf im ein eine nicht sich "
    "de la le et les des du en un une que est pour dans il qui "
    "el los las y por con del se una lo al su").split()
MARK = "\x01"  # stands before common words; plain text holds letters, digits and spaces only
_COMMON = r"(?<![^ ])(?:" + "|".join(sorted(set(COMMON))) + r")(?![^ ])"
_ANCHOR, _CONTENT = f"{MARK}[^ ]++", f"[^ {MARK}][^ ]*+"
_RUN = f"{_ANCHOR}(?: {_ANCHOR})*+"
# A run of anchors with the chain after it, looked ahead at so that chains overlap; the run alone is consumed, and one
# without a chain too, so every word is read a bounded number of times and no run costs a stack frame.
_SPOT = f"(?:(?=({_RUN}" + f"(?: {_CONTENT}(?: {_ANCHOR})*+)" * (CHAIN - 1) + f" {_CONTENT})){_RUN}|{_RUN})"


def signatures(text: Column) -> Column:
    """The distinct spot signatures of a text, as sorted 64-bit hashes; null, empty and wordless texts have none.

    Each distinct anchor of a run of common words makes one signature with the chain after the run.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))

    def of_run(spot: Column) -> Column:
        run = F.regexp_extract(spot, f"^(?:{_ANCHOR} )++", 0)
        anchors = F.array_distinct(F.filter(F.split(F.translate(run, MARK, ""), " "), lambda w: w != ""))
        chain = F.regexp_replace(F.substring(spot, F.length(run), F.length(spot)), f" {_ANCHOR}", "")
        return F.transform(anchors, lambda anchor: F.xxhash64(F.concat(anchor, chain)))

    def of_text(words: Column) -> Column:
        marked = F.regexp_replace(words, _COMMON, f"{MARK}$0")
        runs = F.filter(F.regexp_extract_all(marked, F.lit(_SPOT), F.lit(1)), lambda spot: spot != "")
        spots = F.array_distinct(F.flatten(F.transform(runs, of_run)))
        whole = F.when(words != "", F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.array(spots), lambda found: F.array_sort(F.when(F.size(found) > 0, found).otherwise(whole)))[0]

    # arrays of one name values that are used more than once
    return F.transform(F.array(plain), of_text)[0]


def as_text(signature: Column) -> Column:
    """A fingerprint as text: the sorted signatures in hexadecimal, separated by spaces."""
    return F.array_join(F.transform(signature, lambda s: F.lower(F.hex(s))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature arrays; of two empty ones 1. Sets that can't share anything are not compared."""
    apart = (F.size(a) == 0) | (F.size(b) == 0) | (F.element_at(a, -1) < F.element_at(b, 1)) | (
        F.element_at(b, -1) < F.element_at(a, 1))
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(apart, 0.0).when(a == b, 1.0).otherwise(
        shared / (F.size(a) + F.size(b) - shared))


def _with_next(docs: DataFrame, rows_per_range: int = 1024) -> DataFrame:
    """Adds ``next``: text and signatures of the row with the next higher ``key``; the last row's is the first's.

    Keys are cut at their quantiles into ranges of about ``rows_per_range`` rows, up to 16,384 of them, however they cluster. The first
    row of each is also sent to the range before, so that no order over all rows is needed. Only its signatures are
    made twice.
    """
    count = docs.count()
    bits = max(1, min(14, (count // rows_per_range).bit_length()))
    # written: the order in which sketches merge changes their cuts, and the rows sent must be those of the final ranges
    cuts = materialize(docs.agg(ranking.quantiles("key", bits).alias("cuts")), "spots-cuts").scalar()
    rows = docs.withColumn("__cuts", cuts).withColumn("__range", ranking.range_of("key", F.col("__cuts"), bits)).drop("__cuts")
    firsts = rows.groupBy("__range").agg(F.min("key").alias("__first"))
    order = Window.partitionBy(F.lit(0)).orderBy("__range")  # of narrow rows, as many as there are ranges
    everything = Window.partitionBy(F.lit(0))
    sent_to = F.coalesce(F.lag("__range").over(order), F.max("__range").over(everything))
    before = materialize(firsts.select(F.col("__first").alias("key"), sent_to.alias("__to")), "spots-ranges")
    # of rows that share the key, the first by text, as the order below has it; null texts come as empty ones
    sent = docs.join(before, "key").groupBy("key", "__to").agg(F.min("text").alias("text")).select(
        "key", "text", F.lit(None).cast("long").alias("doc_id"), F.col("__to").alias("__range"), F.lit(True).alias("__sent"))
    both = rows.withColumn("__sent", F.lit(False)).unionByName(sent).withColumn("sigs", signatures(F.col("text")))
    # a range's own rows by key, then the row sent to it (the first of all wraps around to the last range)
    inside = Window.partitionBy("__range").orderBy("__sent", "key", "text")
    following = F.lead(F.struct("text", "sigs")).over(inside)
    return both.withColumn("next", following).where("not __sent").drop("__range", "__sent")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text, ...)`` and of a half-replaced copy of each.

    The edited text keeps the first half (rounded up) of the code points; as many as are lost follow from the start of the
    next document in the order of ids, or all it has; the last document is followed by the first, a single one
    by itself. Repeated ids follow each other in the order of their texts, and rows without an id come before all others.
    Returns ``doc_id``, ``n_chars``, ``edited``, ``sigs``, ``edited_sigs``, ``next_sigs``. A null text is empty. Other
    columns are not read. No rows: no rows.
    """
    # a null key is the lowest of a range, and of all
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(
        F.col("doc_id").cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)).cast("decimal(20,0)")).alias("key"))
    own = _with_next(own)
    lost = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - lost), F.substring("next.text", F.lit(1), lost))
    own = own.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sigs",
                     F.col("next.sigs").alias("next_sigs"))
    return own.withColumn("edited_sigs", signatures(F.col("edited")))


def similar_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs ``(a, b, similarity)`` of different fingerprints at or above the threshold, with their classes.

    ``prints(doc_id, sigs)``; rows of equal fingerprints are one class, named by the smallest id, and pairs are
    between classes. Empty fingerprints are similar to nothing.
    """
    classes = prints.where("size(sigs) > 0").groupBy("sigs").agg(F.min("doc_id").alias("id"))
    classes = materialize(classes.withColumn("n", F.size("sigs")), "spots-classes")
    entries = classes.select("id", "n", F.explode("sigs").alias("sig"))
    df = entries.groupBy("sig").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "sig"))
    prefix = entries.join(df, "sig").withColumn("place", rank).where(
        F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1)
    # a partition spans lengths within one factor of 1 / threshold; a set also visits the partition above
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(threshold))).cast("int")
    left = prefix.select("sig", part.alias("part"), F.col("id").alias("a"), F.col("n").alias("na"))
    right = prefix.select("sig", F.explode(F.array(part, part + 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("nb") <= F.col("na")) & (F.col("nb") >= threshold * F.col("na")) & (
        (F.col("nb") < F.col("na")) | (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "part"]).where(fits).select("a", "b").distinct()
    sides = classes.select("id", "sigs")
    found = pairs.join(sides.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(
        sides.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    found = found.withColumn("similarity", likeness(F.col("sa"), F.col("sb"))).where(F.col("similarity") >= threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
