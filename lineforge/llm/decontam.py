"""Benchmark decontamination: word n-grams of test items looked up in every window of the documents.

Both sides are lower-cased (A-Z) and cut into words, runs of ASCII letters and digits and of any
characters beyond ASCII. Every run of ``size`` words of an item is a window; an item of fewer words is
one window. Window hashes of a document come from four passes over its array of word hashes (runs of 1, 2,
4 and 8 words; two overlapping runs give any width between). Each is looked up in the hash set of the
item windows, and a hit is verified word by word in the same step.

The hash set is broadcast if its measured size is below ``broadcast_bytes``; a larger one is joined
by a shuffle of the window hashes. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineforge.session import materialize

SIZE = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 64  # of a hash set's row beside its words


def item_words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _join_runs(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: F.xxhash64(x, y))


def _shifted(runs: Column, by: int) -> Column:
    return F.slice(runs, by + 1, F.greatest(F.size(runs) - by, F.lit(0)))


def _with_window_hashes(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds ``windows``: per size the hashes of all runs of so many words, in order of position."""
    df = df.withColumn("__run1", F.transform("words", lambda w: F.xxhash64(w)))
    width, runs = 1, {1: "__run1"}
    while 2 * width <= max(sizes):
        wider = F.col(f"__run{width}")
        short = F.slice(wider, 1, F.greatest(F.size(wider) - width, F.lit(0)))
        df = df.withColumn(f"__run{2 * width}", _join_runs(short, _shifted(wider, width)))
        width *= 2
        runs[width] = f"__run{width}"
    parts = []
    for size in sizes:
        width = max(w for w in runs if w <= size)
        source = F.col(runs[width])
        if width == size:
            hashes = source
        else:
            by = size - width
            hashes = _join_runs(F.slice(source, 1, F.greatest(F.size(source) - by, F.lit(0))), _shifted(source, by))
        parts.append(F.struct(F.lit(size).alias("size"), hashes.alias("hashes")))
    return df.withColumn("windows", F.array(*parts)).drop(*runs.values())


def item_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows of ``benchmark(item_id, text)``: hash, size, words and the items they occur in.

    Items without words give none. An item_id that is null counts as an item of its own name, the
    empty string.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             item_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - size, F.lit(0))
    cut = items.select("item_id", F.explode(F.transform(
        F.sequence(F.lit(1), last + 1), lambda i: F.slice(F.col("words"), i, size))).alias("words"))
    distinct = cut.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return distinct.withColumn("size", F.size("words"))


def _hashed(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Item windows with the hash that a document's window of the same words has."""
    own = F.filter("windows", lambda w: w["size"] == F.col("size"))[0]["hashes"][0]
    return _with_window_hashes(windows, sizes).select(own.alias("hash"), "size", F.col("words").alias("item"), "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE,
              broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified occurrences: ``doc_id``, ``text_hash``, word ``position`` from 0, ``size`` and ``items``.

    ``text_hash`` tells apart different texts under one doc_id.
    """
    windows = materialize(item_windows(benchmark, size), "benchmark-windows")
    measured = windows.agg(
        F.sum(F.length(F.array_join("words", " ")) * 4 + F.length(F.array_join("items", " ")) + ROW_BYTES).alias("bytes"),
        F.collect_set("size").alias("sizes")).first()
    sizes = sorted(measured["sizes"]) or [size]  # at most ``size`` numbers
    lookup = _hashed(windows, sizes)
    small = (measured["bytes"] or 0) <= broadcast_bytes
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), item_words(F.col("text")).alias("words"))
    # the outer forms: else Spark repeats the window expressions, nested, in a filter before them
    rows = _with_window_hashes(texts, sizes).select("doc_id", "text_hash", "words", F.explode_outer("windows").alias("w"))
    # without a shuffle a window keeps its text's words at hand; else it travels as numbers
    carried = ["words"] if small else []
    rows = rows.select("doc_id", "text_hash", *carried, F.col("w.size").alias("width"),
                       F.posexplode_outer("w.hashes").alias("position", "hash"))
    lookup = F.broadcast(lookup) if small else lookup
    hits = rows.join(lookup, (rows["hash"] == lookup["hash"]) & (F.col("width") == F.col("size")))
    if not small:
        # repeated rows find the same windows; one of each is left, and one of each text that has any
        found = materialize(hits.select("doc_id", "text_hash", "position", "size", "item", "items").dropDuplicates(
            ["doc_id", "text_hash", "position", "size", "item"]), "benchmark-found")
        keys = found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("text_hash").eqNullSafe(F.col("__hash"))
        known = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(keys, same, "left_semi")
        known = known.dropDuplicates(["doc_id", "text_hash"]).select(
            F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), item_words(F.col("text")).alias("words"))
        hits = found.join(known, same)
    return hits.where(F.slice("words", F.col("position") + 1, F.col("size")) == F.col("item")).select(
        "doc_id", "text_hash", "position", "size", "items")


def _covered(spans: Column) -> Column:
    """How many positions the sorted (position, size) spans cover together."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        F.greatest(acc["upto"], s["position"] + s["size"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0), s["position"] + s["size"] - F.greatest(acc["upto"], s["position"]))).alias("n")),
        lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = 5,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: word and hit counts, the items found, and the verdict.

    Columns: ``doc_id``, ``text_hash``, ``n_words``, ``n_hit`` (words inside any occurrence), ``n_items``,
    ``items`` (sorted ids as strings), ``spans`` (position and size of each occurrence, sorted),
    ``contaminated`` (``n_hit > 0 and 100 * n_hit >= percent * n_words``). A null or empty text has no
    words. Repeated rows give the same result each. Other columns are not read. No documents: no rows; an
    empty benchmark: nothing is hit.
    """
    hits = materialize(find_hits(docs, benchmark, size, broadcast_bytes), "benchmark-hits")
    keys = ["doc_id", "text_hash"]
    # the spans of one text: as many as it has words at most
    spans = hits.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("position", "size"))).alias("spans"))
    items = hits.select(*keys, F.explode("items").alias("item")).distinct().groupBy(*keys).agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    found = spans.join(items, [spans[k].eqNullSafe(items[k]) for k in keys]).select(
        *[spans[k].alias(f"__{k}") for k in keys], "spans", "items")
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"),
                          F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    joined = counted.join(found, [counted[k].eqNullSafe(found[f"__{k}"]) for k in keys], "left")
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    n_items = F.coalesce(F.size("items"), F.lit(0))
    return joined.select(
        *keys, "n_words", n_hit.alias("n_hit"), F.when(F.col("items").isNull(), 0).otherwise(n_items).cast("long").alias(
            "n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def without_spans(text: Column, spans: Column) -> Column:
    """A text's words outside the spans, joined by spaces; for cutting passages instead of documents."""
    words = item_words(text)
    inside = lambda i: F.exists(F.coalesce(spans, F.array().cast("array<struct<position:int,size:int>>")),
                                lambda s: (i >= s["position"]) & (i < s["position"] + s["size"]))
    return F.array_join(F.filter(words, lambda w, i: ~inside(i)), " ")
