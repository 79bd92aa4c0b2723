"""The parser library as tables: sources, parser variants, and set-based changes to both.

Each change takes the current table and a table of requests and returns the new table. Library
sides are never hinted: Spark broadcasts them while their measured size allows and otherwise
shuffles on the signature, splitting hot signatures at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineforge.functions import text as tx
from lineforge.operators import ranking
from lineforge.session import materialize

SOURCE_COLUMNS = ["id", "name", "description", "created_at", "updated_at"]
PARSER_COLUMNS = [
    "id", "source_id", "signature", "variant", "label", "vrl_code", "sample_log", "ocsf_class", "hits",
    "created_at", "updated_at",
]


def _next_ids(existing: DataFrame, new: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """New rows with ``id`` counting on from the largest existing one, in request order.

    Only ``keys``, which name a new row, and ``order`` are ranked.
    """
    numbered = ranking.positions(new.select(*keys, order), order).drop("total", order)
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")).scalar()
    return ranking.join_on(new, numbered, keys).withColumn("id", F.col("position") + top).drop("position")


def _never_null(name: str) -> Column:
    """A join key that cannot be null: the library has no empty one.

    Otherwise Spark filters nulls before the join, right at the scan, and works out the signature a
    second time to do so.
    """
    return F.coalesce(F.col(name), F.lit(""))


def source_upsert(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert or ignore by name. Requests: seq, name, description, at; the first per name counts."""
    # The first request of each name by numbers alone; its text is fetched for the new names.
    first = requests.groupBy("name").agg(F.min("seq").alias("seq"), F.min_by("at", "seq").alias("created_at"))
    # Written, so that Spark knows how few they are when it joins the texts.
    fresh = materialize(first.join(sources.select("name"), "name", "left_anti"), "new-sources")
    texts = ranking.join_on(requests.select("name", "seq", "description"), fresh, ["name", "seq"])
    text = F.array_min(F.collect_set("description"))  # one, unless requests share a number
    added = _next_ids(sources, texts.groupBy("name", "seq", "created_at").agg(
        F.coalesce(text, F.lit("")).alias("description")), "seq", ["name"])
    return sources.select(*SOURCE_COLUMNS).unionByName(
        added.withColumn("updated_at", F.col("created_at")).select(*SOURCE_COLUMNS))


def source_ids(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """The id each request's name has."""
    return requests.join(sources.select("id", "name"), "name", "left")


def source_counts(sources: DataFrame, parsers: DataFrame) -> DataFrame:
    """Sources with their number of parsers, by name. Parsers are counted before the join."""
    counts = parsers.groupBy("source_id").agg(F.count("*").alias("n"))
    joined = sources.join(counts, sources.id == counts.source_id, "left")
    return joined.select(
        "id", "name", "description", F.coalesce("n", F.lit(0)).cast("long").alias("parser_count")).orderBy("name")


def source_delete(sources: DataFrame, parsers: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without the given ids, and parsers with those source ids set to null."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    kept = sources.join(gone, sources.id == gone.gone, "left_anti")
    cleared = parsers.join(gone, parsers.source_id == gone.gone, "left").withColumn(
        "source_id", F.when(F.col("gone").isNull(), F.col("source_id")))
    return kept, cleared.drop("gone")


def with_source_name(parsers: DataFrame, sources: DataFrame) -> DataFrame:
    names = sources.select(F.col("id").alias("__sid"), F.col("name").alias("source_name"))
    return parsers.join(names, F.col("source_id") == F.col("__sid"), "left").drop("__sid")


def parser_lookup(lines: DataFrame, parsers: DataFrame, sources: DataFrame) -> DataFrame:
    """Every variant for each line's signature, ranked by hits; ``hits`` is the value before a bump.

    Variants are ranked once in the library, not once per line.
    """
    lines = lines.withColumn("signature", _never_null("signature"))
    order = Window.partitionBy("signature").orderBy(F.desc("hits"), "id")
    ranked = with_source_name(parsers, sources).select(
        "signature", F.col("id").alias("parser_id"), "variant", "label", "vrl_code", "sample_log", "ocsf_class",
        "hits", "source_id", "source_name", F.row_number().over(order).alias("rank"))
    return lines.join(ranked, "signature")


def top_variants(parsers: DataFrame) -> DataFrame:
    """Per signature the variant with most hits (lowest id on ties) and the number of variants."""
    best = F.max_by(F.struct("id", "label", "vrl_code", "hits", "variant"), F.struct("hits", -F.col("id")))
    return parsers.groupBy("signature").agg(best.alias("top"), F.count("*").alias("variants"))


def hit_counts(parsers: DataFrame, lookups: DataFrame) -> DataFrame:
    """Library after the lookups (signature, at): each adds one hit to its signature's top variant.

    The top variant stays on top, so N lookups add N. Lookups shrink to one row per signature
    before they meet the library.
    """
    asked = lookups.groupBy(_never_null("signature").alias("signature")).agg(
        F.count("*").alias("asked"), F.max("at").alias("asked_at"))
    top = top_variants(parsers).join(asked, "signature").select(
        F.col("top.id").alias("__id"), "asked", "asked_at")
    return parsers.join(top, F.col("id") == F.col("__id"), "left").select(
        *[c for c in PARSER_COLUMNS if c not in ("hits", "updated_at")],
        (F.col("hits") + F.coalesce("asked", F.lit(0))).alias("hits"),
        F.coalesce("asked_at", "updated_at").alias("updated_at"))


def parser_upsert(parsers: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert (hits 1) or update by (signature, variant), as if requests ran one by one by seq.

    An update keeps id, hits and created_at. Requests: seq, signature, variant, vrl_code,
    sample_log, label, ocsf_class, source_id, at.
    """
    changed = ["vrl_code", "sample_log", "label", "ocsf_class", "source_id", "at"]
    keys = ["signature", "variant"]
    # The first and last request of each key by numbers alone; the texts are fetched for the last ones.
    ends = materialize(requests.groupBy(*keys).agg(
        F.min("seq").alias("first_seq"), F.min_by("at", "seq").alias("first_at"), F.max("seq").alias("seq")), "changed-keys")
    new = F.array_max(F.collect_set(F.struct(*changed)))  # one, unless requests share a number
    last = ranking.join_on(requests.select(*keys, "seq", *changed), ends, [*keys, "seq"]).groupBy(
        *keys, "first_seq", "first_at").agg(new.alias("new"))
    known = parsers.select("signature", "variant", F.col("id").alias("known_id"))
    # One row per changed key; read twice below, so the requests are read once.
    changes = materialize(last.join(known, keys, "left"), "parser-changes")
    updates = changes.filter("known_id IS NOT NULL").select("known_id", "new")
    found = F.col("known_id").isNotNull()

    def fresh(name: str, source: str) -> Column:
        return F.when(found, F.col(f"new.{source}")).otherwise(F.col(name)).alias(name)

    kept = parsers.join(updates, F.col("id") == F.col("known_id"), "left").select(
        "id", fresh("source_id", "source_id"), "signature", "variant", fresh("label", "label"),
        fresh("vrl_code", "vrl_code"), fresh("sample_log", "sample_log"), fresh("ocsf_class", "ocsf_class"),
        "hits", "created_at", fresh("updated_at", "at"))
    inserted = changes.filter("known_id IS NULL").select(
        "first_seq", "signature", "variant", "new.*", F.lit(1).cast("long").alias("hits"),
        F.col("first_at").alias("created_at"), F.col("new.at").alias("updated_at"))
    return kept.select(*PARSER_COLUMNS).unionByName(_next_ids(parsers, inserted, "first_seq", keys).select(*PARSER_COLUMNS))


def parser_list(parsers: DataFrame, sources: DataFrame, source_id: int | None = None) -> DataFrame:
    """Listing with an 80-character sample, most hits first."""
    if source_id is not None:
        parsers = parsers.filter(F.col("source_id") == source_id)
    return with_source_name(parsers, sources).select(
        "id", "signature", "variant", "label", "ocsf_class", "hits", "created_at",
        F.substring("sample_log", 1, 80).alias("sample"), "source_name").orderBy(F.desc("hits"), "id")


def parser_get(parsers: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = parsers.join(ids.select("id").distinct(), "id", "left_semi")
    return with_source_name(wanted, sources).select(*PARSER_COLUMNS, "source_name")


def parser_delete(parsers: DataFrame, ids: DataFrame) -> DataFrame:
    return parsers.join(ids.select("id"), "id", "left_anti").select(*PARSER_COLUMNS)


def parser_relabel(parsers: DataFrame, requests: DataFrame) -> DataFrame:
    """Set label and updated_at by id. Requests: seq, id, label, at; the last per id counts."""
    last = requests.groupBy("id").agg(F.max_by(F.struct("label", "at"), "seq").alias("new"))
    joined = parsers.join(last, "id", "left")
    return joined.select(
        *[c for c in PARSER_COLUMNS if c not in ("label", "updated_at")],
        F.coalesce("new.label", "label").alias("label"), F.coalesce("new.at", "updated_at").alias("updated_at"))


def library_size(parsers: DataFrame) -> DataFrame:
    return parsers.agg(F.count("*").alias("parsers"))


def route_lines(lines: DataFrame, parsers: DataFrame, col: str = "raw", dialect: str = "py") -> DataFrame:
    """What happens to each line: ``error`` (empty or null), ``blocked``, ``cached`` or ``needs_parser``.

    Empty and blocked lines get no signature, so they never reach the join's match. The library
    side carries one row per signature.
    """
    top = top_variants(parsers).select(
        F.col("signature").alias("__sig"), F.col("top.id").alias("parser_id"), F.col("top.label").alias("__label"),
        F.col("top.vrl_code").alias("vrl_code"), F.col("top.hits").alias("__hits"), "variants")
    cleaned = lines.withColumn("__clean", F.coalesce(tx.sanitize(F.col(col)), F.lit("")))
    screened = cleaned.withColumn("__matched", tx.screen(F.col("__clean"), dialect))
    empty, blocked = F.col("__clean") == "", F.col("__matched").isNotNull()
    signed = screened.withColumn("signature", F.when(~empty & ~blocked, tx.signature(F.col("__clean"))))
    # Lines without a signature get a key of their own from all their columns, so that they do not share one
    # partition. It depends on the row alone: a task that runs again sends every line where it went before.
    key = F.coalesce("signature", F.concat(F.lit("-"), F.xxhash64(*lines.columns).cast("string")))
    joined = signed.withColumn("__key", key).join(top, F.col("__key") == F.col("__sig"), "left")
    cached = F.col("parser_id").isNotNull()
    label = F.when(F.col("__label") != "", F.concat(F.lit(" ["), F.col("__label"), F.lit("]"))).otherwise("")
    several = F.when(
        F.col("variants") > 1, F.concat(F.lit(" ("), F.col("variants"), F.lit(" variants)"))).otherwise("")
    message = (
        F.when(empty, "Empty input.")
        .when(blocked, F.concat(F.lit("Injection detected: "), F.col("__matched")))
        .when(cached, F.concat(
            F.lit("Cache hit: parser #"), F.col("parser_id"), label, several,
            F.lit(" (used "), F.col("__hits"), F.lit("x)")))
        .otherwise(F.concat(F.lit("No parser for sig "), F.col("signature")))
    )
    action = F.when(empty, "error").when(blocked, "blocked").when(cached, "cached").otherwise("needs_parser")
    return joined.select(
        *lines.columns, action.alias("action"), "signature", "parser_id", "vrl_code",
        F.coalesce("variants", F.lit(0)).cast("long").alias("variants"), message.alias("message"))
