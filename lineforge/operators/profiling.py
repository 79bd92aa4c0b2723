"""Profiles of JSON event batches: keys, value types, key-set variants, samples, field hints.

Events arrive as JSON text (``col``) or, from ``scan_events``, as a variant. Every profile takes
optional group columns such as the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineforge.functions import json as js
from lineforge.functions import text as tx
from lineforge.operators import ranking

# Fixed value: the request text sent per batch.
BATCH_TEMPLATE = """\
I am providing you with {count} sample events from the same log source.
Analyze their common structure and variants, then produce a SINGLE VRL parser
that handles all observed formats.

Events:
{events_block}

Requirements:
- Identify the shared structure and any variant-specific fields.
- Use conditional branches (if/else) for variants where needed.
- Output a single ```vrl``` code block that handles ALL variants.
- Add a comment at the top listing the detected variants.
"""


def _event(events: DataFrame, col: str) -> Column:
    if events.schema[col].dataType.typeName() == "variant":
        return F.col(col)
    return F.try_parse_json(F.col(col))


def key_presence(
    events: DataFrame, col: str = "event_json", group: Sequence[str] = (), count_non_objects: bool = True
) -> DataFrame:
    """Per top-level key: events that have it, of how many, and whether it is common to all.

    The total takes a second, narrow scan: with non-objects counted it reads the group columns only.
    """
    members = js.fields(_event(events, col))
    counted = events if count_non_objects else events.filter(members.isNotNull())
    keys = events.select(*group, F.explode(F.map_keys(members)).alias("key"))
    counts = keys.groupBy(*group, "key").agg(F.count("*").alias("present"))
    total = F.count("*").alias("total")
    if group:
        counts = ranking.join_on(counts, counted.groupBy(*group).agg(total), group)
    else:
        counts = counts.withColumn("total", counted.agg(total).scalar())
    return counts.withColumn("common", F.col("present") == F.col("total"))


def key_types(
    events: DataFrame, col: str = "event_json", group: Sequence[str] = (), style: str = "neutral"
) -> DataFrame:
    """Per key and value type: how often."""
    pairs = events.select(*group, F.explode(js.fields(_event(events, col))).alias("key", "value"))
    typed = pairs.select(*group, "key", js.type_name(F.col("value"), style).alias("type"))
    return typed.groupBy(*group, "key", "type").agg(F.count("*").alias("n"))


def key_set_variants(
    events: DataFrame, col: str = "event_json", group: Sequence[str] = (), top: int = 10
) -> DataFrame:
    """The ``top`` most frequent key sets; equal counts go by the keys."""
    keys = F.array_sort(F.map_keys(js.fields(_event(events, col))))
    counts = (
        events.select(*group, keys.alias("keys"))
        .filter(F.col("keys").isNotNull())
        .groupBy(*group, "keys")
        .agg(F.count("*").alias("n"))
    )
    if not group:
        return counts.orderBy(F.desc("n"), "keys").limit(top)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "keys"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank")


def batch_analysis(events: DataFrame, col: str = "event_json", group: Sequence[str] = ("source",)) -> DataFrame:
    """One row per group: count, common and optional keys, types per key, variants.

    Every group has a row, also the null one and those without a single object, whose lists are empty. The lists
    collected here hold distinct keys, types and at most ten variants, not events.
    """
    names = list(group)
    totals = events.groupBy(*names).agg(F.count("*").alias("count"))
    presence = key_presence(events, col, names).groupBy(*names).agg(
        F.array_sort(F.collect_list(F.when(F.col("common"), F.col("key")))).alias("common_keys"),
        F.array_sort(F.collect_list(F.when(~F.col("common"), F.col("key")))).alias("optional_keys"))
    types = (
        key_types(events, col, names)
        .groupBy(*names, "key")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
        .groupBy(*names)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            "key", F.map_entries("types").alias("e"))))).alias("types"))
    )
    variants = key_set_variants(events, col, names).groupBy(*names).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "keys"))),
            lambda v: F.struct(v["keys"].alias("keys"), (-v["minus"]).alias("count"))).alias("variants"))
    joined = totals
    for part in (presence, types, variants):
        joined = ranking.join_on(joined, part, names, "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *names, "count", F.coalesce("common_keys", none).alias("common_keys"),
        F.coalesce("optional_keys", none).alias("optional_keys"),
        F.coalesce("types", F.create_map().cast(types.schema["types"].dataType)).alias("types"),
        F.coalesce("variants", F.array().cast(variants.schema["variants"].dataType)).alias("variants"))


def even_sample(
    events: DataFrame, order: str = "event_id", group: Sequence[str] = ("source",), size: int = 15
) -> DataFrame:
    """Up to ``size`` events spread evenly over each group, with ``position`` and ``total``."""
    return ranking.evenly_spaced(events, order, group, size)


def head_sample(
    events: DataFrame, order: str = "event_id", group: Sequence[str] = ("source",), size: int = 15
) -> DataFrame:
    """The first ``size`` events of each group.

    Spark turns the rank filter into a limit per map task, so only ``size`` rows of a group per
    task are shuffled.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return events.withColumn("position", rank).filter(F.col("position") <= size)


def batch_prompts(
    events: DataFrame, col: str = "event_json", order: str = "event_id", group: Sequence[str] = ("source",),
    size: int = 15, template: str = BATCH_TEMPLATE,
) -> DataFrame:
    """One request text per group: the event count and the evenly sampled events, one per line."""
    sampled = even_sample(events, order, group, size)
    row = F.struct("position", js.compact_text(F.col(col)).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"])
    packed = sampled.groupBy(*group).agg(F.max("total").alias("events"), F.array_join(lines, "\n").alias("block"))
    head, rest = template.split("{count}")
    middle, tail = rest.split("{events_block}")
    text = F.concat(F.lit(head), F.col("events").cast("string"), F.lit(middle), F.col("block"), F.lit(tail))
    return packed.select(*group, "events", text.alias("prompt"))


def field_profile(rows: DataFrame, id_col: str = "event_id", col: str = "event_json") -> DataFrame:
    """Per event field: type, preview and a hint at how to parse it.

    Text that is no JSON object gives one ``message`` row. Hints are short names: json, syslog,
    key_value, csv, date, long.
    """
    event = _event(rows, col)
    members = F.transform(
        F.map_entries(js.fields(event)), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value")))
    fallback = F.array(F.struct(F.lit("message").alias("field"), F.lit(None).cast("variant").alias("value")))
    is_object = F.col("__members").isNotNull()
    opened = rows.select(id_col, F.col(col).cast("string").alias("__text"), members.alias("__members")).select(
        id_col, "__text", is_object.alias("__object"),
        F.explode(F.coalesce(F.col("__members"), fallback)).alias("__f"))
    value = F.col("__f.value")
    typed = opened.select(
        id_col, "__text", "__object", F.col("__f.field").alias("field"),
        F.when(F.col("__object"), js.type_name(value, "display")).otherwise("string").alias("type"),
        js.text_of(value).alias("__value"))
    text = F.col("__value")
    written = F.when(F.col("type").isin("object", "array"), js.member_text(F.col("__text"), F.col("field")))
    shown = F.coalesce(written, text)
    trimmed = tx.strip(text)
    preview = (
        F.when(~F.col("__object"), F.substring("__text", 1, 120))
        .when((F.col("type") == "string") & (F.length(shown) > 80), F.concat(F.substring(shown, 1, 80), F.lit("...")))
        .when(F.col("type") == "null", "null")
        .otherwise(F.substring(shown, 1, 80))
    )
    hint = (
        F.when(trimmed.startswith("{") | trimmed.startswith("["), "json")
        .when(trimmed.rlike(r"^<\d+>"), "syslog")
        .when(trimmed.contains("=") & trimmed.contains(" "), "key_value")
        .when(trimmed.contains(",") & ~trimmed.contains("="), "csv")
        .when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}"), "date")
        .when(F.length(trimmed) > 50, "long")
    )
    hinted = F.when(F.col("__object") & (F.col("type") == "string"), hint)
    return typed.select(id_col, "field", "type", preview.alias("preview"), hinted.alias("hint"))
