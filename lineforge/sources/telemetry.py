"""Metric samples from the documents monitoring targets give out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sample name -> member of one node's statistics.
NODE_VALUES = {
    "packets_total": "totalPackets", "packets_dropped": "totalDropped", "packets_overload": "totalOverloadDropped",
    "sessions_total": "totalSessions", "es_dropped": "totalES", "es_health_ms": "esHealthMS",
    "deltaPacketsPerSec": "deltaPacketsPerSec", "deltaDroppedPerSec": "deltaDroppedPerSec",
    "deltaOverloadPerSec": "deltaOverloadDroppedPerSec", "deltaSessionsPerSec": "deltaSessionsPerSec",
    "deltaESDroppedPerSec": "deltaESDroppedPerSec", "memory": "memory", "cpu": "cpu", "disk_queue": "diskQueue",
    "suricataAlerts": "suricataAlerts", "suricataMatches": "suricataMatches",
}
# Numbers of a cluster's health; its status word becomes 0, 1 or 2.
HEALTH_VALUES = ["active_shards", "unassigned_shards", "number_of_nodes", "number_of_data_nodes"]
STATUS_NUMBERS = {"green": 0.0, "yellow": 1.0, "red": 2.0}


def _long_form(rows: DataFrame, keep: list[Column], prefix: str, values: Mapping[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f"{prefix}_{n}").alias("metric"), v.cast("double").alias("value"))
                      for n, v in values.items()])
    return rows.select(*keep, F.inline(cells)).filter(F.col("value").isNotNull())


def unpivot_stats(documents: DataFrame, col: str = "body", prefix: str = "arkime_total_packets") -> DataFrame:
    """``{"data": [{"nodeName": ...}, ...]}`` documents as samples labelled by node."""
    members = ", ".join(f"`{m}`: double" for m in NODE_VALUES.values())
    schema = f"struct<data: array<struct<nodeName: string, {members}>>>"
    nodes = documents.select("ts", F.explode(F.from_json(col, F.lit(schema))["data"]).alias("n"))
    values = {name: F.col(f"n.{member}") for name, member in NODE_VALUES.items()}
    return _long_form(nodes, [F.col("ts"), F.col("n.nodeName").alias("node")], prefix, values)


def health_samples(documents: DataFrame, col: str = "body", prefix: str = "arkime_es_health") -> DataFrame:
    """Cluster-health documents as samples."""
    schema = "status string, " + ", ".join(f"{n} double" for n in HEALTH_VALUES)
    parsed = documents.select("ts", F.from_json(col, F.lit(schema)).alias("h"))
    status = None
    for word, number in STATUS_NUMBERS.items():
        test = F.lower("h.status") == word
        status = F.when(test, number) if status is None else status.when(test, number)
    values = {"status": status, **{n: F.col(f"h.{n}") for n in HEALTH_VALUES}}
    return _long_form(parsed, [F.col("ts")], prefix, values)


def state_gauges(lines: DataFrame, col: str = "line") -> DataFrame:
    """RAID state listings as 0/1 gauges, per snapshot (ts, host).

    The controller is healthy if its one ``State`` line says ``Optimal`` in the third word; each
    volume line gives a gauge labelled by volume. A snapshot without state is unhealthy.
    """
    words = F.split(F.btrim(F.col(col)), r"\s+")
    third = F.try_element_at(words, F.lit(3))
    is_state = F.col(col).startswith("State")
    read = lines.select("ts", "host", words[0].alias("head"), third.alias("third"), is_state.alias("is_state"))
    controller = read.groupBy("ts", "host").agg(
        F.count_if("is_state").alias("n"), F.max(F.when(F.col("is_state"), F.col("third"))).alias("state")).select(
        "ts", "host", F.lit("raid_cachevault_healthy").alias("metric"), F.lit(None).cast("string").alias("vd"),
        F.when((F.col("n") == 1) & (F.col("state") == "Optimal"), 1.0).otherwise(0.0).alias("value"))
    volumes = read.filter(F.col("head").rlike(r"^[0-9]+/[0-9]+")).select(
        "ts", "host", F.lit("raid_vd_optimal").alias("metric"), F.col("head").alias("vd"),
        F.when(F.col("third") == "Optl", 1.0).otherwise(0.0).alias("value"))
    return controller.unionByName(volumes)


def scan_exposition(lines: DataFrame, col: str = "line") -> DataFrame:
    """Text metric lines ``name{label="value"} number [millis]``; comments are skipped.

    A line that does not parse is dropped, as a comment is; so is one whose time is outside the years 1 to 9999.
    """
    pattern = r'\s*([a-zA-Z_:][a-zA-Z0-9_:]*)\s*(?:\{(.*)\})?\s*(\S+)(?:\s+(-?\d+))?\s*'
    label = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:[^"\\]++|\\.)*+)"'
    text = F.col(col)
    whole = rf"\A{pattern}\z"
    inside = F.regexp_extract(text, whole, 2)

    def plain(v: Column) -> Column:
        # Escapes: \\ \" \n
        marked = F.regexp_replace(v, r"\\\\", "\x00")
        opened = F.replace(F.replace(marked, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
        return F.replace(opened, F.lit("\x00"), F.lit("\\"))

    names = F.regexp_extract_all(inside, F.lit(label), F.lit(1))
    values = F.transform(F.regexp_extract_all(inside, F.lit(label), F.lit(2)), plain)
    number = F.regexp_extract(text, whole, 3)
    word = F.lower(number)
    value = (
        F.when(word.isin("+inf", "inf"), float("inf")).when(word == "-inf", float("-inf"))
        .when(word == "nan", float("nan")).otherwise(number.try_cast("double")))
    stamp = F.regexp_extract(text, whole, 4)
    at = stamp.try_cast("long")
    at = F.when(at.between(-62_135_596_800_000, 253_402_300_799_999), at)
    kept = lines.filter(~text.startswith("#") & text.rlike(whole) & ((stamp == "") | at.isNotNull()))
    rest = [c for c in lines.columns if c != col]
    return kept.select(
        *rest, F.regexp_extract(text, whole, 1).alias("metric"), F.map_from_arrays(names, values).alias("labels"),
        value.alias("value"), F.timestamp_millis(at).alias("sample_ts")).filter(F.col("value").isNotNull())
