"""Parsed events to OCSF columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event classes and the category each belongs to. An unknown class is 0, category 0.
CLASS_CATEGORY = {4001: 4, 4002: 4, 3001: 3, 1001: 1, 6003: 6}
# Fixed value: schema version.
OCSF_VERSION = "1.1.0"
# Severity ids are 0 unknown, 1 informational, 2 low, 3 medium, 4 high, 5 critical,
# 6 fatal; the words are those the log formats use.
SEVERITY_IDS = {
    "debug": 1, "info": 1, "informational": 1, "notice": 2, "low": 2, "warn": 3, "warning": 3, "medium": 3,
    "err": 4, "error": 4, "high": 4, "crit": 5, "critical": 5, "alert": 5, "emerg": 6, "fatal": 6,
}
# Class and activity per detected line format.
FORMAT_CLASS = {"syslog": (1001, 1), "access": (4002, 1), "json": (3001, 99), "app": (6003, 99),
                "key_value": (6003, 99), "csv": (4002, 1)}


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0))


def severity_id(word: Column) -> Column:
    return _lookup(SEVERITY_IDS, F.lower(word))


def _text(value: Column | None) -> Column:
    return F.lit(None).cast("string") if value is None else value.cast("string")


def ocsf_map(
    rows: DataFrame, class_uid: Column, activity_id: Column, severity: Column | None = None,
    product: Column | None = None, vendor: Column | None = None, time: Column | None = None,
    src_ip: Column | None = None, dst_ip: Column | None = None, user: Column | None = None,
    http_method: Column | None = None, url_path: Column | None = None,
) -> DataFrame:
    """Adds ids, epoch-millisecond time and the nested product, endpoint, actor and request structs.

    The class table is five entries in the plan, not a join. A class it lacks maps to 0.
    """
    category = _lookup(CLASS_CATEGORY, class_uid)
    known = F.when(category > 0, class_uid).otherwise(0).cast("int")
    activity = F.when(category > 0, F.coalesce(activity_id, F.lit(0))).otherwise(0).cast("int")
    stamp = F.lit(None).cast("timestamp") if time is None else time
    return rows.select(
        "*", known.alias("class_uid"), category.cast("int").alias("category_uid"), activity.alias("activity_id"),
        (known * 100 + activity).cast("int").alias("type_uid"),
        (F.lit(0) if severity is None else severity_id(severity)).cast("int").alias("severity_id"),
        F.unix_millis(stamp).alias("time"),
        F.struct(
            F.struct(_text(product).alias("name"), _text(vendor).alias("vendor_name")).alias("product"),
            F.lit(OCSF_VERSION).alias("version")).alias("metadata"),
        F.struct(_text(src_ip).alias("ip")).alias("src_endpoint"),
        F.struct(_text(dst_ip).alias("ip")).alias("dst_endpoint"),
        F.struct(F.struct(_text(user).alias("name")).alias("user")).alias("actor"),
        F.struct(
            _text(http_method).alias("http_method"),
            F.struct(_text(url_path).alias("path")).alias("url")).alias("http_request"))


def ocsf_from_mixed(parsed: DataFrame) -> DataFrame:
    """OCSF columns for the output of ``parse_mixed``."""
    def by_format(position: int) -> Column:
        return _lookup({name: ids[position] for name, ids in FORMAT_CLASS.items()}, F.col("format"))

    return ocsf_map(
        parsed, by_format(0), by_format(1), severity=F.coalesce("level", F.lit("info")), product=F.col("service"),
        time=F.col("timestamp"), src_ip=F.col("client_ip"), http_method=F.col("method"), url_path=F.col("path"))
