"""Column expressions over JSON text, held as ``VARIANT`` so that no schema is fixed up front."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = "map<string,variant>"


def fields(event: Column) -> Column:
    """Top-level members of a variant object as a map; null for arrays, scalars and bad JSON."""
    return F.try_variant_get(event, "$", PAIRS)


def type_name(value: Column, style: str = "neutral") -> Column:
    """Short type of a variant value.

    ``neutral`` gives null/bool/int/float/string/array/object, ``script`` folds these to the five
    names of a scripting runtime, ``display`` is the same but tells arrays from objects.
    """
    schema = F.schema_of_variant(value)
    # Whole numbers too long for 64 bits become decimals; so does 39.00, but short and a float.
    integral = (schema == "BIGINT") | schema.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    neutral = (
        F.when(value.isNull() | (schema == "VOID"), "null")
        .when(schema == "BOOLEAN", "bool")
        .when(integral, "int")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("string")
    )
    if style == "neutral":
        return neutral
    if style not in ("script", "display"):
        raise ValueError(f"unknown type style {style!r}")
    array_name = "array" if style == "display" else "object"
    return (
        F.when(neutral == "bool", "boolean")
        .when(neutral.isin("int", "float"), "number")
        .when(neutral == "array", array_name)
        .otherwise(neutral)
    )


def text_of(value: Column) -> Column:
    """Variant as text: strings bare, JSON null as null, everything else as JSON.

    Objects come out with their keys in order and numbers without trailing zeros.
    """
    schema = F.schema_of_variant(value)
    return (
        F.when(schema == "STRING", F.try_variant_get(value, "$", "string"))
        .when(schema != "VOID", F.to_json(value)))


def member_text(text: Column, key: Column) -> Column:
    """Compact JSON of one top-level member, its own members in the order they were written."""
    return F.call_function("get_json_object", text, F.concat(F.lit("$['"), key, F.lit("']")))


def compact_text(text: Column) -> Column:
    """JSON text without white space between tokens; members keep their order."""
    return F.regexp_replace(text, r'("(?:[^"\\]++|\\.)*+")|\s+', "$1")
