"""Event profiles and exact ranks against plain Python."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lineforge.operators import profiling, ranking
from lineforge.session import materialize

EVENTS = [
    {"a": 1, "b": "x"}, {"a": 1.5, "b": None}, {"a": True, "c": [1]}, {"a": {"k": 1}}, {}, [1, 2], "text", None,
    {"a": 2.0, "b": "y"}, {"b": "z", "a": 12345678901234567890},
]
NAMES = {bool: "bool", int: "int", float: "float", str: "string", list: "array", dict: "object", type(None): "null"}


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, "s1" if i % 2 else "s2", json.dumps(e)) for i, e in enumerate(EVENTS)]
    return spark.createDataFrame(rows, "event_id long, source string, event_json string")


def test_presence_and_totals(events):
    objects = [e for e in EVENTS if isinstance(e, dict)]
    keys = Counter(k for e in objects for k in e)
    rows = profiling.key_presence(events).collect()
    assert {r["key"]: r["present"] for r in rows} == dict(keys)
    assert {r["total"] for r in rows} == {len(EVENTS)} and not any(r["common"] for r in rows)
    rows = profiling.key_presence(events, count_non_objects=False).collect()
    assert {r["total"] for r in rows} == {len(objects)}


def test_types(events):
    wanted = Counter((k, NAMES[type(v)]) for e in EVENTS if isinstance(e, dict) for k, v in e.items())
    assert {(r["key"], r["type"]): r["n"] for r in profiling.key_types(events).collect()} == dict(wanted)
    script = {r["type"] for r in profiling.key_types(events, style="script").collect()}
    assert script == {"number", "string", "boolean", "object", "null"}


def test_key_sets(events):
    wanted = Counter(tuple(sorted(e)) for e in EVENTS if isinstance(e, dict))
    rows = profiling.key_set_variants(events).collect()
    assert {tuple(r["keys"]): r["n"] for r in rows} == dict(wanted)
    assert [r["n"] for r in rows] == sorted((r["n"] for r in rows), reverse=True)
    assert sum(r["n"] for r in rows) == sum(isinstance(e, dict) for e in EVENTS)
    assert profiling.key_set_variants(events, top=2).count() == 2


@pytest.mark.parametrize("size", [1, 14, 15, 16, 29, 31, 100, 1000])
def test_even_sample(spark, size):
    rows = spark.range(size).select((F.col("id") * 7 + 3).alias("event_id"), F.lit("s").alias("source"))
    step = max(1, size // 15)
    wanted = [i * 7 + 3 for i in range(0, size, step)][:15]
    got = sorted(r["event_id"] for r in profiling.even_sample(rows).collect())
    assert got == wanted


def test_positions_with_outliers_and_hot_group(spark):
    """Clustered orders, one far outlier, and one group that holds most rows."""
    rng = random.Random(5)
    orders = rng.sample(range(20_000), 3_000) + [10**15]
    data = [(o, "hot" if rng.random() < 0.7 else rng.choice(["a", None])) for o in orders]
    rows = spark.createDataFrame(data, "o long, g string")
    got = {(r["g"], r["o"]): r["position"] for r in ranking.positions(rows, "o", ["g"], bits=3).collect()}
    for group in ("hot", "a", None):
        members = sorted(o for o, g in data if g == group)
        assert [got[group, o] for o in members] == list(range(1, len(members) + 1))
    flat = ranking.positions(rows.drop("g"), "o").orderBy("position").collect()
    assert [r["o"] for r in flat] == sorted(orders)


def test_clustered_orders_stay_balanced(spark):
    """Values that crowd near zero: no range holds much more than its share of the rows."""
    rows = spark.range(100_000).selectExpr("cast(pow(10, id / 9000.0) as long) * 100000 + id AS o", "'g' AS g")
    _, sizes = ranking._ranged(rows, ["g"], "o", 4)
    counts = [r["__n"] for r in sizes.collect()]
    assert len(counts) > 200 and max(counts) < 2 * 100_000 / 256


def test_rows_of_equal_order(spark):
    """Rows that share order and ties each have a place of their own, and as many come out as are wanted."""
    rows = spark.createDataFrame([(i // 4, i % 2, f"text {i}") for i in range(40)], "o long, t long, text string")
    got = ranking.evenly_spaced(rows, "o", size=20, ties=["t"]).collect()
    assert sorted(r["position"] for r in got) == list(range(1, 40, 2)) and len({r["text"] for r in got}) == 20
    ordered = sorted((i // 4, i % 2) for i in range(40))
    assert all((r["o"], r["t"]) == ordered[r["position"] - 1] for r in got)
    assert len(ranking.evenly_spaced(rows.withColumn("o", F.lit(None).cast("long")), "o").collect()) == 15
    assert ranking.evenly_spaced(rows.where("false"), "o").collect() == []


def exchanged(df):
    """The columns that any shuffle of the plan moves, before rows were fetched by a broadcast."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) (?:Exchange|Sort|SortAggregate)\nInput \[\d+\]: (.*)", plan)


def test_texts_are_fetched_late(spark, events):
    stored = materialize(events, "events")
    plan = exchanged(profiling.even_sample(stored))
    assert [x for x in plan if "event_json" in x and "__places" not in x] == []


def test_prompts(events):
    rows = {r["source"]: r for r in profiling.batch_prompts(events).collect()}
    assert rows["s2"]["events"] == 5
    body = '{"a":1,"b":"x"}\n{"a":true,"c":[1]}\n{}\n"text"\n{"a":2.0,"b":"y"}'
    assert body in rows["s2"]["prompt"] and rows["s2"]["prompt"].startswith("I am providing you with 5 sample events")


def test_field_profile(spark):
    long = "w" * 90
    event = {"j": "[1]", "s": "<34>x", "kv": "a=1 b=2", "c": "a,b", "d": "2024-01-01", "l": long, "n": None, "o": {"z": 1, "a": [2]},
             "f": 1.50, "t": True}
    rows = spark.createDataFrame([(1, json.dumps(event)), (2, "p" * 200), (3, "[1]")], "event_id long, event_json string")
    got = {(r["event_id"], r["field"]): (r["type"], r["preview"], r["hint"]) for r in profiling.field_profile(rows).collect()}
    assert got[1, "j"] == ("string", "[1]", "json") and got[1, "s"][2] == "syslog" and got[1, "kv"][2] == "key_value"
    assert got[1, "c"][2] == "csv" and got[1, "d"][2] == "date" and got[1, "l"] == ("string", "w" * 80 + "...", "long")
    assert got[1, "n"] == ("null", "null", None) and got[1, "o"] == ("object", '{"z":1,"a":[2]}', None)
    assert got[1, "f"] == ("number", "1.5", None) and got[1, "t"] == ("boolean", "true", None)
    assert got[2, "message"] == ("string", "p" * 120, None) and got[3, "message"] == ("string", "[1]", None)
