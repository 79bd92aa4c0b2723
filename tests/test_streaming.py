"""Streams give what the batch plans give, also across restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lineforge.operators import alerts, library, metrics, parsing
from lineforge.plans.views import Views, with_lines
from lineforge.session import scratch_path
from lineforge.streaming import streams

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split_events(spark):
    """Events as several files by time, so that a stream takes several batches."""
    path = scratch_path(spark, "split-events")
    events = Views(spark, FOLDER).table("events")
    for part in range(4):
        events.filter(F.floor(F.col("event_id") / 250) == part).coalesce(1).write.mode("append").parquet(path)
    return path, events


def stream_of(spark, split_events, per_batch=1):
    path, events = split_events
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def drain(spark, stream, name, partition_by=()):
    path = scratch_path(spark, name)
    streams.start_file_sink(stream, f"{path}/out", f"{path}/checkpoint", partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out"), path


def same(left, right):
    maps = {f.name: F.to_json(F.array_sort(F.map_entries(f.name))) for f in left.schema if f.dataType.typeName() == "map"}
    left, right = left.withColumns(maps), right.select(*left.columns).withColumns(maps)
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_parse(spark, split_events):
    lines = with_lines(stream_of(spark, split_events))
    got, path = drain(spark, streams.stream_parse(lines, year=2024), "parse", ("route",))
    batch = parsing.parse_mixed(with_lines(split_events[1]), year=2024)
    same(batch, got)
    # A restart from the same checkpoint finds nothing new.
    streams.start_file_sink(
        streams.stream_parse(with_lines(stream_of(spark, split_events)), year=2024), f"{path}/out", f"{path}/checkpoint",
        ("route",)).awaitTermination()
    assert spark.read.parquet(f"{path}/out").count() == 1000


def test_route(spark, split_events):
    parsers = Views(spark, FOLDER).parsers()
    got, _ = drain(spark, streams.stream_route(with_lines(stream_of(spark, split_events)), parsers), "route")
    same(library.route_lines(with_lines(split_events[1]), parsers), got)


def test_late_rows_are_dropped(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "line_id long, source string, raw string, ts timestamp"
    batches = [[(1, "s", "a 1", start), (2, "s", "a 2", start + dt.timedelta(hours=3))],
               [(4, "s", "a 4", start + dt.timedelta(hours=3))],
               [(3, "s", "a 3", start + dt.timedelta(minutes=1))],
               [(5, "s", "a 5", start + dt.timedelta(hours=9))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got, _ = drain(spark, streams.stream_signatures(lines), "late")
    rows = {r["window_start"]: r["lines"] for r in got.collect()}
    assert rows == {start: 1, start + dt.timedelta(hours=3): 2}


ALERT_SCHEMA = "instance string, ts timestamp, value double"
T0 = dt.datetime(2024, 1, 1)


def arriving(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, ALERT_SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ALERT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def alerts_of_table(spark, rows, step_s, lookback_s, for_s, watermark=dt.timedelta(minutes=10)):
    """The batch operators over all rows, as far as the watermark has come."""
    table = spark.createDataFrame(rows, ALERT_SCHEMA)
    grid = metrics.eval_grid(table, ["instance"], step_s, lookback_s)
    states = alerts.alert_states(grid, ["instance"], F.col("value") > 10, for_s, step_s)
    last = max(ts for _, ts, _ in rows) - dt.timedelta(microseconds=1) - watermark
    return states.where(F.col("ts") <= F.lit(last))


def test_alerts_equal_the_batch_on_shuffled_arrival(spark, tmp_path):
    """Rows come up to six minutes late, some of equal times, with gaps longer and shorter than the look-back."""
    rng, rows = random.Random(3), []
    for i in range(500):
        seconds = rng.choice([30 * i, 30 * i + rng.randrange(30)])
        rows.append((rng.choice("abc"), T0 + dt.timedelta(seconds=seconds), float(rng.randrange(20)) if i % 100 > 40 else 18.0))
    rows += [("d", T0 + dt.timedelta(seconds=60), v) for v in (19.0, 3.0)]
    order = sorted(rows, key=lambda r: (r[1] - T0).total_seconds() + rng.random() * 360)
    samples = arriving(spark, tmp_path, [order[k:k + 60] for k in range(0, len(order), 60)])
    states = streams.stream_alerts(samples, ["instance"], F.col("value") > 10, for_s=120, step_s=30, lookback_s=90)
    got, _ = drain(spark, states, "alerts")
    wanted = alerts_of_table(spark, rows, 30, 90, 120)
    same(wanted, got)
    assert {r["state"] for r in got.select("state").distinct().collect()} == {"firing", "pending", "inactive"}


def test_silent_series_are_judged_by_timers(spark, tmp_path):
    """A series that stops reporting holds for the look-back, then goes; when it comes back it starts anew."""
    hours = [[("a", 0), ("b", 0)], [("b", 1)], [("b", 2)], [("a", 3), ("b", 3)], [("b", 4)], [("b", 5)]]
    rows = [[(i, T0 + dt.timedelta(hours=h), 18.0) for i, h in part] for part in hours]
    states = streams.stream_alerts(
        arriving(spark, tmp_path, rows), ["instance"], F.col("value") > 10, for_s=600, step_s=300, lookback_s=900)
    got, _ = drain(spark, states, "silent")
    same(alerts_of_table(spark, [r for part in rows for r in part], 300, 900, 600), got)
    of_a = {(r["ts"] - T0).total_seconds() / 60: (r["state"], r["active_since"]) for r in got.collect() if r["instance"] == "a"}
    back = T0 + dt.timedelta(hours=3)
    assert of_a == {0: ("pending", T0), 5: ("pending", T0), 10: ("firing", T0), 15: ("firing", T0),
                    180: ("pending", back), 185: ("pending", back), 190: ("firing", back), 195: ("firing", back)}


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_path):
    minute = lambda m, value: ("a", T0 + dt.timedelta(minutes=m), value)
    batches = [[minute(0, 18.0)], [minute(60, 18.0)], [minute(61, 18.0)], [minute(1, 5.0), minute(55, 5.0)], [minute(120, 1.0)]]
    states = streams.stream_alerts(
        arriving(spark, tmp_path, batches), ["instance"], F.col("value") > 10, for_s=60, step_s=60, lookback_s=60)
    got, _ = drain(spark, states, "too-late")
    kept = [r for part in batches for r in part if r != minute(1, 5.0)]
    same(alerts_of_table(spark, kept, 60, 60, 60), got)
