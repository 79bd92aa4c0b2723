"""Rates, grids, alert states and the rule set against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lineforge.operators import alerts, metrics
from lineforge.sources import telemetry

T0 = dt.datetime(2024, 1, 1)
SAMPLES = "ts timestamp, metric string, job string, instance string, labels map<string,string>, value double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def series(spark, points, metric="m", instance="i"):
    """Points are (seconds, value)."""
    rows = [(at(s), metric, "j", instance, {}, float(v)) for s, v in points]
    return spark.createDataFrame(rows, SAMPLES)


@pytest.fixture(scope="module")
def counter():
    """A counter with resets, gaps, and samples on either side of bucket edges."""
    rng, points, value, now = random.Random(1), [], 0.0, 0.0
    for _ in range(800):
        now += rng.choice([5, 15, 15, 30, 400, 900])
        value = 0.0 if rng.random() < 0.05 else value + rng.randint(0, 9)
        points.append((now, value))
    return points


def plain_rise(window):
    return sum(b if b < a else b - a for (_, a), (_, b) in zip(window, window[1:]))


def test_rate_equals_python(spark, counter):
    wanted = {}
    for s, _ in counter:
        window = [p for p in counter if s - 300 <= p[0] <= s]
        if window[-1][0] > window[0][0]:
            wanted[at(s)] = plain_rise(window) / (window[-1][0] - window[0][0])
    for bucket in (None, 600):
        rows = metrics.counter_rate(series(spark, counter), ["instance"], 300, bucket_s=bucket).collect()
        assert {r["ts"]: pytest.approx(r["rate"]) for r in rows} == wanted


def test_dense_series_is_linear(spark):
    """200,000 samples in one window: a sum anew for each row would take 10^10 steps."""
    n = 200_000
    dense = spark.range(n).selectExpr(
        "timestamp_micros(1704067200000000 + id * 1000) AS ts", "'i' AS instance", "cast(id % 1000 as double) AS value")
    got = metrics.counter_rate(dense, ["instance"], 300).orderBy(F.desc("ts")).limit(1).first()
    resets, steps = n // 1000 - 1, n - n // 1000
    assert got["rate"] == pytest.approx((steps + 0 * resets) / ((n - 1) / 1000))


def test_samples_of_one_time(spark):
    """Equal times: a rate counts them all, the grid takes the largest value."""
    twice = series(spark, [(0, 1), (0, 3), (10, 4), (10, 2), (20, 7)])
    rates = {r["ts"]: r["rate"] for r in metrics.counter_rate(twice, ["instance"], 60).collect()}
    assert rates[at(20)] == pytest.approx((2 + 2 + 2 + 3) / 20)
    grid = metrics.eval_grid(twice, ["instance"], 10, 5).collect()
    assert {r["ts"]: r["value"] for r in grid} == {at(0): 3, at(10): 4, at(20): 7}


@pytest.mark.parametrize("extrapolate", [False, True])
def test_grid_rate_equals_python(spark, counter, extrapolate):
    wanted = {}
    for t in range(0, int(counter[-1][0]) + 400, 30):
        window = [p for p in counter if t - 300 <= p[0] <= t]
        if len(window) < 2:
            continue
        span, rise = window[-1][0] - window[0][0], plain_rise(window)
        if extrapolate:
            gap, left, right = span / (len(window) - 1), window[0][0] - (t - 300), t - window[-1][0]
            left = gap / 2 if left >= gap * 1.1 else left
            if rise > 0 and window[0][1] >= 0:
                left = min(left, span * window[0][1] / rise)
            right = gap / 2 if right >= gap * 1.1 else right
            wanted[at(t)] = rise * (span + left + right) / span / 300
        else:
            wanted[at(t)] = rise / span
    rows = metrics.grid_rate(series(spark, counter), ["instance"], 30, 300, extrapolate=extrapolate, bucket_s=900).collect()
    assert {r["ts"]: pytest.approx(r["rate"]) for r in rows} == wanted


def test_grid_values_equal_python(spark, counter):
    wanted = {}
    for t in range(0, int(counter[-1][0]) + 400, 30):
        seen = [p for p in counter if t - 300 <= p[0] <= t]
        if seen:
            wanted[at(t)] = seen[-1][1]
    rows = metrics.eval_grid(series(spark, counter), ["instance"], 30, 300).collect()
    assert {r["ts"]: r["value"] for r in rows} == wanted and len(rows) == len(wanted)


def test_one_sample_gives_no_rate(spark):
    assert metrics.counter_rate(series(spark, [(0, 1), (400, 5)]), ["instance"], 300).count() == 0


def test_ratios(spark):
    rows = series(spark, [(0, 1), (30, 5), (60, 0)], "num").unionByName(series(spark, [(0, 4), (30, 0), (60, 0), (90, 1)], "den"))
    got = {r["ts"]: r["ratio"] for r in metrics.gauge_ratio(rows, ["instance"], "num", "den").collect()}
    assert got[at(0)] == 0.25 and got[at(30)] == math.inf and math.isnan(got[at(60)]) and len(got) == 3
    got = {r["ts"]: r["ratio"] for r in metrics.match_ratio(rows, ["instance"], "num", "den").collect()}
    assert got == {at(0): 0.25, at(30): 5.0, at(60): 0.0}


def test_selection_is_anchored(spark):
    rows = spark.createDataFrame([
        (T0, "m", "j", "i", {"mountpoint": p} if p else {}, 1.0) for p in ("/data/pcap1", "/data/pcap12/x", None)], SAMPLES)
    assert metrics.metric_select(rows, "m", match={"mountpoint": "/data/pcap[0-9]+"}).count() == 1
    assert metrics.metric_select(rows, "m", equal={"mountpoint": ""}).count() == 1
    assert metrics.metric_select(rows, "other").count() == 0


def test_relabel_and_rollup(spark):
    rows = spark.createDataFrame([(T0, "m", "j", "i", {"a": "1", "b": "2"}, 1.0)], SAMPLES)
    row = metrics.relabel(rows, copy={"c": "a", "d": "c", "x": "none"}, constant={"b": "9"}).first()
    assert row["labels"] == {"a": "1", "b": "9", "c": "1", "d": "1"}
    wide = spark.createDataFrame([(1, "t1", 2.0), (1, "t2", 3.0), (2, "t1", 4.0)], "k int, thread string, value double")
    assert {r["k"]: r["value"] for r in metrics.totals_rollup(wide, "thread").collect()} == {1: 5.0, 2: 4.0}
    assert tuple(metrics.series_count(wide, ["k", "thread"], "thread").first()) == (3, 2)


def test_retention(spark):
    rows = series(spark, [(0, 1), (86_400, 2), (86_400 * 30, 3), (86_400 * 31, 4)])
    assert sorted(r["value"] for r in metrics.series_retention(rows, 30).collect()) == [3.0, 4.0]


def test_stored_retention_reads_the_border_day_only(spark, tmp_path):
    day = 86_400
    points = [(0, 1), (day - 1, 2), (day, 3), (day + 100, 4), (2 * day + 5, 5), (3 * day + 50, 6)]
    metrics.write_recorded(series(spark, points).select("metric", "instance", "ts", "value").coalesce(1), str(tmp_path))
    files = lambda: {p.parent.name: p.name for p in tmp_path.glob("day=*/*.parquet")}
    first = files()
    metrics.retain_recorded(spark, str(tmp_path), days=2)
    left = files()
    assert sorted(left) == ["day=2024-01-02", "day=2024-01-03", "day=2024-01-04"]
    assert left["day=2024-01-02"] != first["day=2024-01-02"]
    assert {d: left[d] for d in ("day=2024-01-03", "day=2024-01-04")} == {d: first[d] for d in ("day=2024-01-03", "day=2024-01-04")}
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path)).collect()) == [4.0, 5.0, 6.0]
    metrics.retain_recorded(spark, str(tmp_path), days=2)
    assert spark.read.parquet(str(tmp_path)).count() == 3
    metrics.retain_recorded(spark, str(tmp_path), days=1, now=at(3 * day + 3000))
    assert sorted(files()) == ["day=2024-01-04"]
    metrics.retain_recorded(spark, str(tmp_path), days=1, now=at(90 * day))
    assert files() == {}
    metrics.retain_recorded(spark, str(tmp_path), days=1)


def test_states_for_met_exactly_gap_and_false(spark):
    truth = [(0, 1), (30, 1), (60, 1), (90, 0), (120, 1), (180, 1), (210, 1), (240, 1)]
    got = alerts.alert_states(series(spark, truth), ["instance"], F.col("value") > 0, 60).orderBy("ts").collect()
    assert [r["state"] for r in got] == [
        "pending", "pending", "firing", "inactive", "pending", "pending", "pending", "firing"]
    assert [r["active_since"] for r in got] == [at(0)] * 3 + [None, at(120)] + [at(180)] * 3


def test_ruleset(spark):
    down = [(s, 0 if 60 <= s < 600 else 1) for s in range(0, 900, 30)]
    drops = [(s, s * 0.01) for s in range(0, 1500, 15)]
    packets = [(s, s * 4.0) for s in range(0, 1500, 15)]
    rows = series(spark, down, "up", "n1").unionByName(series(spark, drops, "suricata_capture_kernel_drops_total", "n2"))
    rows = rows.unionByName(series(spark, packets, "suricata_capture_kernel_packets_total", "n2"))
    disk = [(T0, m, "node", "n3", {"mountpoint": p}, v) for m, p, v in [
        ("node_filesystem_avail_bytes", "/data/pcap7", 5.0), ("node_filesystem_size_bytes", "/data/pcap7", 100.0),
        ("node_filesystem_avail_bytes", "/other", 1.0), ("node_filesystem_size_bytes", "/other", 100.0)]]
    found = alerts.alert_ruleset(rows.unionByName(spark.createDataFrame(disk, SAMPLES)))
    by_rule = {}
    for r in found.orderBy("ts").collect():
        by_rule.setdefault(r["rule"], []).append(r)
    assert set(by_rule) == {"ExporterDown", "SuricataDropsHigh", "PcapDiskFull"}
    down_rows = by_rule["ExporterDown"]
    assert down_rows[0]["ts"] == at(60) and down_rows[-1]["ts"] == at(570)
    assert [r["state"] for r in down_rows] == ["pending"] * 10 + ["firing"] * 8
    assert down_rows[0]["summary"] == "Exporter j on n1 is down" and down_rows[0]["severity"] == "warning"
    assert by_rule["SuricataDropsHigh"][-1]["value"] == pytest.approx(0.0025)
    assert by_rule["SuricataDropsHigh"][-1]["state"] == "firing"
    assert by_rule["SuricataDropsHigh"][-1]["description"] == "Drop rate: 0.25% over 10 min"
    assert down_rows[0]["description"] is None
    assert by_rule["PcapDiskFull"][0]["summary"] == "PCAP disk /data/pcap7 <10% free on n3"
    episodes = {r["rule"]: r for r in alerts.alerts_summary(found).collect()}
    assert (episodes["ExporterDown"]["fired_at"], episodes["ExporterDown"]["last_at"]) == (at(360), at(570))
    assert set(episodes) == {"ExporterDown", "SuricataDropsHigh"}


def test_percent_text(spark):
    values = [0.0025, 0.123456, 0.0, 1.5, 0.00001234]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(alerts.percent_text(F.col("v"))).collect()
    assert [r[0] for r in rows] == [f"{v * 100:.4g}%" for v in values]


def test_telemetry(spark):
    body = '{"data":[{"nodeName":"a","totalPackets":5,"cpu":1.5},{"nodeName":"b"}]}'
    rows = telemetry.unpivot_stats(spark.createDataFrame([(T0, body), (T0, "bad")], "ts timestamp, body string")).collect()
    assert {(r["node"], r["metric"], r["value"]) for r in rows} == {
        ("a", "arkime_total_packets_packets_total", 5.0), ("a", "arkime_total_packets_cpu", 1.5)}
    health = spark.createDataFrame([(T0, '{"status":"Yellow","active_shards":3}')], "ts timestamp, body string")
    assert {r["metric"]: r["value"] for r in telemetry.health_samples(health).collect()} == {
        "arkime_es_health_status": 1.0, "arkime_es_health_active_shards": 3.0}
    lines = spark.createDataFrame([
        (T0, "a", "State  x  Optimal"), (T0, "a", "0/1  RAID6 Optl"), (T0, "a", "0/2  RAID6 Dgrd"), (T0, "b", "----"),
        (T0, "c", "State  x  Optimal"), (T0, "c", "State  y  Optimal")], "ts timestamp, host string, line string")
    got = {(r["host"], r["metric"], r["vd"]): r["value"] for r in telemetry.state_gauges(lines).collect()}
    assert got == {("a", "raid_cachevault_healthy", None): 1.0, ("a", "raid_vd_optimal", "0/1"): 1.0,
                   ("a", "raid_vd_optimal", "0/2"): 0.0, ("b", "raid_cachevault_healthy", None): 0.0,
                   ("c", "raid_cachevault_healthy", None): 0.0}
    text = spark.createDataFrame([
        ("# HELP m x",), ('m{a="x\\"y\\\\",b="1,2"} +Inf 1000',), ("n 1.5e3",), ("bad line here x",), ("",)], "line string")
    got = telemetry.scan_exposition(text).collect()
    assert [(r["metric"], r["labels"], r["value"]) for r in got] == [
        ("m", {"a": 'x"y\\', "b": "1,2"}, math.inf), ("n", {}, 1500.0)]


def test_series_of_other_labels_are_not_mixed(spark):
    """Two threads with constant counters drop nothing, though they share the labels that texts name."""
    rows = [(at(30 * i), metric, "node", "n1", {"thread": thread}, value)
            for i in range(60) for thread, drops in (("1", 100.0), ("2", 900.0))
            for metric, value in (("suricata_capture_kernel_drops_total", drops),
                                  ("suricata_capture_kernel_packets_total", 1000.0 * i + drops))]
    found = alerts.alert_ruleset(spark.createDataFrame(rows, SAMPLES))
    assert found.where("rule = 'SuricataDropsHigh'").isEmpty()


def test_two_names_over_one_metric(spark):
    rows = [(at(30 * i), "m", "node", "n1", {}, float(i)) for i in range(20)]
    found = metrics.recording_rules(spark.createDataFrame(rows, SAMPLES), ["instance"], {"r1": "m", "r2": "m"})
    counts = {r["metric"]: r["count"] for r in found.groupBy("metric").count().collect()}
    assert set(counts) == {"r1", "r2"} and counts["r1"] == counts["r2"]


def test_exposition_time_out_of_range(spark):
    from lineforge.sources import telemetry

    lines = spark.createDataFrame([("up 1 9223372036854775807",), ("up 2 1000",), ("up 3",)], "line string")
    assert [r["value"] for r in telemetry.scan_exposition(lines).collect()] == [2.0, 3.0]
