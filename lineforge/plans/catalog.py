"""The registered queries: each operator run over whole driver tables or the views made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.operators import (
    alerts, audit, fingerprint, library, metrics, ocsf, parsing, profiling, screening,
)
from lineforge.plans.views import SPARK, Views, with_lines
from lineforge.session import materialize, prepare, scratch_path
from lineforge.sources import files, sinks, telemetry
from lineforge.streaming import streams

YEAR = 2024  # of the driver's events; syslog lines carry none
WINDOW_S = 3 * 3600  # the driver's samples are minutes apart
STEP_S, LOOKBACK_S, RATE_S = 300, 1800, 3600

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def map_text(pairs: Column) -> Column:
    """A map as ``k=v`` text in key order."""
    return F.array_join(F.transform(
        F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


# ---- fingerprints ------------------------------------------------------------------------------

@query
def line_skeleton(v: Views) -> DataFrame:
    return fingerprint.line_skeleton(v.log_lines()).select("line_id", "skeleton")


@query
def line_signature(v: Views) -> DataFrame:
    return fingerprint.line_signature(v.log_lines()).select("line_id", "signature")


@query
def signature_rollup(v: Views) -> DataFrame:
    return fingerprint.signature_rollup(v.log_lines())


# ---- screening ---------------------------------------------------------------------------------

@query
def sanitize_text(v: Views) -> DataFrame:
    return screening.sanitize_text(v.screen_text())


@query
def check_injection(v: Views) -> DataFrame:
    return screening.check_injection(v.screen_text()).select("id", "matched")


@query
def check_injection_ts(v: Views) -> DataFrame:
    return screening.check_injection(v.screen_text(), dialect="ts").select("id", "matched")


@query
def strip_fences(v: Views) -> DataFrame:
    return screening.strip_fences(v.replies()).select("id", "cleaned")


@query
def extract_fenced(v: Views) -> DataFrame:
    return screening.extract_fenced(v.replies()).select("id", "cleaned")


@query
def off_task_flag(v: Views) -> DataFrame:
    return screening.off_task_flag(v.replies()).select("id", "suspicious")


# ---- sources and sinks -------------------------------------------------------------------------

def _written(v: Views, rows: DataFrame, name: str) -> str:
    path = scratch_path(v.spark, name)
    rows.write.text(path)
    return path


@query
def scan_events(v: Views) -> DataFrame:
    text = F.when(F.col("event_id") % 10 == 7, F.concat(F.lit("bad "), F.col("event_json"))).otherwise(
        F.col("event_json"))
    path = _written(v, v.raw_events().select(F.concat(text, F.lit("\n  ")).alias("value")), "events")
    return files.scan_events(v.spark, path).select("text", "ok", "reason")


@query
def scan_events_array(v: Views) -> DataFrame:
    """One JSON array file per 5,000 events."""
    path = scratch_path(v.spark, "arrays")
    arrays = v.raw_events().groupBy(F.floor(F.col("event_id") / 5000).alias("chunk")).agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("event_json"), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("chunk").text(path)
    return files.scan_events(v.spark, path, shape="auto").select(
        F.try_variant_get("event", "$.event", "string").alias("event"),
        F.try_variant_get("event", "$.user_id", "long").alias("user_id"), "ok")


@query
def scan_lines(v: Views) -> DataFrame:
    value = F.when(F.col("line_id") % 5 == 0, F.concat("raw", F.lit("\n \t"))).otherwise(F.col("raw"))
    return files.scan_lines(v.spark, _written(v, v.log_lines().select(value.alias("value")), "lines"))


@query
def detect_input_shape(v: Views) -> DataFrame:
    part = F.col("event_id") % 7
    value = F.when(part < 3, F.col("event_json")).when(part < 5, F.concat(F.lit("line "), F.col("event_id"))).when(
        part == 5, F.concat(F.lit("["), F.col("event_id"), F.lit("]"))).otherwise(
        F.when(F.col("event_id") < 21, F.col("event_json")).otherwise("x"))
    path = scratch_path(v.spark, "shapes")
    chunk = F.floor(F.col("event_id") / 50_000)
    rows = v.raw_events().select(part.alias("part"), chunk.alias("chunk"), value.alias("value"))
    rows.repartition("part", "chunk").write.partitionBy("part", "chunk").text(path)
    found = files.detect_input_shape(v.spark, path)
    return found.select(
        F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"),
        F.regexp_extract("file", r"chunk=(\d+)", 1).cast("long").alias("chunk"), "objects", "shape")


@query
def unpivot_stats(v: Views) -> DataFrame:
    return telemetry.unpivot_stats(v.stats_json())


@query
def health_samples(v: Views) -> DataFrame:
    return telemetry.health_samples(v.health_json())


@query
def state_gauges(v: Views) -> DataFrame:
    return telemetry.state_gauges(v.state_lines())


@query
def scan_exposition(v: Views) -> DataFrame:
    return telemetry.scan_exposition(v.exposition()).select(
        "line_id", "metric", map_text(F.col("labels")).alias("labels"), "value", "sample_ts")


def _with_junk(lines: DataFrame) -> DataFrame:
    return lines.withColumn(
        "raw", F.when(F.col("line_id") % 10 == 3, F.concat(F.lit("junk "), F.col("line_id"))).otherwise(F.col("raw")))


@query
def write_routed(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "routed")
    sinks.write_routed(parsing.parse_mixed(_with_junk(v.log_lines()), year=YEAR), path)
    return v.spark.read.parquet(path).select("line_id", "route", "reason")


@query
def encode_events(v: Views) -> DataFrame:
    rows = v.table("events").select(
        "event_id", "user_id", "event_type", F.concat(F.lit("k = "), F.col("user_id")).alias("note"))
    columns = ["user_id", "event_type", "note"]
    as_json = sinks.encode_events(rows, columns).withColumnRenamed("encoded", "json_text")
    both = sinks.encode_events(as_json, columns, "logfmt")
    return both.select("event_id", "json_text", F.col("encoded").alias("logfmt_text"))


# ---- profiling ---------------------------------------------------------------------------------

@query
def key_presence(v: Views) -> DataFrame:
    return profiling.key_presence(v.raw_events(), group=["source"])


@query
def key_types(v: Views) -> DataFrame:
    return profiling.key_types(v.raw_events(), group=["source"])


@query
def key_types_script(v: Views) -> DataFrame:
    return profiling.key_types(v.raw_events(), group=["source"], style="script")


@query
def key_set_variants(v: Views) -> DataFrame:
    return profiling.key_set_variants(v.raw_events(), group=["source"]).withColumn(
        "keys", F.array_join("keys", ","))


@query
def batch_analysis(v: Views) -> DataFrame:
    """Also a null source, and one without a single object."""
    bare, none = F.col("event_id") % 50 == 7, F.col("event_id") % 5 == 0
    events = v.raw_events().select(
        F.when(bare, "bare").when(~none, F.col("source")).alias("source"),
        F.when(bare, "[1]").otherwise(F.col("event_json")).alias("event_json"))
    done = profiling.batch_analysis(events)
    types = F.transform(F.map_entries("types"), lambda t: F.concat(
        t["key"], F.lit(":"), F.array_join(F.transform(t["value"], lambda x: F.concat_ws("=", x["key"], x["value"])), ",")))
    variants = F.transform("variants", lambda x: F.concat(F.array_join(x["keys"], ","), F.lit("="), x["count"]))
    return done.select(
        "source", "count", F.array_join("common_keys", ",").alias("common_keys"),
        F.array_join("optional_keys", ",").alias("optional_keys"), F.array_join(F.array_sort(types), ";").alias("types"),
        F.array_join(variants, ";").alias("variants"))


@query
def even_sample(v: Views) -> DataFrame:
    return profiling.even_sample(v.raw_events()).select("source", "event_id", "position", "total")


@query
def head_sample(v: Views) -> DataFrame:
    return profiling.head_sample(v.raw_events()).select(
        "source", "event_id", F.col("position").cast("long").alias("position"))


@query
def batch_prompts(v: Views) -> DataFrame:
    return profiling.batch_prompts(v.raw_events())


@query
def field_profile(v: Views) -> DataFrame:
    rows = v.raw_events().withColumn(
        "event_json", F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("plain, "), F.col("event_json"))).otherwise(
            F.col("event_json")))
    return profiling.field_profile(rows)


# ---- library -----------------------------------------------------------------------------------

@query
def source_upsert(v: Views) -> DataFrame:
    requests = v.table("events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, "csv").otherwise(
            F.concat(F.col("event_type"), F.lit("-"), F.col("user_id"))).alias("name"),
        F.concat(F.lit("d"), F.col("event_id")).alias("description"), F.col("ts").alias("at"))
    return library.source_upsert(v.sources(), requests)


@query
def source_counts(v: Views) -> DataFrame:
    return library.source_counts(v.sources(), v.parsers())


def _ids(v: Views, ids: str) -> DataFrame:
    """Ids taken from events: every third parser id, or one source id per user third."""
    return v.table("events").selectExpr(f"{ids} AS id").distinct()


@query
def source_delete(v: Views) -> DataFrame:
    _, parsers = library.source_delete(v.sources(), v.parsers(), _ids(v, "user_id % 2 + 2"))
    return parsers.groupBy("source_id").agg(F.count("*").alias("parsers"))


@query
def source_delete_sources(v: Views) -> DataFrame:
    kept, _ = library.source_delete(v.sources(), v.parsers(), _ids(v, "user_id % 2 + 2"))
    return kept.select("id", "name")


@query
def parser_lookup(v: Views) -> DataFrame:
    lines = fingerprint.line_signature(v.log_lines()).select("line_id", "signature")
    return library.parser_lookup(lines, v.parsers(), v.sources()).select(
        "line_id", "signature", "parser_id", "variant", "hits", "source_name", "rank")


@query
def hit_counts(v: Views) -> DataFrame:
    lookups = fingerprint.line_signature(v.timed_lines()).select("signature", F.col("ts").alias("at"))
    return library.hit_counts(v.parsers(), lookups).select("id", "signature", "variant", "hits", "updated_at")


@query
def parser_upsert(v: Views) -> DataFrame:
    return library.parser_upsert(v.parsers(), v.parser_requests())


@query
def parser_list(v: Views) -> DataFrame:
    return library.parser_list(v.parsers(), v.sources(), source_id=2)


@query
def parser_get(v: Views) -> DataFrame:
    return library.parser_get(v.parsers(), v.sources(), _ids(v, "event_id * 3"))


@query
def parser_delete(v: Views) -> DataFrame:
    return library.parser_delete(v.parsers(), _ids(v, "event_id * 3")).select("id", "signature", "variant")


@query
def parser_relabel(v: Views) -> DataFrame:
    requests = v.table("events").selectExpr(
        "event_id AS seq", "event_id div 2 * 3 AS id", "concat('new ', event_id) AS label", "ts AS at")
    return library.parser_relabel(v.parsers(), requests).select("id", "label", "updated_at")


@query
def library_size(v: Views) -> DataFrame:
    return library.library_size(v.parsers())


@query
def route_lines(v: Views) -> DataFrame:
    raw = (
        F.when(F.col("line_id") % 11 == 5, F.lit(" \n\t "))
        .when(F.col("line_id") % 11 == 6, F.concat(F.lit("SUDO mode "), F.col("raw")))
        .when(F.col("line_id") % 11 == 7, F.concat(F.lit("unseen shape: "), F.col("raw")))
        .otherwise(F.col("raw")))
    return library.route_lines(v.log_lines().withColumn("raw", raw), v.parsers()).drop("raw", "source")


# ---- parsing -----------------------------------------------------------------------------------

@query
def detect_format(v: Views) -> DataFrame:
    return parsing.detect_format(v.log_lines()).select("line_id", "format")


@query
def parse_syslog(v: Views) -> DataFrame:
    return parsing.parse_syslog(v.log_lines(), year=YEAR).drop("source", "raw", "msgid", "version", "structured_data")


@query
def parse_syslog_structured(v: Views) -> DataFrame:
    elements = F.transform_values("structured_data", lambda _, element: map_text(element))
    return parsing.parse_syslog(v.structured_lines()).select(
        "line_id", "hostname", "appname", "procid", "msgid", "version", "message", map_text(elements).alias("structured"), "ok")


@query
def parse_access_log(v: Views) -> DataFrame:
    return parsing.parse_access_log(v.log_lines()).drop("source", "raw")


@query
def parse_json_log(v: Views) -> DataFrame:
    return parsing.parse_json_log(v.log_lines(), keep_extra=False).drop("source", "raw")


@query
def parse_json_props(v: Views) -> DataFrame:
    spec = {"event_type": ("event", "string"), "user_id": ("user_id", "long"), "k": ("props.k", "long"),
            "inner": ("props.in.v", "string"), "value": ("value", "double"), "at": ("at", "timestamp")}
    parsed = parsing.parse_json_log(v.raw_events(), col="event_json", fields=spec)
    return parsed.withColumn("extra", map_text(F.col("extra"))).drop("source", "event_json")


KV_FIELDS = {
    "timestamp": ("time", "timestamp"), "level": ("level", "lower"), "component": ("component", "string"),
    "method": ("method", "string"), "path": ("path", "string"), "status": ("status", "int"),
    "duration_ms": ("duration_ms", "long"), "note": ("note", "string"),
}


@query
def parse_key_value(v: Views) -> DataFrame:
    parsed = parsing.parse_key_value(v.log_lines(), fields=KV_FIELDS).drop("source", "raw")
    return parsed.withColumn("fields", map_text(F.col("fields")))


@query
def parse_csv_log(v: Views) -> DataFrame:
    return parsing.parse_csv_log(v.log_lines()).drop("source", "raw")


@query
def parse_app_log(v: Views) -> DataFrame:
    parsed = parsing.parse_app_log(v.log_lines())
    return parsed.drop("source", "raw").withColumn("fields", map_text(F.col("fields")))


@query
def parse_nested(v: Views) -> DataFrame:
    rows = v.timed_lines().select("line_id", F.concat(
        F.lit("<134>"), F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" dbhost oracle: DBUSER:'SYS "),
        F.col("line_id"), F.lit("' ACTION:'"), F.col("line_id") % 100, F.lit("' RETCODE:'0'")).alias("raw"))
    return parsing.parse_nested(rows, year=YEAR).drop("raw").withColumn("fields", map_text(F.col("fields")))


@query
def parse_mixed(v: Views) -> DataFrame:
    parsed = parsing.parse_mixed(_with_junk(v.log_lines()), year=YEAR).drop("source", "raw")
    return parsed.withColumn("extra", map_text(F.col("extra")))


OWN_PATTERNS = [
    r"Payment failed for order_id=(?P<order>ORD-\d+) amount=(?P<amount>[\d.]+) .*reason=\"(?P<why>[^\"]*)\"",
    r"^<(\d+)>.* (?<app_name>\w+)\[(?<event>\d+)\]: user (?<user>\d+)(?: nothing (?<absent>\w+))? value (?<amount>[\d.]+)$",
]


@query
def parse_regex(v: Views) -> DataFrame:
    fields = {"amount": ("amount", "double"), "user": ("user", "long")}
    parsed = parsing.parse_regex(v.log_lines(), OWN_PATTERNS, fields=fields).drop("source", "raw")
    return parsed.withColumn("fields", map_text(F.col("fields")))


@query
def parse_groks(v: Views) -> DataFrame:
    parsed = parsing.parse_groks(v.log_lines(), [
        r"%{IP:client} - %{USERNAME:user} \[%{HTTPDATE:at}\] %{REQUEST} %{INT:status:int} %{NUMBER:size:long}",
        r"^\d{4}-\d{2}-\d{2},\S+?,%{IPORHOST:client},%{WORD:verb},",
        r"time=%{TIMESTAMP_ISO8601:at} level=%{LOGLEVEL:level} .*status=%{INT:status:int}",
    ], aliases={"REQUEST": r'"%{WORD:verb} %{PATH:path} [^"]*"'}).drop("source", "raw")
    return parsed.withColumn("fields", map_text(F.col("fields")))


@query
def coerce_fields(v: Views) -> DataFrame:
    rows = v.table("events").selectExpr(
        "event_id", f"CASE WHEN event_id % 7 = 0 THEN event_type ELSE {SPARK.s('user_id')} END AS n",
        f"CASE WHEN event_id % 9 = 0 THEN 'x1' ELSE {SPARK.s('event_id % 100')} END AS f",
        "CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN '1' WHEN 3 THEN 'false' ELSE 'maybe' END AS b",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS t")
    return parsing.coerce_fields(rows, {"n": "long", "f": "double", "b": "bool", "t": "timestamp"})


@query
def ocsf_map(v: Views) -> DataFrame:
    mapped = ocsf.ocsf_from_mixed(parsing.parse_mixed(_with_junk(v.log_lines()), year=YEAR))
    return mapped.select(
        "line_id", "class_uid", "category_uid", "activity_id", "type_uid", "severity_id", "time",
        F.col("metadata.product.name").alias("product"), F.col("metadata.version").alias("version"),
        F.col("src_endpoint.ip").alias("src_ip"), F.col("http_request.http_method").alias("http_method"),
        F.col("http_request.url.path").alias("url_path"))


@query
def compact_flatten(v: Views) -> DataFrame:
    flat = parsing.compact_flatten(
        v.raw_events(), drop=["event"], merge=F.create_map(F.lit("user_id"), F.col("source")))
    return flat.select("event_id", map_text(F.col("flat")).alias("flat"))


@query
def flatten_deep(v: Views) -> DataFrame:
    return parsing.compact_flatten(v.deep_events()).select("event_id", map_text(F.col("flat")).alias("flat"))


# ---- audits ------------------------------------------------------------------------------------

@query
def lint_forbidden(v: Views) -> DataFrame:
    return audit.lint_forbidden(v.programs())


@query
def lint_braces(v: Views) -> DataFrame:
    return audit.lint_braces(v.programs())


@query
def lint_literals(v: Views) -> DataFrame:
    return audit.lint_literals(v.programs())


@query
def lint_escapes(v: Views) -> DataFrame:
    return audit.lint_escapes(v.programs())


@query
def lint_regex_compile(v: Views) -> DataFrame:
    return audit.lint_regex_compile(v.programs())


@query
def lint_summary(v: Views) -> DataFrame:
    return audit.lint_summary(v.programs())


@query
def output_quality(v: Views) -> DataFrame:
    return audit.output_quality(v.runs()).select("run_id", "warning")


@query
def run_triage(v: Views) -> DataFrame:
    return audit.run_triage(v.runs()).select("run_id", "outcome", "output", "warning", "error", "exit")


@query
def input_wrap(v: Views) -> DataFrame:
    return audit.input_wrap(v.runs()).select("run_id", "event")


# ---- metrics and alerts ------------------------------------------------------------------------

def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


@query
def metric_select(v: Views) -> DataFrame:
    picked = metrics.metric_select(
        v.metric_samples(), "node_filesystem_avail_bytes", {"job": "node"}, {"mountpoint": "/data/pcap[0-2]"})
    return metrics.with_labels(picked, ["mountpoint"]).select("ts", "instance", "mountpoint", "value")


@query
def counter_rate(v: Views) -> DataFrame:
    picked = metrics.metric_select(v.samples(), "count_total")
    return _rounded(metrics.counter_rate(picked, ["instance"], WINDOW_S), "rate")


@query
def grid_rate(v: Views) -> DataFrame:
    picked = metrics.metric_select(v.samples(), "count_total")
    return _rounded(metrics.grid_rate(picked, ["instance"], STEP_S, RATE_S), "rate")


@query
def drop_ratio(v: Views) -> DataFrame:
    return _rounded(metrics.drop_ratio(
        v.metric_samples(), ["job", "instance"], "suricata_capture_kernel_drops_total",
        "suricata_capture_kernel_packets_total", WINDOW_S, percent=True), "ratio")


@query
def gauge_ratio(v: Views) -> DataFrame:
    opened = metrics.with_labels(v.metric_samples(), ["mountpoint"])
    return _rounded(metrics.gauge_ratio(
        opened, ["instance", "mountpoint"], "node_filesystem_avail_bytes", "node_filesystem_size_bytes"), "ratio")


@query
def match_ratio(v: Views) -> DataFrame:
    return _rounded(metrics.match_ratio(
        v.metric_samples(), ["instance"], "arkime_total_packets_suricataMatches",
        "arkime_total_packets_suricataAlerts"), "ratio")


@query
def rate_by_label(v: Views) -> DataFrame:
    opened = metrics.with_labels(v.metric_samples(), ["app_proto"])
    return _rounded(metrics.rate_by_label(
        opened, "suricata_app_layer_flow_total", ["instance"], "app_proto", STEP_S, RATE_S), "rate")


def _threads(v: Views) -> DataFrame:
    return v.table("events").selectExpr(
        "date_trunc('hour', ts) AS ts", "event_type AS metric", f"concat('node', {SPARK.s('user_id % 3')}) AS instance",
        "user_id % 44 AS thread", "value")


@query
def totals_rollup(v: Views) -> DataFrame:
    return metrics.totals_rollup(_threads(v), "thread").withColumn("value", F.round("value", 6))


@query
def series_count(v: Views) -> DataFrame:
    return metrics.series_count(_threads(v), ["metric", "instance", "thread"], "thread")


@query
def eval_grid(v: Views) -> DataFrame:
    return metrics.eval_grid(metrics.metric_select(v.samples(), "level"), ["instance"], STEP_S, LOOKBACK_S)


@query
def alert_states(v: Views) -> DataFrame:
    grid = metrics.eval_grid(metrics.metric_select(v.samples(), "level"), ["instance"], STEP_S, LOOKBACK_S)
    return alerts.alert_states(grid, ["instance"], F.col("value") > 15, 900, STEP_S)


def _ruleset(v: Views) -> DataFrame:
    # Rates and gauges each scan the stored samples, for their own metrics only.
    samples = materialize(v.metric_samples(), "samples")
    return alerts.alert_ruleset(samples, step_s=STEP_S, window_s=RATE_S, lookback_s=LOOKBACK_S)


@query
def alert_ruleset(v: Views) -> DataFrame:
    return _rounded(_ruleset(v), "value")


@query
def alerts_summary(v: Views) -> DataFrame:
    return _rounded(alerts.alerts_summary(_ruleset(v)), "worst")


@query
def relabel(v: Views) -> DataFrame:
    changed = metrics.relabel(
        v.metric_samples(), copy={"target": "node", "app": "app_proto"}, constant={"device": "fixed"})
    return changed.groupBy("metric", map_text(F.col("labels")).alias("labels")).agg(F.count("*").alias("n"))


@query
def series_retention(v: Views) -> DataFrame:
    kept = metrics.series_retention(v.samples(), days=7)
    return kept.select("ts", "instance", "metric", "value")


def _recorded(v: Views) -> str:
    recorded = metrics.recording_rules(
        v.metric_samples(), ["instance"], {"suricata:packets:rate": "suricata_capture_kernel_packets_total"},
        ("suricata:drops:percent", "suricata_capture_kernel_drops_total", "suricata_capture_kernel_packets_total"),
        STEP_S, RATE_S)
    path = scratch_path(v.spark, "recorded")
    metrics.write_recorded(recorded, path)
    return path


@query
def recording_rules(v: Views) -> DataFrame:
    return _rounded(v.spark.read.parquet(_recorded(v)).select("metric", "instance", "ts", "value"), "value")


@query
def retain_recorded(v: Views) -> DataFrame:
    path = _recorded(v)
    metrics.retain_recorded(v.spark, path, days=7)
    return _rounded(v.spark.read.parquet(path).select("metric", "instance", "ts", "value"), "value")


# ---- streams -----------------------------------------------------------------------------------

def _event_stream(v: Views) -> DataFrame:
    schema = v.spark.read.parquet(f"{v.folder}/events.parquet").schema
    stream = v.spark.readStream.schema(schema).parquet(f"{v.folder}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(v: Views, stream: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    path = scratch_path(v.spark, name)
    running = streams.start_file_sink(stream, f"{path}/out", f"{path}/checkpoint", partition_by)
    running.awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query
def stream_parse(v: Views) -> DataFrame:
    parsed = streams.stream_parse(_with_junk(with_lines(_event_stream(v))), year=YEAR)
    done = _drained(v, parsed, "stream-parse", ("route",))
    return done.select(
        "line_id", "format", "timestamp", "level", "service", "status", "message", map_text(F.col("extra")).alias("extra"), "route")


@query
def stream_signatures(v: Views) -> DataFrame:
    return _drained(v, streams.stream_signatures(with_lines(_event_stream(v)), window="1 day"), "stream-signatures")


@query
def stream_route(v: Views) -> DataFrame:
    lines = with_lines(_event_stream(v)).withColumn(
        "raw", F.when(F.col("line_id") % 11 == 7, F.concat(F.lit("unseen shape: "), F.col("raw"))).otherwise(F.col("raw")))
    routed = streams.stream_route(lines, v.parsers())
    return _drained(v, routed.drop("raw", "source", "ts", "vrl_code", "message"), "stream-route")


@query
def stream_alerts(v: Views) -> DataFrame:
    samples = _event_stream(v).selectExpr(f"concat('node', {SPARK.s('user_id % 3')}) AS instance", "ts", "value")
    states = streams.stream_alerts(
        samples, ["instance"], F.col("value") > 15, for_s=900, step_s=STEP_S, lookback_s=LOOKBACK_S)
    return _drained(v, states, "stream-alerts")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """All line shapes with counts and a sample, the most frequent first."""
    rolled = fingerprint.signature_rollup(Views(prepare(spark), folder).log_lines())
    return rolled.orderBy(F.desc("lines"), "signature")
