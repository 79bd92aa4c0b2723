"""Alert rules on the evaluation grid: thresholds held for a duration, the rule set, episodes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineforge.operators import metrics
from lineforge.operators.metrics import MICROS

RULE_LABELS = ["job", "instance", "node", "mountpoint", "device"]


@dataclass(frozen=True)
class Rule:
    """One alert: ``num`` or ``num / den`` compared with a threshold, held for ``for_s``.

    ``rate`` takes per-second rates of both instead of their values; ``floor`` keeps the divisor
    from falling below it. ``summary`` and ``description`` may name labels in braces;
    ``{percent}`` stands for the value as a percentage.
    """

    name: str
    severity: str
    for_s: int
    num: str
    op: str
    threshold: float
    summary: str
    den: str | None = None
    rate: bool = False
    floor: float | None = None
    match: dict[str, str] = field(default_factory=dict)
    description: str | None = None


# The eleven capture alerts.
CAPTURE_RULES = [
    Rule("SuricataDropsHigh", "critical", 600, "suricata_capture_kernel_drops_total", ">", 0.001,
         "Suricata dropping packets on {instance}", den="suricata_capture_kernel_packets_total", rate=True, floor=1.0,
         description="Drop rate: {percent} over 10 min"),
    Rule("SuricataFlowMemcapFull", "warning", 120, "suricata_flow_memcap_state", ">", 0,
         "Suricata flow memcap hit on {instance}",
         description="New flows are being dropped — increase flow.memcap"),
    Rule("ArkimeDroppingPackets", "critical", 300, "arkime_total_packets_deltaDroppedPerSec", ">", 0,
         "Arkime capture dropping on {node}"),
    Rule("ArkimeESDropping", "critical", 300, "arkime_total_packets_deltaESDroppedPerSec", ">", 0,
         "Arkime dropping sessions because ES can't keep up"),
    Rule("OpenSearchUnhealthy", "critical", 300, "arkime_es_health_active_shards", "<", 1,
         "OpenSearch cluster reporting issues"),
    Rule("PcapDiskFull", "warning", 900, "node_filesystem_avail_bytes", "<", 0.10,
         "PCAP disk {mountpoint} <10% free on {instance}", den="node_filesystem_size_bytes",
         match={"mountpoint": "/data/pcap[0-9]+"}),
    Rule("SuricataLogDiskFull", "critical", 300, "node_filesystem_avail_bytes", "<", 0.15,
         "Suricata EVE log disk <15% free — tighten logrotate", den="node_filesystem_size_bytes",
         match={"mountpoint": "/data/suricata-logs"}),
    Rule("ExporterDown", "warning", 300, "up", "==", 0, "Exporter {job} on {instance} is down"),
    Rule("NICDrops", "warning", 600, "node_network_receive_drop_total", ">", 0,
         "NIC-level drops on eth3 ({instance})", rate=True, match={"device": "eth3"}),
    Rule("LowMemory", "warning", 600, "node_memory_MemAvailable_bytes", "<", 0.10, "Low memory on {instance}",
         den="node_memory_MemTotal_bytes"),
    Rule("RaidCacheVaultFailed", "critical", 300, "raid_cachevault_healthy", "==", 0,
         "RAID CacheVault failed on {instance} — WriteBack disabled"),
]


def holds(value: Column, op: str, threshold: float) -> Column:
    limit = F.lit(float(threshold))
    tests = {">": value > limit, "<": value < limit, "==": value == limit, ">=": value >= limit, "<=": value <= limit}
    return tests[op]


def alert_states(
    vector: DataFrame, by: Sequence[str], condition: Column, for_s: Column | int, step_s: int = 30
) -> DataFrame:
    """State per series and grid time: inactive, pending or firing, with the time it became active.

    ``vector`` has at most one row per series and grid time (``eval_grid``, ``grid_rate``), so the
    window over one series is bounded by time span over step, whatever the data volume. A false
    result or a missing grid time resets. Firing starts once active for ``for_s``.
    """
    order = Window.partitionBy(*by).orderBy("__slot")
    slot = F.floor(F.unix_micros("ts") / F.lit(step_s * MICROS)).cast("long")
    active = F.coalesce(condition, F.lit(False))
    marked = vector.withColumn("__slot", slot).withColumn("__active", active)
    goes_on = F.lag("__active").over(order) & (F.lag("__slot").over(order) == F.col("__slot") - 1)
    starts = F.when(F.col("__active") & ~F.coalesce(goes_on, F.lit(False)), F.col("ts"))
    dated = marked.withColumn("__starts", starts).withColumn(
        "active_since", F.max("__starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = (F.unix_micros("ts") - F.unix_micros("active_since")) >= F.lit(for_s) * MICROS
    state = F.when(~F.col("__active"), "inactive").when(held, "firing").otherwise("pending")
    return dated.select(
        *vector.columns, state.alias("state"),
        F.when(F.col("__active"), F.col("active_since")).alias("active_since"))


def _pick(rules: Sequence[Rule], value) -> Column:
    """A per-rule constant by the ``rule`` column."""
    out = None
    for rule in rules:
        out = F.when(F.col("rule") == rule.name, value(rule)) if out is None else out.when(
            F.col("rule") == rule.name, value(rule))
    return out


def _text(template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    parts, rest = [], template
    while "{" in rest:
        plain, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        value = percent_text(F.col("value")) if name == "percent" else F.coalesce(F.col(name), F.lit(""))
        parts += [F.lit(plain), value]
    return F.concat(*parts, F.lit(rest))


def percent_text(value: Column) -> Column:
    """A ratio as a percentage with four significant digits; halves are rounded up."""
    percent = value * 100
    scale = F.pow(F.lit(10.0), 3 - F.floor(F.log10(F.abs(percent))))
    rounded = F.when(percent == 0, F.lit(0.0)).otherwise(F.round(percent * scale) / scale)
    return F.concat(F.regexp_replace(F.format_string("%.9f", rounded), r"\.?0+$", ""), F.lit("%"))


def rule_values(
    samples: DataFrame, rules: Sequence[Rule] = CAPTURE_RULES, step_s: int = 30, window_s: int = 300,
    lookback_s: int = 300,
) -> DataFrame:
    """The value of every rule's expression per series and grid time.

    All rules share one scan: a sample is tagged with the rules and the side (num, den) it serves,
    and only metrics some rule reads leave the scan. Rates and gauges are each evaluated once for
    all rules together. A series is its whole label set, in ``series`` as text; both sides of a ratio match on it.
    """
    used = sorted({m for r in rules for m in (r.num, r.den) if m})
    identity = F.to_json(F.array_sort(F.map_entries("labels")))
    kept = samples.filter(F.col("metric").isin(*used)).withColumn("series", F.coalesce(identity, F.lit("")))
    opened = metrics.with_labels(kept, RULE_LABELS)
    tags: dict[str, list[Column]] = {}
    for rule in rules:
        for part, metric in (("num", rule.num), ("den", rule.den)):
            if metric is None:
                continue
            fits = F.lit(True)
            for label, pattern in rule.match.items():
                fits = fits & F.coalesce(F.col(label), F.lit("")).rlike(rf"\A(?:{pattern})\z")
            tag = F.struct(F.lit(rule.name).alias("rule"), F.lit(part).alias("part"), F.lit(rule.rate).alias("rate"))
            tags.setdefault(metric, []).append(F.when(fits, tag))
    # A sample is tested against the rules of its own metric only.
    served = None
    for metric, tests in tags.items():
        test = F.col("metric") == metric
        served = F.when(test, F.array(*tests)) if served is None else served.when(test, F.array(*tests))
    tagged = opened.withColumn("__t", F.explode(F.filter(served, lambda t: t.isNotNull()))).select(
        F.col("__t.rule").alias("rule"), F.col("__t.part").alias("part"), F.col("__t.rate").alias("__rate"),
        "series", *RULE_LABELS, "ts", "value")
    series = ["rule", "part", "series", *RULE_LABELS]
    rates = metrics.grid_rate(tagged.filter("__rate"), series, step_s, window_s).withColumnRenamed("rate", "value")
    gauges = metrics.eval_grid(tagged.filter("NOT __rate"), series, step_s, lookback_s)
    sides = rates.unionByName(gauges).groupBy("rule", "series", *RULE_LABELS, "ts").agg(
        F.max(F.when(F.col("part") == "num", F.col("value"))).alias("num"),
        F.max(F.when(F.col("part") == "den", F.col("value"))).alias("den"))
    floor = _pick(rules, lambda r: F.lit(r.floor).cast("double"))
    den = F.greatest(F.col("den"), floor)
    paired = _pick(rules, lambda r: F.lit(r.den is not None))
    value = F.when(paired, metrics.divide(F.col("num"), den)).otherwise(F.col("num"))
    return sides.select("rule", "series", *RULE_LABELS, "ts", value.alias("value")).filter(F.col("value").isNotNull())


def alert_ruleset(
    samples: DataFrame, rules: Sequence[Rule] = CAPTURE_RULES, step_s: int = 30, window_s: int = 300,
    lookback_s: int = 300,
) -> DataFrame:
    """Pending and firing alerts of all rules: rule, severity, labels, ts, value, state, texts."""
    values = rule_values(samples, rules, step_s, window_s, lookback_s)
    active = values.filter(_pick(rules, lambda r: holds(F.col("value"), r.op, r.threshold)))
    states = alert_states(active, ["rule", "series", *RULE_LABELS], F.lit(True), _pick(rules, lambda r: F.lit(r.for_s)), step_s)
    return states.select(
        "rule", _pick(rules, lambda r: F.lit(r.severity)).alias("severity"), "series", *RULE_LABELS, "ts", "value", "state",
        "active_since", _pick(rules, lambda r: _text(r.summary)).alias("summary"),
        _pick(rules, lambda r: _text(r.description)).alias("description"))


def alerts_summary(alerts: DataFrame, rules: Sequence[Rule] = CAPTURE_RULES) -> DataFrame:
    """Firing episodes per rule and series: start, end, evaluations and the worst value."""
    low = _pick(rules, lambda r: F.lit(r.op in ("<", "<=")))
    grouped = alerts.filter(F.col("state") == "firing").groupBy("rule", "series", *RULE_LABELS, "active_since").agg(
        F.min("ts").alias("fired_at"), F.max("ts").alias("last_at"), F.count("*").alias("evaluations"),
        F.max("value").alias("__max"), F.min("value").alias("__min"))
    return grouped.select(
        "rule", "series", *RULE_LABELS, "active_since", "fired_at", "last_at", "evaluations",
        F.when(low, F.col("__min")).otherwise(F.col("__max")).alias("worst"))
