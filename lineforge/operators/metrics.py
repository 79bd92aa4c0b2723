"""Metric samples: selection, rates, ratios, grid evaluation, roll-ups.

Samples are (ts, metric, labels..., value). Labels come as a ``labels`` map; ``with_labels`` opens
the ones a computation needs into columns, which then key its joins, windows and groups.

A single series may hold a large part of all samples, so no window over raw samples spans a whole
series: it runs per series and time bucket, with copies of the samples near a bucket's edge.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineforge.session import delete_table, materialize

MICROS = 1_000_000


def metric_select(
    samples: DataFrame, metric: str | None = None, equal: Mapping[str, str] | None = None,
    match: Mapping[str, str] | None = None,
) -> DataFrame:
    """Samples of one metric by label equality and fully anchored regex; an absent label is empty."""
    def label(name: str) -> Column:
        found = F.col(name) if name in samples.columns else F.try_element_at(F.col("labels"), F.lit(name))
        return F.coalesce(found, F.lit(""))

    condition = F.lit(True) if metric is None else F.col("metric") == metric
    for name, value in (equal or {}).items():
        condition = condition & (label(name) == value)
    for name, pattern in (match or {}).items():
        condition = condition & label(name).rlike(rf"\A(?:{pattern})\z")
    return samples.filter(condition)


def with_labels(samples: DataFrame, names: Sequence[str]) -> DataFrame:
    """Opens labels into columns; an absent label is null."""
    new = [n for n in names if n not in samples.columns]
    return samples.withColumns({n: F.try_element_at(F.col("labels"), F.lit(n)) for n in new})


def bucketed(
    samples: DataFrame, bucket_s: int, before_s: float = 0, after_s: float = 0, time: str = "__us"
) -> DataFrame:
    """Assigns rows to time buckets, with copies in the neighbours that need them.

    A row is copied into every bucket whose span, extended by ``before_s`` to the left and
    ``after_s`` to the right, holds it. ``__home`` tells originals from copies.
    """
    width = bucket_s * MICROS
    at = F.col(time)
    first = F.floor((at - int(after_s * MICROS)) / F.lit(width)).cast("long")
    last = F.floor((at + int(before_s * MICROS)) / F.lit(width)).cast("long")
    home = F.floor(at / F.lit(width)).cast("long")
    copies = samples.withColumn("__bucket", F.explode(F.sequence(first, last)))
    return copies.withColumn("__home", F.col("__bucket") == home)


def _bucket_size(window_s: int) -> int:
    """Wide enough that edge copies stay at a twentieth; narrow enough to split any hot series."""
    return 20 * window_s


def counter_rate(
    samples: DataFrame, by: Sequence[str], window_s: int = 300, value: str = "value", bucket_s: int | None = None
) -> DataFrame:
    """Per-second increase over the trailing window at each sample, counter resets taken care of.

    A drop in value means a restart, so the new value itself is the increase. The window includes
    its left edge, and the increase is divided by the time between the first and last sample in it;
    the public definition extrapolates to the window's edges instead. Under two samples: no row.
    """
    timed = samples.withColumn("__us", F.unix_micros("ts"))
    split = bucketed(timed, bucket_s or _bucket_size(window_s), before_s=window_s)
    ordered = Window.partitionBy(*by, "__bucket").orderBy("__us", value)
    before = F.lag(value).over(ordered)
    delta = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    stepped = split.withColumn("__delta", F.coalesce(delta, F.lit(0.0)))
    # Running sums: up to this row, and up to the last row of its time.
    peers = Window.partitionBy(*by, "__bucket").orderBy("__us").rangeBetween(Window.unboundedPreceding, 0)
    summed = stepped.withColumns({
        "__sum": F.sum("__delta").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "__all": F.sum("__delta").over(peers)})
    # A probe at each window's left edge meets the first sample in the window, walking back in time. A trailing
    # frame would look at every sample of the window anew for each row.
    probe = lambda at, is_probe: F.struct(at.alias("at"), F.lit(is_probe).alias("is_probe"))
    points = F.when(F.col("__home"), F.array(
        probe(F.col("__us"), False), probe(F.col("__us") - window_s * MICROS, True))).otherwise(
        F.array(probe(F.col("__us"), False)))
    probed = summed.select(*by, "ts", "__bucket", "__us", "__sum", "__all", F.inline(points))
    back = Window.partitionBy(*by, "__bucket").orderBy(F.desc("at"), "is_probe", F.desc("__sum")).rowsBetween(
        Window.unboundedPreceding, 0)
    first = F.last(F.when(~F.col("is_probe"), F.struct("__us", "__sum")), ignorenulls=True).over(back)
    rated = probed.withColumn("__first", first).filter("is_probe")
    # The first sample's own step lies outside the window.
    span = F.col("__us") - F.col("__first.__us")
    return rated.filter(span > 0).select(
        *by, "ts", ((F.col("__all") - F.col("__first.__sum")) / (span / MICROS)).alias("rate"))


def grid_rate(
    samples: DataFrame, by: Sequence[str], step_s: int = 30, window_s: int = 300, value: str = "value",
    extrapolate: bool = False, bucket_s: int | None = None,
) -> DataFrame:
    """The same rate at evaluation times every ``step_s`` rather than at samples.

    Each sample meets the ``window_s / step_s`` grid times whose window holds it; sums combine
    map-side. ``extrapolate`` scales the increase to the whole window by the public rule.
    """
    timed = samples.withColumn("__us", F.unix_micros("ts"))
    split = bucketed(timed, bucket_s or _bucket_size(window_s), before_s=window_s)
    series = Window.partitionBy(*by, "__bucket").orderBy("__us")
    before = F.lag(value).over(series)
    delta = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    # Copies only serve as predecessors; the first original's step may come from a copy.
    stepped = split.withColumn("__delta", F.coalesce(delta, F.lit(0.0))).filter("__home")
    step = step_s * MICROS
    first = F.ceil(F.col("__us") / F.lit(step)).cast("long")
    last = F.floor((F.col("__us") + window_s * MICROS) / F.lit(step)).cast("long")
    # A sample right before a grid time but beyond the grid's reach meets none.
    slots = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    summed = stepped.withColumn("slot", F.explode(slots)).groupBy(*by, "slot").agg(
        F.sum("__delta").alias("__sum"), F.min_by("__delta", "__us").alias("__skip"),
        F.min_by(value, "__us").alias("__first"), F.min("__us").alias("__from"), F.max("__us").alias("__to"),
        F.count("*").alias("__n"))
    rise = F.col("__sum") - F.col("__skip")
    span = (F.col("__to") - F.col("__from")) / MICROS
    if extrapolate:
        start = (F.col("slot") * step - window_s * MICROS).cast("double")
        gap = span / (F.col("__n") - 1)
        left = (F.col("__from") - start) / MICROS
        right = (F.col("slot") * step - F.col("__to")) / MICROS
        left = F.when(left >= gap * 1.1, gap / 2).otherwise(left)
        to_zero = F.when((rise > 0) & (F.col("__first") >= 0), span * F.col("__first") / rise)
        left = F.least(left, F.coalesce(to_zero, left))
        right = F.when(right >= gap * 1.1, gap / 2).otherwise(right)
        rate = rise * ((span + left + right) / span) / window_s
    else:
        rate = rise / span
    return summed.filter((F.col("__n") > 1) & (F.col("__to") > F.col("__from"))).select(
        *by, F.timestamp_micros(F.col("slot") * step).alias("ts"), rate.alias("rate"))


def pair_values(samples: DataFrame, by: Sequence[str], num: str, den: str, value: str = "value") -> DataFrame:
    """Two metrics of the same labels and time side by side; rows that lack one drop out."""
    picked = samples.filter(F.col("metric").isin(num, den)).groupBy(*by, "ts").agg(
        F.max(F.when(F.col("metric") == num, F.col(value))).alias("num"),
        F.max(F.when(F.col("metric") == den, F.col(value))).alias("den"))
    return picked.filter(F.col("num").isNotNull() & F.col("den").isNotNull())


def divide(num: Column, den: Column) -> Column:
    """Float division: by zero gives NaN or an infinity, not an error."""
    signed = F.when(num > 0, float("inf")).when(num < 0, float("-inf")).otherwise(float("nan"))
    return F.when(den == 0, signed).otherwise(num / F.when(den != 0, den))


def gauge_ratio(samples: DataFrame, by: Sequence[str], num: str, den: str, floor: float | None = None) -> DataFrame:
    """``num / den`` per labels and time; ``floor`` keeps the divisor from falling below it."""
    den_value = F.col("den") if floor is None else F.greatest(F.col("den"), F.lit(float(floor)))
    return pair_values(samples, by, num, den).select(*by, "ts", divide(F.col("num"), den_value).alias("ratio"))


def match_ratio(samples: DataFrame, by: Sequence[str], matches: str, alerts: str) -> DataFrame:
    """Matches per alert, the divisor at least 1; near 1 when all is well."""
    return gauge_ratio(samples, by, matches, alerts, floor=1.0)


def drop_ratio(
    samples: DataFrame, by: Sequence[str], drops: str, packets: str, window_s: int = 300, percent: bool = False
) -> DataFrame:
    """Rate of drops over rate of packets (at least 1 per second), matched on labels and time.

    Both rates come from one pass: the metric is one more key of the series.
    """
    both = samples.filter(F.col("metric").isin(drops, packets))
    rates = counter_rate(both, ["metric", *by], window_s)
    paired = pair_values(rates, by, drops, packets, value="rate")
    ratio = F.col("num") / F.greatest(F.col("den"), F.lit(1.0)) * (100.0 if percent else 1.0)
    return paired.select(*by, "ts", ratio.alias("ratio"))


def rate_by_label(
    samples: DataFrame, metric: str, by: Sequence[str], label: str, step_s: int = 30, window_s: int = 300
) -> DataFrame:
    """Rates of all series summed per label value, at evaluation times."""
    rates = grid_rate(metric_select(samples, metric), [*by, label] if label not in by else by, step_s, window_s)
    return rates.groupBy(label, "ts").agg(F.sum("rate").alias("rate"))


def totals_rollup(samples: DataFrame, drop: str, value: str = "value") -> DataFrame:
    """Sums away one label column, such as the thread."""
    keep = [c for c in samples.columns if c not in (drop, value)]
    return samples.groupBy(*keep).agg(F.sum(value).alias(value))


def series_count(samples: DataFrame, labels: Sequence[str], drop: str) -> DataFrame:
    """Number of series with and without one label."""
    rest = [c for c in labels if c != drop]
    distinct = samples.select(*labels).distinct()
    before = distinct.groupBy(*rest).agg(F.count("*").alias("n"))
    return before.agg(F.sum("n").alias("series_before"), F.count("*").alias("series_after"))


def eval_grid(
    series: DataFrame, by: Sequence[str], step_s: int = 30, lookback_s: int = 300, value: str = "value"
) -> DataFrame:
    """Instant values every ``step_s``: the last sample at or before, at most ``lookback_s`` old.

    Samples first shrink to the last one per series and step, combined map-side. From there on a
    series has at most one row per step however many samples it had, so the window over a series is
    bounded by time, not by data. Each survivor covers the grid times up to the next survivor. Of samples
    of one time the largest value counts.
    """
    step = step_s * MICROS
    timed = series.withColumn("__us", F.unix_micros("ts"))
    slot = F.ceil(F.col("__us") / F.lit(step)).cast("long")
    last = timed.withColumn("__slot", slot).groupBy(*by, "__slot").agg(
        F.max(F.struct("__us", value)).alias("__last")).select(
        *by, "__slot", F.col("__last.__us").alias("__at"), F.col(f"__last.{value}").alias(value))
    reach = F.floor((F.col("__at") + lookback_s * MICROS) / F.lit(step)).cast("long")
    following = F.lead("__slot").over(Window.partitionBy(*by).orderBy("__slot")) - 1
    end = F.least(reach, F.coalesce(following, reach))
    covered = F.when(end >= F.col("__slot"), F.sequence("__slot", end)).otherwise(F.array().cast("array<bigint>"))
    return last.withColumn("__cover", covered).select(*by, F.explode("__cover").alias("__g"), value).select(
        *by, F.timestamp_micros(F.col("__g") * step).alias("ts"), value)


def _set_label(labels: Column, name: str, value: Column) -> Column:
    others = F.map_filter(labels, lambda k, _: k != name)
    return F.map_concat(others, F.create_map(F.lit(name), value))


def relabel(
    samples: DataFrame, copy: Mapping[str, str] | None = None, constant: Mapping[str, str] | None = None
) -> DataFrame:
    """Copies labels (target -> source), then sets constants; later ones win.

    A copy reads what the copies before it have set.
    """
    labels = F.col("labels")
    for target, source in (copy or {}).items():
        labels = _set_label(labels, target, F.try_element_at(labels, F.lit(source)))
    for target, value in (constant or {}).items():
        labels = _set_label(labels, target, F.lit(value))
    return samples.withColumn("labels", F.map_filter(labels, lambda _, v: v.isNotNull()))


def series_retention(samples: DataFrame, days: int = 30, time: str = "ts", now: datetime | None = None) -> DataFrame:
    """Samples younger than ``days`` before ``now``, or before the newest one, which takes a scan to find."""
    newest = samples.agg(F.max(time)).scalar() if now is None else F.lit(now)
    return samples.filter(F.col(time) > newest - F.make_dt_interval(days=F.lit(days)))


def recording_rules(
    samples: DataFrame, by: Sequence[str], rates: Mapping[str, str], drop_percent: tuple[str, str, str] | None = None,
    step_s: int = 30, window_s: int = 300,
) -> DataFrame:
    """New series at evaluation times: rates (new name -> metric) and a drop percentage.

    ``drop_percent`` is (new name, drops metric, packets metric). All input counters are rated in
    one pass; a metric may feed several names. One row per series and time holds all its rates, and all new series come
    out of that row.
    """
    wanted = set(rates.values()) | set(drop_percent[1:] if drop_percent else ())
    rated = grid_rate(samples.filter(F.col("metric").isin(*sorted(wanted))), ["metric", *by], step_s, window_s)
    column = {metric: f"__rate{i}" for i, metric in enumerate(sorted(wanted))}
    wide = rated.groupBy(*by, "ts").agg(*[
        F.max(F.when(F.col("metric") == metric, F.col("rate"))).alias(name) for metric, name in column.items()])
    made = [F.struct(F.lit(new).alias("metric"), F.col(column[metric]).alias("value")) for new, metric in rates.items()]
    if drop_percent:
        name, drops, packets = drop_percent
        percent = F.col(column[drops]) / F.greatest(F.col(column[packets]), F.lit(1.0)) * 100.0
        both = F.col(column[drops]).isNotNull() & F.col(column[packets]).isNotNull()
        made.append(F.struct(F.lit(name).alias("metric"), F.when(both, percent).alias("value")))
    series = wide.select(*by, "ts", F.inline_outer(F.array(*made)))
    return series.filter(F.col("value").isNotNull()).select("metric", *by, "ts", "value")


def write_recorded(recorded: DataFrame, path: str) -> None:
    """Recorded series as parquet by day, so retention and reads prune whole days."""
    recorded.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def retain_recorded(spark: SparkSession, path: str, days: int = 30, now: datetime | None = None) -> None:
    """Applies ``series_retention`` to series stored by ``write_recorded``, in place.

    Days that are wholly too old are deleted as folders, unread. Of the border day the younger rows are written anew; later
    days are not touched. Without ``now`` the newest sample counts, for which only the newest day is read. Running it again
    changes nothing. An interrupted run leaves each day as it was or as it shall be.
    """
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = store.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {s.getPath().getName().removeprefix("day="): s.getPath() for s in system.listStatus(store)
               if s.isDirectory() and s.getPath().getName().startswith("day=")}
    folders = {day: folder for day, folder in folders.items() if day[:1].isdigit()}  # not those of null times
    if not folders:
        return
    stored = spark.read.parquet(path)
    if now is None:
        newest = stored.filter(F.col("day") == F.lit(max(folders)).cast("date")).agg(F.max("ts").alias("ts"))
    else:
        newest = spark.range(1).select(F.lit(now).cast("timestamp").alias("ts"))
    limit = F.col("ts") - F.make_dt_interval(days=F.lit(days))
    border, micros = newest.select(F.to_date(limit).cast("string"), F.unix_micros(limit)).first()
    if border in folders:
        last = stored.filter(F.col("day") == F.lit(border).cast("date"))
        kept = materialize(last.filter(F.unix_micros("ts") > micros), "retained")  # a table cannot be overwritten while read
        if kept.isEmpty():
            system.delete(folders[border], True)
        else:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        delete_table(kept)
    for day, folder in folders.items():
        if day < border:
            system.delete(folder, True)
