"""Raw lines to typed columns. A line that does not fit never fails the job.

Every ``parse_*`` adds its typed columns plus ``ok`` and ``reason``; ``sources.sinks.write_routed``
sends the two kinds of rows to their places. All parsing is native column work: one regex pass
per line and format (``captures``), no Python.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineforge.functions import json as js
from lineforge.functions import text as tx

# Syslog keywords by code.
SEVERITIES = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
FACILITIES = [
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
    "ntp", "security", "console", "solaris-cron",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
]

CLASSIC_SYSLOG = (
    r"<(\d{1,3})>([A-Z][a-z]{2}) {1,2}(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[([^\]]*)\])?: ?((?s:.*))"
)
# An element's text: anything but a closing bracket, which quotes or a backslash allow.
SD_ELEMENT = r'\[(?:[^\]"\\]++|"(?:[^"\\]++|\\(?s:.))*+"|\\(?s:.))*+\]'
SD_NAME = r'[^\s=\]"]++'
SD_PARAM = rf'\s({SD_NAME})="((?:[^"\\]++|\\(?s:.))*+)"'
MODERN_SYSLOG = (
    rf"<(\d{{1,3}})>(\d{{1,2}}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:{SD_ELEMENT})++)(?: ((?s:.*)))?"
)
ACCESS_LINE = (
    r'(\S+) (\S+) (\S+) \[([^\]]+)\] "(?:([A-Z]+) (\S+)(?: HTTP/([0-9.]+))?|([^"]*))" (\d{3}) (\d+|-)'
    r'(?: "((?:[^"\\]++|\\.)*+)" "((?:[^"\\]++|\\.)*+)")?\s*'
)
APP_LINE = (
    r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?) \[([^\]]+)\] (\w+) ([^ ]+) - ((?s:.+))"
)


def _when_ok(ok: Column, reason: str) -> Column:
    return F.when(~ok, F.lit(reason))


def detect_format_of(text: Column) -> Column:
    """Ordered tests on the (stripped) line: the first that fits names the format."""
    line = tx.strip(text)
    return (
        F.when(line.startswith("{") | line.startswith("["), "json")
        .when(line.rlike(r"^<\d+>"), "syslog")
        .when(line.rlike(r"^\S+ \S+ \S+ \[[^\]]+\] \""), "access")
        .when(line.rlike(r"^\d{4}-\d{2}-\d{2} \S+ \[[^\]]+\] \w+ \S+ - "), "app")
        .when(line.rlike(r"^[\w.-]+[=:](?:\"|'|\S)"), "key_value")
        .when(line.contains(","), "csv")
        .when(line.rlike(r"\b[\w.-]+=\S"), "logfmt")
        .otherwise("regex")
    )


def detect_format(lines: DataFrame, col: str = "raw") -> DataFrame:
    return lines.withColumn("format", detect_format_of(F.col(col)))


# ---- syslog ------------------------------------------------------------------------------------

def structured_data(text: Column) -> Column:
    """Elements of RFC 5424 structured data as a map of maps, escapes in values undone; null for ``-``.

    A repeated element or parameter keeps its last value. Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``.
    """
    def element(e: Column) -> Column:
        names = F.regexp_extract_all(e, F.lit(SD_PARAM), F.lit(1))
        values = F.transform(
            F.regexp_extract_all(e, F.lit(SD_PARAM), F.lit(2)), lambda v: F.regexp_replace(v, r'\\(["\\\]])', "$1"))
        return F.struct(
            F.regexp_extract(e, rf"\A\[({SD_NAME})", 1).alias("key"), F.map_from_arrays(names, values).alias("value"))

    elements = F.regexp_extract_all(text, F.lit(SD_ELEMENT), F.lit(0))
    return F.when(text.startswith("["), F.map_from_entries(F.transform(elements, element)))


def _with_syslog(rows: DataFrame, text: Column, year: int | None) -> DataFrame:
    """Adds ``__s``: both syslog forms as one struct, null where neither fits."""
    year_text = F.lit(str(year)) if year is not None else F.year(F.current_date()).cast("string")
    c, m = F.col("__c"), F.col("__m")
    matched = tx.with_captures(rows, "__c", text, CLASSIC_SYSLOG, 8)
    matched = tx.with_captures(matched, "__m", F.when(c.isNull(), text), MODERN_SYSLOG, 9)
    stamp = F.concat_ws(" ", year_text, c[1], c[2], c[3])
    classic = F.struct(
        c[0].cast("int").alias("pri"), F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss")).alias("timestamp"),
        c[4].alias("hostname"), c[5].alias("appname"), tx.blank_to_null(c[6]).alias("procid"),
        F.lit(None).cast("string").alias("msgid"), F.lit(None).cast("int").alias("version"), c[7].alias("message"),
        F.lit(None).cast("string").alias("structured"))

    def dash(value: Column) -> Column:
        return F.nullif(value, F.lit("-"))

    modern = F.struct(
        m[0].cast("int").alias("pri"), F.try_to_timestamp(dash(m[2])).alias("timestamp"),
        dash(m[3]).alias("hostname"), dash(m[4]).alias("appname"), dash(m[5]).alias("procid"),
        dash(m[6]).alias("msgid"), m[1].cast("int").alias("version"), m[8].alias("message"),
        dash(m[7]).alias("structured"))
    either = F.when(c.isNotNull(), classic).when(m.isNotNull(), modern)
    filled = matched.withColumn("__s", either).drop("__c", "__m")
    return filled.withColumn("__s", F.when(F.col("__s.pri") <= 191, F.col("__s")))


def _keyword(codes: Sequence[str], index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in codes]), (index + 1).cast("int"))


def parse_syslog(lines: DataFrame, col: str = "raw", year: int | None = None) -> DataFrame:
    """RFC 3164 and RFC 5424 lines.

    The older form has neither year nor zone: ``year`` (default: this year) fills the first, the
    session zone the second. ``facility`` is the keyword of pri / 8, ``severity`` that of pri % 8.
    ``structured_data`` maps each element of the newer form to its parameters.
    """
    parsed = _with_syslog(lines, F.col(col), year)
    pri, s = F.col("__s.pri"), F.col("__s")
    ok = s.isNotNull() & F.col("__s.timestamp").isNotNull()
    code = F.floor(pri / 8).cast("int")
    typed = {
        "facility_code": code, "facility": _keyword(FACILITIES, code), "severity": _keyword(SEVERITIES, pri % 8),
        "timestamp": s["timestamp"], "hostname": s["hostname"], "appname": s["appname"], "procid": s["procid"],
        "msgid": s["msgid"], "version": s["version"], "message": s["message"],
        "structured_data": structured_data(s["structured"]),
    }
    return parsed.select(
        *lines.columns, *[F.when(ok, c).alias(n) for n, c in typed.items()],
        ok.alias("ok"), _when_ok(ok, "not syslog").alias("reason"))


# ---- access log --------------------------------------------------------------------------------

def parse_access_log(lines: DataFrame, col: str = "raw") -> DataFrame:
    """Common and combined web access lines."""
    parsed = tx.with_captures(lines, "__c", F.col(col), ACCESS_LINE, 12)
    c = F.col("__c")
    stamp = F.try_to_timestamp(c[3], F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    ok = c.isNotNull() & stamp.isNotNull()
    typed = {
        "clientip": c[0], "ident": c[1], "auth": c[2], "timestamp": stamp,
        "verb": tx.blank_to_null(c[4]),
        "request": F.coalesce(tx.blank_to_null(c[5]), c[7]),
        "httpversion": tx.blank_to_null(c[6]), "status": F.expr("try_cast(__c[8] AS INT)"),
        "bytes": F.expr("try_cast(__c[9] AS BIGINT)"),
        "referrer": tx.blank_to_null(c[10]), "agent": tx.blank_to_null(c[11]),
    }
    return parsed.select(
        *lines.columns, *[F.when(ok, v).alias(n) for n, v in typed.items()],
        ok.alias("ok"), _when_ok(ok, "not an access line").alias("reason"))


# ---- JSON --------------------------------------------------------------------------------------

# Output column -> (member path, type). "epoch" reads seconds since 1970, "lower" lowers the case.
APP_JSON = {
    "timestamp": ("timestamp", "timestamp"), "level": ("level", "lower"), "service": ("service", "string"),
    "msg": ("msg", "string"), "user_id": ("user_id", "long"), "trace_id": ("trace_id", "string"),
}
PROPS_JSON = {
    "timestamp": ("ts", "epoch"), "event_type": ("event", "string"), "user_id": ("props.uid", "string"),
    "client_ip": ("props.ip", "string"), "user_agent": ("props.ua", "string"),
}


def epoch(seconds: Column) -> Column:
    """Seconds since 1970 as a time; null outside the years 1 to 9999."""
    return F.timestamp_seconds(F.when(seconds.between(-62_135_596_800, 253_402_300_799), seconds))


def _json_field(event: Column, path: str, kind: str) -> Column:
    where = "$." + path
    if kind == "timestamp":
        return F.try_to_timestamp(F.try_variant_get(event, where, "string"))
    if kind == "epoch":
        return epoch(F.try_variant_get(event, where, "double"))
    if kind == "lower":
        return F.lower(F.try_variant_get(event, where, "string"))
    return F.try_variant_get(event, where, kind)


def parse_json_log(
    lines: DataFrame, col: str = "raw", fields: Mapping[str, tuple[str, str]] = APP_JSON,
    message_field: str | None = "message", keep_extra: bool = True,
) -> DataFrame:
    """JSON object lines, or objects carried as text in ``message_field`` of one.

    ``fields`` lists the typed columns. A listed field that is there but does not fit its type
    makes the row a reject. Top-level members no field reads land in ``extra`` as text.
    """
    parsed = lines.withColumn("__outer", F.try_parse_json(F.col(col)))
    if message_field:
        inner = F.try_parse_json(F.try_variant_get(F.col("__outer"), f"$.{message_field}", "string"))
        parsed = parsed.withColumn("__inner", inner)
        whole = F.when(js.fields(F.col("__inner")).isNotNull(), F.col("__inner")).otherwise(F.col("__outer"))
    else:
        whole = F.col("__outer")
    parsed = parsed.withColumn("__e", whole).withColumn("__map", js.fields(F.col("__e")))
    event, is_object = F.col("__e"), F.col("__map").isNotNull()
    typed = {name: _json_field(event, path, kind) for name, (path, kind) in fields.items()}
    unfit = F.filter(F.array(*[
        F.when(F.try_variant_get(event, "$." + path, "string").isNotNull() & typed[name].isNull(), F.lit(name))
        for name, (path, _) in fields.items()]), lambda n: n.isNotNull())
    parsed = parsed.withColumn("__unfit", unfit)
    ok = is_object & (F.size("__unfit") == 0)
    reason = F.when(~is_object, "not a JSON object").when(
        F.size("__unfit") > 0, F.concat(F.lit("bad field: "), F.array_join("__unfit", ",")))
    columns = [F.when(is_object, c).alias(n) for n, c in typed.items()]
    if keep_extra:
        used = {path.split(".")[0] for path, _ in fields.values()} | ({message_field} if message_field else set())
        rest = F.map_filter(F.col("__map"), lambda k, _: ~k.isin(*sorted(used)))
        columns.append(F.transform_values(rest, lambda _, v: js.text_of(v)).alias("extra"))
    return parsed.select(*lines.columns, *columns, ok.alias("ok"), reason.alias("reason"))


# ---- key-value ---------------------------------------------------------------------------------

def _escaped(delimiter: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch not in " \t" else ch for ch in delimiter)


def key_value_map(
    text: Column, key_value_delimiter: str = "=", field_delimiter: str = " ", standalone_keys: bool = False
) -> Column:
    """Key-value text as a map; values may be quoted either way and then hold any delimiter.

    A repeated key keeps its last value. Words without a delimiter are skipped, or with
    ``standalone_keys`` map to ``true``. Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN``.
    """
    kv, fd = _escaped(key_value_delimiter), _escaped(field_delimiter)
    gap = r"\s" if field_delimiter.strip() == "" else fd
    if len(key_value_delimiter) == len(field_delimiter) == 1:
        word, bare = rf"[^{kv}{gap}]++", rf"[^{gap}]*+"
    else:
        word, bare = rf"(?:(?!{kv}|{gap}).)++", rf"(?:(?!{gap}).)*+"
    value = rf"\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'|{bare}"
    optional = "?+" if standalone_keys else ""
    # A key starts the text or follows a gap, so long words without a delimiter are read once.
    pair = rf"(?:^|(?<={gap}))({word})({kv}(?:{value})){optional}"
    keys = F.regexp_extract_all(text, F.lit(pair), F.lit(1))
    rest = F.regexp_extract_all(text, F.lit(pair), F.lit(2))

    def read(v: Column) -> Column:
        bare_value = F.substr(v, F.lit(len(key_value_delimiter) + 1))
        unquoted = F.regexp_replace(bare_value, r"(?s)\A([\"'])(.*)\1\z", "$2")
        return F.when(v == "", F.lit("true")).otherwise(unquoted) if standalone_keys else unquoted

    return F.map_from_arrays(F.transform(keys, tx.strip), F.transform(rest, read))


def parse_key_value(
    lines: DataFrame, col: str = "raw", key_value_delimiter: str = "=", field_delimiter: str = " ",
    fields: Mapping[str, tuple[str, str]] | None = None, standalone_keys: bool = False,
) -> DataFrame:
    """Key-value lines: ``fields`` map of the pairs, less the keys read into typed columns.

    ``fields`` maps output column to (key, type); types as in ``coerce``.
    """
    pairs = key_value_map(F.col(col), key_value_delimiter, field_delimiter, standalone_keys)
    parsed = lines.withColumn("__kv", pairs)
    return _typed_pairs(parsed, lines.columns, fields or {}, F.size("__kv") > 0, "no key-value pairs")


def _typed_pairs(
    parsed: DataFrame, keep: Sequence[str], fields: Mapping[str, tuple[str, str]], fits: Column, reason: str
) -> DataFrame:
    raw = {name: F.try_element_at(F.col("__kv"), F.lit(key)) for name, (key, _) in fields.items()}
    typed = {name: coerce(raw[name], kind) for name, (_, kind) in fields.items()}
    unfit = F.filter(F.array(
        F.lit(None).cast("string"),
        *[F.when(raw[n].isNotNull() & typed[n].isNull(), F.lit(n)) for n in fields]), lambda n: n.isNotNull())
    parsed = parsed.withColumn("__unfit", unfit).withColumn("__fits", F.coalesce(fits, F.lit(False)))
    fits = F.col("__fits")
    used = [key for key, _ in fields.values()]
    rest = F.map_filter(F.col("__kv"), lambda k, _: ~k.isin(*used)) if used else F.col("__kv")
    ok = fits & (F.size("__unfit") == 0)
    why = F.when(~fits, reason).when(
        F.size("__unfit") > 0, F.concat(F.lit("bad field: "), F.array_join("__unfit", ",")))
    return parsed.select(
        *keep, *[F.when(fits, c).alias(n) for n, c in typed.items()], F.when(fits, rest).alias("fields"),
        ok.alias("ok"), why.alias("reason"))


# ---- CSV ---------------------------------------------------------------------------------------

# (column, type) by position. A "date" and a "time" column make one timestamp.
ACCESS_CSV = [
    ("date", "string"), ("time", "string"), ("client_ip", "string"), ("method", "string"), ("path", "string"),
    ("status", "long"), ("duration", "double"),
]


BAD_CSV = "_bad_record"


def _csv_cells(text: Column, names: Sequence[str], delimiter: str = ",") -> Column:
    """Cells by name as text; ``BAD_CSV`` is set where their number is wrong."""
    schema = ", ".join(f"`{n}` STRING" for n in [*names, BAD_CSV])
    options = {
        "sep": delimiter, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": BAD_CSV}
    return F.from_csv(text, F.lit(schema), options)


def parse_csv_log(
    lines: DataFrame, col: str = "raw", columns: Sequence[tuple[str, str]] = ACCESS_CSV, delimiter: str = ",",
) -> DataFrame:
    """Positional CSV lines; quoted cells may hold the delimiter."""
    names = [name for name, _ in columns]
    parsed = lines.withColumn("__c", _csv_cells(F.col(col), names, delimiter))
    cells = {name: F.col(f"__c.{name}") for name in names}
    right_width = (tx.strip(F.col(col)) != "") & F.col("__c").isNotNull() & F.col(f"__c.{BAD_CSV}").isNull()
    typed: dict[str, Column] = {}
    raw: dict[str, Column] = {}
    if "date" in cells and "time" in cells:
        raw["timestamp"] = F.concat(cells["date"], F.lit(" "), cells["time"])
        typed["timestamp"] = F.try_to_timestamp(raw["timestamp"], F.lit("yyyy-MM-dd HH:mm:ss"))
    for name, kind in columns:
        if name in ("date", "time") and "timestamp" in typed:
            continue
        raw[name], typed[name] = cells[name], coerce(cells[name], kind)
    unfit = F.filter(F.array(*[
        F.when(raw[n].isNotNull() & typed[n].isNull(), F.lit(n)) for n in typed]), lambda n: n.isNotNull())
    parsed = parsed.withColumn("__unfit", F.when(right_width, unfit))
    ok = F.coalesce(right_width & (F.size("__unfit") == 0), F.lit(False))
    why = F.when(~F.coalesce(right_width, F.lit(False)), "wrong number of columns").when(
        F.size("__unfit") > 0, F.concat(F.lit("bad field: "), F.array_join("__unfit", ",")))
    return parsed.select(
        *lines.columns, *[F.when(right_width, c).alias(n) for n, c in typed.items()],
        ok.alias("ok"), why.alias("reason"))


# ---- application log and nested ----------------------------------------------------------------

PAYMENT_FIELDS = {
    "order_id": ("order_id", "string"), "amount": ("amount", "double"), "currency": ("currency", "string"),
    "reason_text": ("reason", "string"),
}
AUDIT_FIELDS = {
    "db_user": ("DBUSER", "string"), "action_code": ("ACTION", "string"), "return_code": ("RETCODE", "string"),
}


def parse_app_log(
    lines: DataFrame, col: str = "raw", fields: Mapping[str, tuple[str, str]] = PAYMENT_FIELDS
) -> DataFrame:
    """``time [thread] LEVEL logger - body`` with key-value pairs in the body.

    ``fields`` are read from the body. The body's own ``reason`` is put in ``reason_text``, since
    ``reason`` tells why a line was rejected.
    """
    parsed = tx.with_captures(lines, "__h", F.col(col), APP_LINE, 5)
    h = F.col("__h")
    parsed = parsed.select(
        *lines.columns, F.try_to_timestamp(h[0]).alias("timestamp"), h[1].alias("thread"),
        F.lower(h[2]).alias("level"), h[3].alias("logger"), h.isNotNull().alias("__head"),
        key_value_map(h[4]).alias("__kv"))
    keep = [*lines.columns, "timestamp", "thread", "level", "logger"]
    return _typed_pairs(parsed, keep, fields, F.col("__head") & F.col("timestamp").isNotNull(), "no header")


def parse_nested(
    lines: DataFrame, col: str = "raw", year: int | None = None, key_value_delimiter: str = ":",
    fields: Mapping[str, tuple[str, str]] = AUDIT_FIELDS,
) -> DataFrame:
    """Syslog whose message is key-value text, such as ``KEY:'VALUE'`` audit records."""
    s = F.col("__s")
    parsed = _with_syslog(lines, F.col(col), year).select(
        *lines.columns, s["hostname"].alias("hostname"), s["appname"].alias("appname"),
        s["timestamp"].alias("timestamp"), s.isNotNull().alias("__head"),
        key_value_map(s["message"], key_value_delimiter).alias("__kv"))
    keep = [*lines.columns, "hostname", "appname", "timestamp"]
    fits = F.col("__head") & (F.size("__kv") > 0)
    return _typed_pairs(parsed, keep, fields, fits, "no nested pairs")


# ---- the caller's own patterns -----------------------------------------------------------------

# Named patterns for ``parse_groks``. A pattern may use others.
GROKS = {
    "WORD": r"\w+", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*",
    "INT": r"[+-]?\d+", "NUMBER": r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)", "POSINT": r"[1-9]\d*",
    "QUOTEDSTRING": r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'",
    "UUID": r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}", "MAC": r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}",
    "IPV4": r"\d{1,3}(?:\.\d{1,3}){3}", "IPV6": r"[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*", "IP": r"%{IPV6}|%{IPV4}",
    "HOSTNAME": r"[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*", "IPORHOST": r"%{IP}|%{HOSTNAME}",
    "USERNAME": r"[a-zA-Z0-9._-]+", "PATH": r"/\S*", "LOGLEVEL": r"[A-Za-z]+",
    "TIMESTAMP_ISO8601": r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?",
    "HTTPDATE": r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}",
    "SYSLOGTIMESTAMP": r"[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}",
}


def named_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """A pattern with plain groups, and the number of each group that had a name.

    Both spellings of a named group are read. Names repeat in a pattern at the caller's risk: the last group counts.
    """
    out, names, count, at, in_class = [], {}, 0, 0, False
    while at < len(pattern):
        char = pattern[at]
        if char == "\\":
            out.append(pattern[at:at + 2])
            at += 2
            continue
        name = None if in_class else re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[at:])
        if name:
            count += 1
            names[name[1]] = count
            out.append("(")
            at += len(name[0])
            continue
        if char == "(" and not in_class and not pattern.startswith("(?", at):
            count += 1
        in_class = (char == "[" and not in_class) or (in_class and char != "]")
        out.append(char)
        at += 1
    return "".join(out), names


def parse_regex(
    lines: DataFrame, patterns: Sequence[str], col: str = "raw", fields: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Lines by the caller's patterns with named groups; the first pattern in order that is found in a line wins.

    Adds ``pattern`` (its number from 0), the typed columns of ``fields`` (column to (group, type)), ``fields`` with
    the other groups, ``ok`` and ``reason``. Groups that matched nothing are left out. A pattern is found anywhere unless it
    is anchored. A line is matched by a pattern only if none before it matched, and once.
    """
    found, prepared = [], lines
    for i, pattern in enumerate(patterns):
        plain, names = named_groups(pattern)
        before = F.lit(True)
        for earlier, _ in found:
            before = before & F.col(earlier).isNull()
        groups = re.compile(plain).groups
        prepared = tx.with_captures(
            prepared, f"__p{i}", F.when(before, F.col(col)), rf"(?s:.*?)(?:{plain})(?s:.*)", groups)
        found.append((f"__p{i}", names))
    number, pairs = F.lit(None).cast("int"), F.lit(None).cast("map<string,string>")
    for i, (name, names) in reversed(list(enumerate(found))):
        hit = F.col(name).isNotNull()
        cells = [F.struct(F.lit(n).alias("key"), F.get(name, F.lit(g - 1)).alias("value")) for n, g in names.items()]
        entries = F.array(*cells) if cells else F.array().cast("array<struct<key:string,value:string>>")
        number = F.when(hit, F.lit(i)).otherwise(number)
        pairs = F.when(hit, F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))).otherwise(pairs)
    parsed = prepared.select(*lines.columns, number.alias("pattern"), pairs.alias("__kv"))
    return _typed_pairs(parsed, [*lines.columns, "pattern"], fields or {}, F.col("__kv").isNotNull(), "no pattern found")


def expand_groks(pattern: str, named: Mapping[str, str] = GROKS) -> tuple[str, dict[str, str]]:
    """``%{NAME}``, ``%{NAME:field}`` and ``%{NAME:field:type}`` as a plain pattern, and the types asked for."""
    types: dict[str, str] = {}

    def expand(text: str, open_names: tuple[str, ...]) -> str:
        def one(match: re.Match) -> str:
            name, field, kind = match[1], match[2], match[3]
            if name not in named or name in open_names:
                raise ValueError(f"unknown or circular pattern {name!r}")
            if field and kind:
                types[field] = kind
            inner = expand(named[name], (*open_names, name))
            return f"(?<{field}>{inner})" if field else f"(?:{inner})"

        return re.sub(r"%\{(\w+)(?::(\w+))?(?::(\w+))?\}", one, text)

    return expand(pattern, ()), types


def parse_groks(
    lines: DataFrame, patterns: Sequence[str], col: str = "raw", aliases: Mapping[str, str] | None = None,
) -> DataFrame:
    """``parse_regex`` with patterns that use named ones, from ``GROKS`` and the caller's ``aliases``.

    A field with a type, ``%{INT:status:int}``, becomes a column of that type (see ``coerce``); the others are in ``fields``.
    """
    expanded = [expand_groks(p, {**GROKS, **(aliases or {})}) for p in patterns]
    fields = {name: (name, kind) for _, types in expanded for name, kind in types.items()}
    return parse_regex(lines, [p for p, _ in expanded], col, fields)


# ---- several shapes in one source --------------------------------------------------------------

# Members and keys that the common columns read; of the several names of a time, the first that is there.
MIXED_JSON = ["level", "service", "msg"]
MIXED_PAIRS = ["level", "component", "method", "path", "status"]
JSON_TIMES, PAIR_TIMES = ["timestamp", "time"], ["time", "timestamp", "ts"]


def _extra(kind: Column, s: Column, a: Column, j: Column, h: Column, kv: Column, v: Column) -> Column:
    """What ``parse_mixed`` does not read of a line, as text by name."""
    def named(**cells: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(name).alias("key"), cell.alias("value")) for name, cell in cells.items()])
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")))

    def without(pairs: Column, read: list[str], times: list[str]) -> Column:
        first = F.coalesce(*[F.when(F.map_contains_key(pairs, t), F.lit(t)) for t in times], F.lit(""))
        return F.map_filter(pairs, lambda k, x: ~k.isin(*read) & (k != first) & x.isNotNull())

    def dash(cell: Column) -> Column:
        return F.nullif(cell, F.lit("-"))

    code = F.floor(s["pri"] / 8).cast("int")
    elements = F.map_entries(structured_data(s["structured"]))
    parameters = F.flatten(F.transform(elements, lambda e: F.transform(
        F.map_entries(e["value"]), lambda p: F.struct(F.concat(e["key"], F.lit("."), p["key"]).alias("key"), p["value"]))))
    syslog = F.map_concat(
        named(facility=_keyword(FACILITIES, code), hostname=s["hostname"], procid=s["procid"], msgid=s["msgid"],
              version=s["version"].cast("string")),
        F.coalesce(F.map_from_entries(parameters), F.create_map().cast("map<string,string>")))
    members = F.transform_values(js.fields(j), lambda _, x: js.text_of(x))
    return (
        F.when(kind == "syslog", F.when(s.isNotNull(), syslog))
        .when(kind == "access", F.when(a.isNotNull(), named(
            ident=dash(a[1]), auth=dash(a[2]), httpversion=a[6], request=a[7], bytes=dash(a[9]), referrer=dash(a[10]),
            agent=dash(a[11]))))
        .when(kind == "json", without(members, MIXED_JSON, JSON_TIMES))
        .when(kind == "app", F.when(h.isNotNull(), F.map_concat(named(thread=h[1]), key_value_map(h[4]))))
        .when(kind.isin("key_value", "logfmt"), without(kv, MIXED_PAIRS, PAIR_TIMES))
        .when(kind == "csv", named(duration=v["duration"])))


def parse_mixed(lines: DataFrame, col: str = "raw", year: int | None = None) -> DataFrame:
    """Lines of any known format to common columns and the rest as ``extra``, in one pass over the data.

    ``extra`` maps every other field that a line has to its text, by the name that the format's own parser gives it;
    structured data come as ``element.parameter``. Each format's work is guarded by the detected format, so a line
    pays for its own format only.
    """
    detected = detect_format(lines, col)
    text, kind = F.col(col), F.col("format")
    prepared = _with_syslog(detected, F.when(kind == "syslog", text), year)
    prepared = tx.with_captures(prepared, "__a", F.when(kind == "access", text), ACCESS_LINE, 12)
    prepared = tx.with_captures(prepared, "__h", F.when(kind == "app", text), APP_LINE, 5)
    prepared = prepared.select(
        "*",
        F.when(kind == "json", F.try_parse_json(text)).alias("__j"),
        F.when(kind.isin("key_value", "logfmt"), key_value_map(text)).alias("__kv"),
        F.when(kind == "csv", _csv_cells(text, [n for n, _ in ACCESS_CSV])).alias("__v"),
    )
    s, a, j, h, kv, v = (F.col(n) for n in ("__s", "__a", "__j", "__h", "__kv", "__v"))

    def key(name: str) -> Column:
        return F.try_element_at(kv, F.lit(name))

    def member(name: str) -> Column:
        return F.try_variant_get(j, f"$.{name}", "string")

    stamp = (
        F.when(kind == "syslog", s["timestamp"])
        .when(kind == "access", F.try_to_timestamp(a[3], F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
        .when(kind == "json", F.try_to_timestamp(F.coalesce(member("timestamp"), member("time"))))
        .when(kind == "app", F.try_to_timestamp(h[0]))
        .when(kind.isin("key_value", "logfmt"), F.try_to_timestamp(F.coalesce(key("time"), key("timestamp"), key("ts"))))
        .when(kind == "csv", F.try_to_timestamp(F.concat(v["date"], F.lit(" "), v["time"])))
    )
    level = F.lower(F.coalesce(_keyword(SEVERITIES, s["pri"] % 8), member("level"), h[2], key("level")))
    service = F.coalesce(s["appname"], member("service"), h[3], key("component"))
    client = F.coalesce(a[0], v["client_ip"])
    method = F.coalesce(tx.blank_to_null(a[4]), key("method"), v["method"])
    path = F.coalesce(tx.blank_to_null(a[5]), key("path"), v["path"])
    status = F.coalesce(a[8], key("status"), v["status"]).try_cast("int")
    message = F.coalesce(s["message"], member("msg"), h[4])
    common = prepared.select(
        *lines.columns, "format", stamp.alias("timestamp"), level.alias("level"), service.alias("service"),
        client.alias("client_ip"), method.alias("method"), path.alias("path"), status.alias("status"),
        message.alias("message"), _extra(kind, s, a, j, h, kv, v).alias("extra"))
    ok = F.col("timestamp").isNotNull()
    return common.select(
        "*", ok.alias("ok"), F.when(~ok, F.concat(F.lit("cannot parse as "), F.col("format"))).alias("reason"))


# ---- coercion and object clean-up --------------------------------------------------------------

def coerce(text: Column, kind: str) -> Column:
    """Text to a type; null where it does not fit.

    Boolean words are true/false, yes/no and 0/1 in any case.
    """
    if kind == "string":
        return text
    if kind == "lower":
        return F.lower(text)
    if kind == "bool":
        word = F.lower(tx.strip(text))
        return F.when(word.isin("true", "yes", "1", "t", "y"), True).when(
            word.isin("false", "no", "0", "f", "n"), False)
    if kind == "timestamp":
        return F.try_to_timestamp(text)
    if kind == "epoch":
        return epoch(text.try_cast("double"))
    return text.try_cast(kind)


def coerce_fields(rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Casts the named text columns; a value that does not fit makes the row a reject."""
    typed = {name: coerce(F.col(name), kind) for name, kind in fields.items()}
    unfit = F.filter(F.array(*[
        F.when(F.col(n).isNotNull() & c.isNull(), F.lit(n)) for n, c in typed.items()]), lambda n: n.isNotNull())
    checked = rows.withColumn("__unfit", unfit)
    reason = F.when(F.size("__unfit") > 0, F.concat(F.lit("bad field: "), F.array_join("__unfit", ",")))
    return checked.select(
        *[typed[c].alias(c) if c in typed else F.col(c) for c in rows.columns],
        (F.size("__unfit") == 0).alias("ok"), reason.alias("reason"))


# One JSON token: a key with its colon, a value or a closing bracket with the comma after it, an opening bracket.
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"[:,]?|[{\[]|[}\]],?|[^\s"{}\[\],:]++,?'
TOKENS_AT_ONCE = 64  # a fold copies what it has gathered at every step, so it gathers from short runs of tokens
CUT = "\n"  # between open keys as they are spelled; no JSON string holds a line end but as an escape
MEMBERS = "array<struct<key:string,value:string>>"


def _bare(token: Column) -> Column:
    """The text of a JSON string without quotes; escapes are decoded where there are any."""
    decoded = F.try_variant_get(F.try_parse_json(token), "$", "string")
    return F.when(F.instr(token, "\\") > 0, decoded).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def _walk(state: Column, token: Column) -> Column:
    """Where a walk over JSON tokens stands after one more: open keys, last key, open brackets of an array value."""
    first = F.left(token, F.lit(1))
    in_array = state["brackets"] > 0
    brackets = state["brackets"] + F.when(first.isin("[", "{"), 1).when(first.isin("]", "}"), -1).otherwise(0)
    is_key = ~in_array & (first == '"') & token.endswith(":")
    # the outermost object has no key; open keys are one text, as an array would be copied member by member at every step
    opens, closes = ~in_array & (first == "{") & state["key"].isNotNull(), ~in_array & (first == "}")
    depth = F.when(opens, state["depth"] + 1).when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(state["depth"])
    path = F.when(opens, F.concat(state["path"], state["key"], F.lit(CUT))).when(
        closes & (state["depth"] > 1), F.concat(F.call_function("substring_index", state["path"], F.lit(CUT), state["depth"] - 1), F.lit(CUT))).when(
        closes, F.lit("")).otherwise(state["path"])
    return F.struct(
        (state["at"] + 1).alias("at"),
        F.when(in_array | (first != "["), state["opened"]).otherwise(state["at"]).alias("opened"),
        F.when(in_array, brackets).when(first == "[", 1).otherwise(0).alias("brackets"),
        path.alias("path"), depth.alias("depth"),
        F.when(is_key, F.substring(token, F.lit(2), F.length(token) - 3)).otherwise(state["key"]).alias("key"))


def _member(state: Column, token: Column, tokens: Column, separator: str) -> Column:
    """The member that a token completes, a struct of path and value; null if it completes none."""
    first = F.left(token, F.lit(1))
    in_array = state["brackets"] > 0
    closes = in_array & (state["brackets"] == 1) & first.isin("]", "}")
    scalar = ~in_array & ~first.isin("{", "}", "[") & ~((first == '"') & token.endswith(":"))
    array = F.array_join(F.slice(tokens, state["opened"], state["at"] - state["opened"] + 1), "")
    value = F.rtrim(F.when(in_array, array).otherwise(token), F.lit(","))
    worded = F.when(in_array, F.nullif(value, F.lit("[]"))).when(first == '"', _bare(value)).otherwise(
        F.nullif(value, F.lit("null")))
    whole = F.concat(state["path"], state["key"])
    decoded = F.array_join(F.transform(F.split(whole, CUT), lambda k: _bare(F.concat(F.lit('"'), k, F.lit('"')))), separator)
    path = F.when(F.instr(whole, "\\") > 0, decoded).otherwise(F.replace(whole, F.lit(CUT), F.lit(separator)))
    return F.when(closes | scalar, F.struct(path.alias("key"), worded.alias("value")))


def flatten_object(text: Column, separator: str = ".") -> Column:
    """Nested members of a JSON object as one map with dotted keys, whatever the depth.

    Arrays are values. Null values and empty arrays are null, empty objects are left out, and text that
    holds no object gives null. A fold walks the tokens with a stack of keys, so neither the plan nor its
    analysis depends on the data. Long texts are walked twice: first for where the walk stands at the start of each
    run of tokens, then run by run for the members. Spark's parser reads at most 1,000 levels; deeper text gives null.
    """
    start = F.struct(
        F.lit(1).alias("at"), F.lit(0).alias("opened"), F.lit(0).alias("brackets"),
        F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"))

    def members(tokens: Column) -> Column:
        run = lambda i: F.slice(tokens, i * TOKENS_AT_ONCE + 1, F.lit(TOKENS_AT_ONCE))

        def gather(acc: Column, token: Column) -> Column:
            found = _member(acc["state"], token, tokens, separator)
            return F.struct(
                _walk(acc["state"], token).alias("state"),
                F.when(found.isNull(), acc["found"]).otherwise(F.array_append(acc["found"], found)).alias("found"))

        def gathered(part: Column, state: Column) -> Column:
            begin = F.struct(state.alias("state"), F.array().cast(MEMBERS).alias("found"))
            return F.aggregate(part, begin, gather, lambda acc: acc["found"])

        def pass_run(acc: Column, i: Column) -> Column:
            return F.struct(
                F.aggregate(run(i), acc["state"], _walk).alias("state"), F.array_append(acc["before"], acc["state"]).alias("before"))

        runs = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / TOKENS_AT_ONCE).cast("int"))
        states = F.aggregate(
            runs, F.struct(start.alias("state"), F.slice(F.array(start), F.lit(1), F.lit(0)).alias("before")), pass_run, lambda acc: acc["before"])
        long = F.flatten(F.zip_with(runs, states, lambda i, state: gathered(run(i), state)))
        return F.map_from_entries(F.when(F.size(tokens) <= TOKENS_AT_ONCE, gathered(tokens, start)).otherwise(long))

    # one spelling: no white space, no repeated keys, numbers without trailing zeros
    whole = F.to_json(F.try_parse_json(text))
    # arrays of one name values that are used more than once
    found = F.transform(F.array(whole), lambda w: F.when(
        w.startswith("{"), F.regexp_extract_all(w, F.lit(JSON_TOKEN), F.lit(0))))
    return F.transform(found, lambda tokens: F.when(tokens.isNotNull(), members(tokens)))[0]


def compact_map(pairs: Column) -> Column:
    """Drops members that are null or empty text. Empty arrays and objects are null by then."""
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def merge_maps(to: Column, source: Column) -> Column:
    """Members of both; those of ``source`` win. Needs ``mapKeyDedupPolicy=LAST_WIN``."""
    return F.map_concat(to, source)


def compact_flatten(
    events: DataFrame, col: str = "event_json", drop: Sequence[str] = (), merge: Column | None = None,
) -> DataFrame:
    """Adds ``flat``: the event flattened to dotted keys, merged, compacted, less some keys."""
    flat = flatten_object(F.col(col))
    if merge is not None:
        flat = merge_maps(flat, merge)
    flat = compact_map(flat)
    if drop:
        flat = F.map_filter(flat, lambda k, _: ~k.isin(*drop))
    return events.withColumn("flat", flat)
