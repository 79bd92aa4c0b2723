"""The registered queries once more, as DuckDB SQL over the same tables.

Views are rendered from the same templates. Parsing checks read the columns a line was rendered
from instead of repeating the patterns, so a line has to survive the round trip.
"""

from __future__ import annotations

from lineforge.functions import text as tx
from lineforge.operators import alerts, audit, ocsf, parsing, profiling
from lineforge.plans import catalog
from lineforge.plans.views import (
    CENTS, DUCK, FORMATS, HEALTH_FIELDS, LEVEL, LEVELS as DEPTH, METHOD, PRI, PROGRAMS, REASON, STAT_FIELDS, STATUS, amount, client_ip,
    event_columns, exposition_columns, line_columns, metric_samples_sql, pick, program_columns, reply_columns,
    run_columns, screen_text_columns, select_sql, state_columns,
)
from lineforge.sources import telemetry

ORACLES: dict[str, str] = {}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def view(name: str, columns: list[str], table: str = "events", where: str = "true") -> str:
    return f"{name} AS ({select_sql(columns, table, where)})"


def cases(pairs, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {other} END"


LINES = view("lines", line_columns(DUCK))
EVENTS_JSON = view("raw_events", event_columns(DUCK))
SCREEN = view("screen_text", screen_text_columns(DUCK), "documents")
REPLIES = view("replies", reply_columns(DUCK), "conversations", "role = 'assistant'")
VALUE_TEXT, CLIENT_IP = amount(DUCK), client_ip(DUCK)
SECOND = "date_trunc('second', ts)"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


# ---- fingerprints ------------------------------------------------------------------------------

def skeleton_of(text: str) -> str:
    for pattern, token in tx.SHAPE_RULES:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(token)}, 'g')"
    return text


SIGNED = f"signed AS (SELECT *, substr(sha256({skeleton_of('raw')}), 1, 16) AS signature FROM lines)"

ORACLES["line_skeleton"] = f"WITH {LINES} SELECT line_id, {skeleton_of('raw')} AS skeleton FROM lines"
ORACLES["line_signature"] = f"WITH {LINES}, {SIGNED} SELECT line_id, signature FROM signed"
ORACLES["signature_rollup"] = f"""WITH {LINES}, {SIGNED}
SELECT source, signature, count(*) AS lines, min(line_id) AS first_id, arg_min(raw, line_id) AS sample
FROM signed GROUP BY source, signature"""

# ---- screening ---------------------------------------------------------------------------------

STRIP = "trim({}, " + lit(tx.WHITE_SPACE) + ")"


def sanitized(text: str) -> str:
    plain = rf"regexp_replace({text}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    return STRIP.format(rf"regexp_replace({plain}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def screened(text: str, dialect: str = "py") -> str:
    rules = list(tx.SCREEN_RULES)
    if dialect == "ts":
        rules[3] = (tx.SYSTEM_RULE_TS, rules[3][1])
    return cases((f"regexp_matches({text}, {lit('(?i)' + p)})", lit(d)) for p, d in rules)


ORACLES["sanitize_text"] = f"WITH {SCREEN} SELECT id, {sanitized('text')} AS text FROM screen_text"
ORACLES["check_injection"] = f"WITH {SCREEN} SELECT id, {screened('text')} AS matched FROM screen_text"
ORACLES["check_injection_ts"] = f"WITH {SCREEN} SELECT id, {screened('text', 'ts')} AS matched FROM screen_text"

FENCE_HEAD, FENCE_TAIL = r"\A```(?:vrl|rust|toml)?\n?", r"\n?```\z"
FENCED = r"(?s)```(?:vrl|rust|toml)?\n(.*?)\n?```"
STRIPPED = STRIP.format("text")
BARE = f"regexp_replace(regexp_replace({STRIPPED}, '{FENCE_HEAD}', ''), '{FENCE_TAIL}', '')"
ORACLES["strip_fences"] = f"WITH {REPLIES} SELECT id, {BARE} AS cleaned FROM replies"
ORACLES["extract_fenced"] = f"""WITH {REPLIES} SELECT id, CASE WHEN regexp_matches({STRIPPED}, '{FENCED}')
  THEN regexp_extract({STRIPPED}, '{FENCED}', 1) ELSE {BARE} END AS cleaned FROM replies"""
ORACLES["off_task_flag"] = f"WITH {REPLIES} SELECT id, " + " OR ".join(
    f"starts_with(lower({BARE}), {lit(o)})" for o in tx.OFF_TASK_OPENINGS) + " AS suspicious FROM replies"

# ---- sources and sinks -------------------------------------------------------------------------

ORACLES["scan_events"] = f"""WITH {EVENTS_JSON}
SELECT CASE WHEN event_id % 10 = 7 THEN 'bad ' || event_json ELSE event_json END AS text,
  event_id % 10 <> 7 AS ok, CASE WHEN event_id % 10 = 7 THEN 'not valid JSON' END AS reason FROM raw_events"""
ORACLES["scan_events_array"] = "SELECT event_type AS event, user_id, true AS ok FROM events"
ORACLES["scan_lines"] = f"WITH {LINES} SELECT raw FROM lines"
ORACLES["detect_input_shape"] = """
WITH filled AS (SELECT event_id % 7 AS part, event_id // 50000 AS chunk,
  count(CASE WHEN event_id % 7 < 3 OR event_id IN (6, 13, 20) THEN 1 END) AS objects FROM events GROUP BY 1, 2)
SELECT part, chunk, objects, CASE WHEN part = 5 OR objects > 3 THEN 'batch' ELSE 'single' END AS shape FROM filled"""

NODE_MEMBERS = {m: n for n, m in telemetry.NODE_VALUES.items()}
ORACLES["unpivot_stats"] = "\nUNION ALL ".join(
    f"SELECT ts, {node} AS node, 'arkime_total_packets_{NODE_MEMBERS[f]}' AS metric, "
    f"CAST(event_id % {i + 3} + {shift} AS DOUBLE) AS value FROM events"
    for node, shift in (("CAST(user_id AS VARCHAR)", 0), ("event_type", 10)) for i, f in enumerate(STAT_FIELDS))
ORACLES["health_samples"] = "\nUNION ALL ".join(
    f"SELECT ts, 'arkime_es_health_{n}' AS metric, CAST({e} AS DOUBLE) AS value FROM events"
    for n, e in {"status": "event_id % 3", **HEALTH_FIELDS}.items())
ORACLES["state_gauges"] = f"""WITH {view('states', state_columns(DUCK) + ['event_id', 'user_id'])}
SELECT ts, host, 'raid_cachevault_healthy' AS metric, CAST(NULL AS VARCHAR) AS vd,
  CASE WHEN count(CASE WHEN event_id % 3 = 0 THEN 1 END) = 1 AND count(CASE WHEN event_id % 3 = 0 AND user_id % 3 = 0 THEN 1 END) = 1
  THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM states GROUP BY ts, host
UNION ALL SELECT ts, host, 'raid_vd_optimal', CAST(event_id % 8 AS VARCHAR) || '/' || CAST(event_id % 8 AS VARCHAR),
  CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE 1.0 END FROM states WHERE event_id % 3 = 1"""
ORACLES["scan_exposition"] = f"""SELECT event_id AS line_id,
  CASE event_id % 4 WHEN 2 THEN 'm_total' ELSE 'm_' || event_type END AS metric,
  CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'node=n' || user_id || ';path=/a, b=c' ELSE 'le=+Inf' END AS labels,
  CASE event_id % 4 WHEN 1 THEN {CENTS} / 100.0::DOUBLE ELSE CAST(event_id AS DOUBLE) END AS value,
  CASE WHEN event_id % 4 = 3 THEN make_timestamp(1700000000000000) END AS sample_ts FROM events WHERE event_id % 4 > 0"""
ORACLES["write_routed"] = """SELECT event_id AS line_id,
  CASE WHEN event_id % 10 = 3 THEN 'dead_letter' ELSE 'events' END AS route,
  CASE WHEN event_id % 10 = 3 THEN 'cannot parse as regex' END AS reason FROM events"""
ORACLES["encode_events"] = """SELECT event_id,
  '{"user_id":' || user_id || ',"event_type":"' || event_type || '","note":"k = ' || user_id || '"}' AS json_text,
  'user_id=' || user_id || ' event_type=' || event_type || ' note="k = ' || user_id || '"' AS logfmt_text FROM events"""

# ---- profiling ---------------------------------------------------------------------------------

KEYED = """keyed AS (SELECT event_id, source, event_json, unnest(json_keys(event_json)) AS key FROM raw_events)"""
TOTALS = "totals AS (SELECT source, count(*) AS total FROM raw_events GROUP BY source)"
JSON_TYPES = {"UBIGINT": "int", "BIGINT": "int", "DOUBLE": "float", "VARCHAR": "string", "NULL": "null",
              "BOOLEAN": "bool", "ARRAY": "array", "OBJECT": "object"}
SCRIPT_TYPES = {"UBIGINT": "number", "BIGINT": "number", "DOUBLE": "number", "VARCHAR": "string", "NULL": "null",
                "BOOLEAN": "boolean", "ARRAY": "object", "OBJECT": "object"}
MEMBER = "json_extract(event_json, '$.' || key)"


def typed(names: dict[str, str]) -> str:
    return cases((f"json_type({MEMBER}) = '{a}'", lit(b)) for a, b in names.items())


ORACLES["key_presence"] = f"""WITH {EVENTS_JSON}, {KEYED}, {TOTALS}
SELECT source, key, count(*) AS present, any_value(total) AS total, count(*) = any_value(total) AS common
FROM keyed JOIN totals USING (source) GROUP BY source, key"""
for query_name, names in (("key_types", JSON_TYPES), ("key_types_script", SCRIPT_TYPES)):
    ORACLES[query_name] = f"""WITH {EVENTS_JSON}, {KEYED}
SELECT source, key, {typed(names)} AS type, count(*) AS n FROM keyed GROUP BY ALL"""
KEY_SETS = "key_sets AS (SELECT source, list_sort(json_keys(event_json)) AS keys, count(*) AS n FROM raw_events GROUP BY ALL)"
ORACLES["key_set_variants"] = f"""WITH {EVENTS_JSON}, {KEY_SETS}
SELECT source, array_to_string(keys, ',') AS keys, n FROM key_sets
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, keys) <= 10"""
ORACLES["batch_analysis"] = f"""WITH {EVENTS_JSON.replace("raw_events AS", "plain_events AS", 1)},
raw_events AS (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN 'bare' WHEN event_id % 5 <> 0 THEN source END AS source,
  CASE WHEN event_id % 50 = 7 THEN '[1]' ELSE event_json END AS event_json FROM plain_events),
{KEYED}, {TOTALS}, {KEY_SETS},
present AS (SELECT source, key, count(*) AS n FROM keyed GROUP BY ALL),
keys AS (SELECT p.source, string_agg(CASE WHEN n = total THEN key END, ',' ORDER BY key) AS common_keys,
  string_agg(CASE WHEN n < total THEN key END, ',' ORDER BY key) AS optional_keys
  FROM present p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source GROUP BY p.source),
typed AS (SELECT source, key, {typed(JSON_TYPES)} AS type, count(*) AS n FROM keyed GROUP BY ALL),
types AS (SELECT source, string_agg(line, ';' ORDER BY line) AS types FROM (SELECT source, key || ':' ||
  string_agg(type || '=' || n, ',' ORDER BY type) AS line FROM typed GROUP BY source, key) GROUP BY source),
best AS (SELECT source, string_agg(line, ';' ORDER BY n DESC, keys) AS variants FROM (SELECT *, array_to_string(keys, ',') || '=' || n AS line
  FROM key_sets WHERE source IS DISTINCT FROM 'bare' QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, keys) <= 10)
  GROUP BY source)
SELECT t.source, total AS count, coalesce(common_keys, '') AS common_keys, coalesce(optional_keys, '') AS optional_keys,
  coalesce(types, '') AS types, coalesce(variants, '') AS variants
FROM totals t LEFT JOIN keys k ON t.source IS NOT DISTINCT FROM k.source LEFT JOIN types y ON t.source IS NOT DISTINCT FROM y.source
LEFT JOIN best b ON t.source IS NOT DISTINCT FROM b.source"""
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) AS position,
  count(*) OVER (PARTITION BY source) AS total FROM raw_events),
picked AS (SELECT * FROM ranked WHERE (position - 1) % greatest(1, total // 15) = 0 AND (position - 1) // greatest(1, total // 15) < 15)"""
ORACLES["even_sample"] = f"WITH {EVENTS_JSON}, {RANKED} SELECT source, event_id, position, total FROM picked"
ORACLES["head_sample"] = f"WITH {EVENTS_JSON}, {RANKED} SELECT source, event_id, position FROM ranked WHERE position <= 15"
HEAD, REST = profiling.BATCH_TEMPLATE.split("{count}")
MIDDLE, TAIL = REST.split("{events_block}")
ORACLES["batch_prompts"] = f"""WITH {EVENTS_JSON}, {RANKED}
SELECT source, max(total) AS events, concat({lit(HEAD)}, max(total), {lit(MIDDLE)},
  string_agg(event_json, chr(10) ORDER BY position), {lit(TAIL)}) AS prompt FROM picked GROUP BY source"""
DISPLAY_TYPES = {**SCRIPT_TYPES, "ARRAY": "array"}
ORACLES["field_profile"] = f"""WITH {EVENTS_JSON}, {KEYED}
SELECT event_id, key AS field, {typed(DISPLAY_TYPES)} AS type,
  CASE WHEN key = 'value' THEN regexp_replace(CAST(CAST({MEMBER} AS DOUBLE) AS VARCHAR), '[.]0$', '') ELSE json_extract_string(event_json, '$.' || key) END AS preview,
  CASE WHEN key = 'at' THEN 'date' END AS hint FROM keyed WHERE event_id % 10 <> 9 AND json_type({MEMBER}) <> 'NULL'
UNION ALL SELECT event_id, key, 'null', 'null', NULL FROM keyed WHERE event_id % 10 <> 9 AND json_type({MEMBER}) = 'NULL'
UNION ALL SELECT event_id, 'message', 'string', substr('plain, ' || event_json, 1, 120), NULL FROM raw_events WHERE event_id % 10 = 9"""

# ---- library -----------------------------------------------------------------------------------

POSITION = cases(((f"source = '{f}'", str(i + 1)) for i, f in enumerate(FORMATS)))
SEED = """seed AS (SELECT source, signature, count(*) AS n, min(line_id) AS first_id, arg_min(raw, line_id) AS sample
  FROM signed GROUP BY source, signature)"""


def parser_half(k: int, variant: str, hits: str) -> str:
    return f"""SELECT first_id * 2 + {k} AS id, CAST(CASE WHEN {POSITION} < 6 THEN {POSITION} END AS BIGINT) AS source_id, signature,
  '{variant}' AS variant, 'label ' || source AS label, '. = parse_' || source || '!(.message)' AS vrl_code, sample AS sample_log,
  '' AS ocsf_class, CAST({hits} AS BIGINT) AS hits, {EPOCH} AS created_at, {EPOCH} AS updated_at FROM seed"""


PARSERS = f"{LINES}, {SIGNED}, {SEED}, parsers AS ({parser_half(1, 'default', 'n')} UNION ALL {parser_half(2, 'alt', 'n * 7 % 11')})"
SOURCES = f"""sources AS (SELECT CAST({POSITION} AS BIGINT) AS id, source AS name, 'about ' || source AS description,
  {EPOCH} AS created_at, {EPOCH} AS updated_at FROM (SELECT DISTINCT {pick('event_id', FORMATS)} AS source FROM events))"""
TOP = "top AS (SELECT * FROM parsers QUALIFY row_number() OVER (PARTITION BY signature ORDER BY hits DESC, id) = 1)"

ORACLES["source_upsert"] = f"""WITH {SOURCES}, asked AS (SELECT event_id AS seq, ts,
  CASE WHEN event_id % 2 = 0 THEN 'csv' ELSE event_type || '-' || user_id END AS name FROM events),
fresh AS (SELECT name, min(seq) AS seq, arg_min('d' || seq, seq) AS description, arg_min(ts, seq) AS made FROM asked
  WHERE name NOT IN (SELECT name FROM sources) GROUP BY name)
SELECT * FROM sources UNION ALL
SELECT (SELECT max(id) FROM sources) + row_number() OVER (ORDER BY seq), name, description, made, made FROM fresh"""
ORACLES["source_counts"] = f"""WITH {PARSERS}, {SOURCES}
SELECT s.id, s.name, s.description, count(p.id) AS parser_count FROM sources s LEFT JOIN parsers p ON p.source_id = s.id
GROUP BY s.id, s.name, s.description ORDER BY s.name"""
GONE = "gone AS (SELECT DISTINCT user_id % 2 + 2 AS id FROM events)"
ORACLES["source_delete"] = f"""WITH {PARSERS}, {GONE}
SELECT CASE WHEN source_id IN (SELECT id FROM gone) THEN NULL ELSE source_id END AS source_id, count(*) AS parsers
FROM parsers GROUP BY 1"""
ORACLES["source_delete_sources"] = f"WITH {SOURCES}, {GONE} SELECT id, name FROM sources WHERE id NOT IN (SELECT id FROM gone)"
ORACLES["parser_lookup"] = f"""WITH {PARSERS}, {SOURCES}
SELECT l.line_id, l.signature, p.id AS parser_id, p.variant, p.hits, s.name AS source_name,
  CAST(row_number() OVER (PARTITION BY l.line_id ORDER BY p.hits DESC, p.id) AS INTEGER) AS rank
FROM signed l JOIN parsers p USING (signature) LEFT JOIN sources s ON p.source_id = s.id"""
ORACLES["hit_counts"] = f"""WITH {PARSERS}, {TOP}, asked AS (
  SELECT signature, count(*) AS n, max(ts) AS seen FROM signed JOIN events ON line_id = event_id GROUP BY signature)
SELECT p.id, p.signature, p.variant, p.hits + CASE WHEN p.id IN (SELECT id FROM top) THEN coalesce(n, 0) ELSE 0 END AS hits,
  CASE WHEN p.id IN (SELECT id FROM top) THEN coalesce(seen, updated_at) ELSE updated_at END AS updated_at
FROM parsers p LEFT JOIN asked USING (signature)"""
ORACLES["parser_upsert"] = f"""WITH {PARSERS}, requests AS (
  SELECT line_id AS seq, signature, CASE WHEN line_id % 2 = 0 THEN 'default' ELSE 'new' END AS variant, '# ' || line_id AS vrl_code,
    raw AS sample_log, 'l' || line_id % 10 AS label, '3001' AS ocsf_class, line_id % 6 + 1 AS source_id, ts AS made
  FROM signed JOIN events ON line_id = event_id),
latest AS (SELECT *, min(seq) OVER k AS first_seq, first(made) OVER (PARTITION BY signature, variant ORDER BY seq) AS first_at FROM requests
  WINDOW k AS (PARTITION BY signature, variant) QUALIFY seq = max(seq) OVER k)
SELECT p.id, coalesce(r.source_id, p.source_id) AS source_id, p.signature, p.variant, coalesce(r.label, p.label) AS label,
  coalesce(r.vrl_code, p.vrl_code) AS vrl_code, coalesce(r.sample_log, p.sample_log) AS sample_log,
  coalesce(r.ocsf_class, p.ocsf_class) AS ocsf_class, p.hits, p.created_at, coalesce(r.made, p.updated_at) AS updated_at
FROM parsers p LEFT JOIN latest r USING (signature, variant)
UNION ALL
SELECT (SELECT max(id) FROM parsers) + row_number() OVER (ORDER BY first_seq), source_id, signature, variant, label, vrl_code,
  sample_log, ocsf_class, 1, first_at, made FROM latest l
WHERE NOT EXISTS (SELECT 1 FROM parsers p WHERE p.signature = l.signature AND p.variant = l.variant)"""
ORACLES["parser_list"] = f"""WITH {PARSERS}, {SOURCES}
SELECT p.id, p.signature, p.variant, p.label, p.ocsf_class, p.hits, p.created_at, substr(p.sample_log, 1, 80) AS sample,
  s.name AS source_name FROM parsers p LEFT JOIN sources s ON p.source_id = s.id WHERE p.source_id = 2 ORDER BY p.hits DESC, p.id"""
ORACLES["parser_get"] = f"""WITH {PARSERS}, {SOURCES}
SELECT p.*, s.name AS source_name FROM parsers p LEFT JOIN sources s ON p.source_id = s.id
WHERE p.id IN (SELECT event_id * 3 FROM events)"""
ORACLES["parser_delete"] = f"""WITH {PARSERS} SELECT id, signature, variant FROM parsers
WHERE id NOT IN (SELECT event_id * 3 FROM events)"""
ORACLES["parser_relabel"] = f"""WITH {PARSERS}, latest AS (SELECT event_id // 2 * 3 AS id, max(event_id) AS seq,
  arg_max(ts, event_id) AS made FROM events GROUP BY 1)
SELECT id, CASE WHEN seq IS NULL THEN label ELSE 'new ' || seq END AS label, coalesce(made, updated_at) AS updated_at
FROM parsers LEFT JOIN latest USING (id)"""
ORACLES["library_size"] = f"WITH {PARSERS} SELECT count(*) AS parsers FROM parsers"

ROUTED = f"""routed AS (SELECT line_id, CASE line_id % 11 WHEN 5 THEN ' ' || chr(10) || chr(9) || ' '
  WHEN 6 THEN 'SUDO mode ' || raw WHEN 7 THEN 'unseen shape: ' || raw ELSE raw END AS raw FROM lines),
cleaned AS (SELECT line_id, {sanitized('raw')} AS clean FROM routed),
judged AS (SELECT line_id, clean, {screened('clean')} AS matched, CASE WHEN clean <> '' AND {screened('clean')} IS NULL
  THEN substr(sha256({skeleton_of('clean')}), 1, 16) END AS signature FROM cleaned)"""
ORACLES["route_lines"] = f"""WITH {PARSERS}, {TOP}, {ROUTED}, sizes AS (SELECT signature, count(*) AS n FROM parsers GROUP BY signature)
SELECT j.line_id, CASE WHEN clean = '' THEN 'error' WHEN matched IS NOT NULL THEN 'blocked' WHEN t.id IS NOT NULL THEN 'cached'
  ELSE 'needs_parser' END AS action, j.signature, t.id AS parser_id, t.vrl_code, coalesce(n, 0) AS variants,
  CASE WHEN clean = '' THEN 'Empty input.' WHEN matched IS NOT NULL THEN 'Injection detected: ' || matched
    WHEN t.id IS NOT NULL THEN 'Cache hit: parser #' || t.id || ' [' || t.label || '] (' || n || ' variants) (used ' || t.hits || 'x)'
    ELSE 'No parser for sig ' || j.signature END AS message
FROM judged j LEFT JOIN top t ON j.signature = t.signature LEFT JOIN sizes s ON j.signature = s.signature"""

# ---- parsing: rendered columns must come back ---------------------------------------------------


def of_format(index: int, columns: dict[str, str], bad: str, key: str = "line_id") -> str:
    """Typed columns where the line has the format, nulls and a reason elsewhere."""
    fits = f"event_id % 6 = {index}"
    cells = ", ".join(f"CASE WHEN {fits} THEN {e} END AS {n}" for n, e in columns.items())
    return (f"SELECT event_id AS {key}, {cells}, {fits} AS ok, CASE WHEN NOT ({fits}) THEN {lit(bad)} END AS reason FROM events")


def keyword(codes: list[str], index: str) -> str:
    return f"[{', '.join(lit(c) for c in codes)}][CAST({index} AS INT) + 1]"


ORACLES["detect_format"] = f"SELECT event_id AS line_id, {pick('event_id', FORMATS)} AS format FROM events"
ORACLES["parse_syslog"] = of_format(0, {
    "facility_code": f"CAST({PRI} // 8 AS INT)", "facility": keyword(parsing.FACILITIES, f"{PRI} // 8"),
    "severity": keyword(parsing.SEVERITIES, f"{PRI} % 8"), "timestamp": SECOND,
    "hostname": "'host' || CAST(user_id % 7 AS VARCHAR)", "appname": "event_type", "procid": "CAST(event_id AS VARCHAR)",
    "message": f"concat('user ', user_id, ' value ', {VALUE_TEXT})"}, "not syslog")
ORACLES["parse_access_log"] = of_format(1, {
    "clientip": CLIENT_IP, "ident": "'-'", "auth": "'user' || user_id", "timestamp": SECOND, "verb": METHOD,
    "request": "concat('/', event_type, '/', event_id)", "httpversion": "'1.1'", "status": f"CAST({STATUS} AS INT)",
    "bytes": CENTS, "referrer": "'-'", "agent": "concat('agent/', user_id % 5, '.0 (test)')"}, "not an access line")
ORACLES["parse_json_log"] = of_format(2, {
    "timestamp": SECOND, "level": f"lower({LEVEL})", "service": "event_type", "msg": f"concat('value is {{', {VALUE_TEXT}, '}}')",
    "user_id": "user_id", "trace_id": "'abc-' || event_id"}, "not a JSON object")
ORACLES["parse_json_props"] = f"""SELECT event_id, event_type, user_id,
  CASE WHEN event_id % 4 = 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 4 = 3 THEN event_type END AS inner,
  CASE WHEN event_id % 4 = 1 THEN {CENTS} / 100.0::DOUBLE END AS value, CASE WHEN event_id % 4 = 1 THEN {SECOND} END AS at,
  CASE WHEN event_id % 4 = 2 THEN 'ok=true;tags=["a","b"]' ELSE '' END AS extra, true AS ok, CAST(NULL AS VARCHAR) AS reason FROM events"""
ORACLES["parse_key_value"] = of_format(3, {
    "timestamp": SECOND, "level": f"lower({LEVEL})", "component": "event_type", "method": METHOD,
    "path": "concat('/e/', event_id)", "status": f"CAST({STATUS} AS INT)", "duration_ms": CENTS,
    "note": "concat('user ', user_id, ' = ok')", "fields": "''"}, "no key-value pairs").replace(
    "CASE WHEN event_id % 6 = 3 THEN '' END AS fields",
    f"""CASE event_id % 6 WHEN 3 THEN '' WHEN 4 THEN concat('amount=', {VALUE_TEXT}, ';currency=USD;order_id=ORD-', event_id,
  ';reason=', {REASON}) END AS fields""").replace(
    # The bodies of application lines hold pairs too.
    "event_id % 6 = 3 AS ok, CASE WHEN NOT (event_id % 6 = 3)",
    "event_id % 6 IN (3, 4) AS ok, CASE WHEN event_id % 6 NOT IN (3, 4)")
ORACLES["parse_csv_log"] = of_format(5, {
    "timestamp": SECOND, "client_ip": CLIENT_IP, "method": METHOD, "path": "'/a,b/' || event_id",
    "status": f"CAST({STATUS} AS BIGINT)", "duration": f"{CENTS} / 100.0::DOUBLE"}, "wrong number of columns")
ORACLES["parse_app_log"] = of_format(4, {
    "timestamp": "date_trunc('milliseconds', ts)", "thread": "'worker-' || user_id % 9", "level": f"lower({LEVEL})",
    "logger": "'c.e.' || event_type", "order_id": "'ORD-' || event_id", "amount": f"{CENTS} / 100.0::DOUBLE",
    "currency": "'USD'", "reason_text": REASON, "fields": "''"}, "no header")
ORACLES["parse_nested"] = f"""SELECT event_id AS line_id, 'dbhost' AS hostname, 'oracle' AS appname, {SECOND} AS timestamp,
  'SYS ' || event_id AS db_user, CAST(event_id % 100 AS VARCHAR) AS action_code, '0' AS return_code, '' AS fields, true AS ok,
  CAST(NULL AS VARCHAR) AS reason FROM events"""


BODY = f"concat('order_id=ORD-', event_id, ' amount=', {VALUE_TEXT}, ' currency=USD reason=\"', {REASON}, '\"')"


def mixed_columns() -> dict[str, str]:
    def per(**by_format: str) -> str:
        return cases((f"event_id % 6 = {FORMATS.index(f)}", e) for f, e in by_format.items())

    return {
        "timestamp": f"CASE WHEN event_id % 6 = 4 THEN date_trunc('milliseconds', ts) ELSE {SECOND} END",
        "level": per(syslog=keyword(parsing.SEVERITIES, f"{PRI} % 8"), json=f"lower({LEVEL})", key_value=f"lower({LEVEL})",
                     app=f"lower({LEVEL})"),
        "service": per(syslog="event_type", json="event_type", key_value="event_type", app="'c.e.' || event_type"),
        "client_ip": per(access=CLIENT_IP, csv=CLIENT_IP),
        "method": per(access=METHOD, key_value=METHOD, csv=METHOD),
        "path": per(access="concat('/', event_type, '/', event_id)", key_value="concat('/e/', event_id)", csv="'/a,b/' || event_id"),
        "status": f"CAST({per(access=STATUS, key_value=STATUS, csv=STATUS)} AS INT)",
        "message": per(syslog=f"concat('user ', user_id, ' value ', {VALUE_TEXT})", json=f"concat('value is {{', {VALUE_TEXT}, '}}')",
                       app=f"concat('Payment failed for ', {BODY})"),
        "extra": per(
            syslog=f"concat('facility=', {keyword(parsing.FACILITIES, f'{PRI} // 8')}, ';hostname=host', user_id % 7, ';procid=', event_id)",
            access=f"concat('agent=agent/', user_id % 5, '.0 (test);auth=user', user_id, ';bytes=', {CENTS}, ';httpversion=1.1')",
            json="concat('trace_id=abc-', event_id, ';user_id=', user_id)",
            key_value=f"concat('duration_ms=', {CENTS}, ';note=user ', user_id, ' = ok')",
            app=f"concat('amount=', {VALUE_TEXT}, ';currency=USD;order_id=ORD-', event_id, ';reason=', {REASON}, ';thread=worker-', user_id % 9)",
            csv=f"concat('duration=', {VALUE_TEXT})"),
    }


JUNK = "event_id % 10 = 3"
MIXED = f"""mixed AS (SELECT event_id AS line_id, CASE WHEN {JUNK} THEN 'regex' ELSE {pick('event_id', FORMATS)} END AS format,
  {', '.join(f'CASE WHEN NOT ({JUNK}) THEN {e} END AS {n}' for n, e in mixed_columns().items())},
  NOT ({JUNK}) AS ok, CASE WHEN {JUNK} THEN 'cannot parse as regex' END AS reason FROM events)"""
ORACLES["parse_mixed"] = f"WITH {MIXED} SELECT * FROM mixed"
ORACLES["parse_syslog_structured"] = f"""SELECT event_id AS line_id, 'host' AS hostname, event_type AS appname,
  CAST(event_id AS VARCHAR) AS procid, 'ID' || user_id AS msgid, 1 AS version, 'value [x] ' || event_id AS message,
  CASE event_id % 3 WHEN 0 THEN concat('ids@1=note=a "q" [b] c:\\d;user=', user_id, ';o@2=empty=;event=', event_type)
    WHEN 1 THEN 'only@3=' END AS structured, true AS ok FROM events"""
ORACLES["parse_regex"] = f"""SELECT event_id AS line_id, CASE event_id % 6 WHEN 4 THEN 0 WHEN 0 THEN 1 END AS pattern,
  CASE WHEN event_id % 6 IN (0, 4) THEN {CENTS} / 100.0::DOUBLE END AS amount, CASE WHEN event_id % 6 = 0 THEN user_id END AS "user",
  CASE event_id % 6 WHEN 4 THEN concat('order=ORD-', event_id, ';why=', {REASON})
    WHEN 0 THEN concat('app_name=', event_type, ';event=', event_id) END AS fields,
  event_id % 6 IN (0, 4) AS ok, CASE WHEN event_id % 6 NOT IN (0, 4) THEN 'no pattern found' END AS reason FROM events"""
ORACLES["parse_groks"] = f"""SELECT event_id AS line_id, CASE event_id % 6 WHEN 1 THEN 0 WHEN 5 THEN 1 WHEN 3 THEN 2 END AS pattern,
  CASE WHEN event_id % 6 IN (1, 3) THEN CAST({STATUS} AS INT) END AS status, CASE WHEN event_id % 6 = 1 THEN {CENTS} END AS size,
  CASE event_id % 6 WHEN 1 THEN concat('at=', strftime(ts, '%d/%b/%Y:%H:%M:%S +0000'), ';client=', {CLIENT_IP}, ';path=/', event_type, '/',
      event_id, ';user=user', user_id, ';verb=', {METHOD})
    WHEN 3 THEN concat('at=', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ';level=', {LEVEL})
    WHEN 5 THEN concat('client=', {CLIENT_IP}, ';verb=', {METHOD}) END AS fields,
  event_id % 6 IN (1, 3, 5) AS ok, CASE WHEN event_id % 6 NOT IN (1, 3, 5) THEN 'no pattern found' END AS reason FROM events"""
ORACLES["coerce_fields"] = f"""WITH c AS (SELECT event_id, event_id % 7 = 0 AS bad_n, event_id % 9 = 0 AS bad_f, event_id % 5 = 4 AS bad_b,
  user_id, ts FROM events)
SELECT event_id, CASE WHEN NOT bad_n THEN user_id END AS n, CASE WHEN NOT bad_f THEN CAST(event_id % 100 AS DOUBLE) END AS f,
  CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS b, {SECOND} AS t,
  NOT (bad_n OR bad_f OR bad_b) AS ok, CASE WHEN bad_n OR bad_f OR bad_b THEN 'bad field: ' ||
  concat_ws(',', CASE WHEN bad_n THEN 'n' END, CASE WHEN bad_f THEN 'f' END, CASE WHEN bad_b THEN 'b' END) END AS reason FROM c"""


def table_case(column: str, table: dict) -> str:
    return cases(((f"{column} = {lit(k) if isinstance(k, str) else k}", str(x)) for k, x in table.items()), "0")


ORACLES["ocsf_map"] = f"""WITH {MIXED}, ids AS (SELECT *, {table_case('format', {f: c for f, (c, _) in ocsf.FORMAT_CLASS.items()})} AS class_uid,
  {table_case('format', {f: a for f, (_, a) in ocsf.FORMAT_CLASS.items()})} AS activity_id FROM mixed)
SELECT line_id, class_uid, {table_case('class_uid', ocsf.CLASS_CATEGORY)} AS category_uid, activity_id,
  class_uid * 100 + activity_id AS type_uid, {table_case("coalesce(level, 'info')", ocsf.SEVERITY_IDS)} AS severity_id,
  epoch_ms(timestamp) AS time, service AS product, '1.1.0' AS version, client_ip AS src_ip, method AS http_method,
  path AS url_path FROM ids"""
ORACLES["compact_flatten"] = f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ''
  WHEN 1 THEN concat('at=', strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ';')
  WHEN 2 THEN 'ok=true;tags=["a","b"];' ELSE concat('props.in.v=', event_type, ';props.k=', json_extract(props, '$.k'), ';') END
  || 'user_id=app' || user_id % 3 || CASE WHEN event_id % 4 = 1 THEN ';value=' || regexp_replace(CAST({CENTS} / 100.0::DOUBLE AS VARCHAR), '[.]0$', '') ELSE '' END AS flat
FROM events"""

ORACLES["flatten_deep"] = f"""SELECT event_id, concat(path, 'k=', event_type, ';', path, 'tags=["a",{{"b":2}}]') AS flat
FROM (SELECT *, repeat('k.', {DEPTH} - 1) AS path FROM events)"""

# ---- audits: the defects each program was rendered with ------------------------------------------

LINT_RULES = {
    "lint_forbidden": [name for name, _, _ in audit.FORBIDDEN_RULES],
    "lint_braces": ["unexpected_brace", "unclosed_brace", "unclosed_string", "unclosed_regex"],
    "lint_literals": ["single_quotes", "odd_quotes", "regex_double_quotes", "regex_plain_string", "regex_slashes",
                      "regex_capture_name"],
    "lint_escapes": ["regex_escape", "unknown_escape", "double_escaped_regex"],
    "lint_regex_compile": ["regex_compile"],
}
# Messages that name a part of the program; ``@E`` is the event id.
NAMED_ISSUES = {
    "unclosed_brace": "1" + audit.MESSAGES["unclosed_brace"],
    "regex_plain_string": "Regex pattern must use r'...' syntax — not a double-quoted string. Change \"id@E\" to r'id@E'",
    "regex_escape": "Escape '\\d' is a regex escape, not a string escape. If this is a regex pattern, use r'...' syntax instead of \"...\"",
    "unknown_escape": "Unknown string escape sequence '\\q'. Valid VRL string escapes: \\n \\t \\r \\\\ \\\" \\0",
    "regex_compile": "Regex r'(@E' is invalid: missing ), unterminated subpattern at position 0",
}
ISSUE_TEXTS = audit.MESSAGES | {name: text for name, _, text in audit.FORBIDDEN_RULES} | NAMED_ISSUES
ISSUES = "issues(k, line, severity, rule, text) AS (VALUES " + ", ".join(
    f"({k}, {line}, '{severity}', '{rule}', {lit(ISSUE_TEXTS[rule])})"
    for k, (_, found) in enumerate(PROGRAMS) for line, severity, rule in found) + ")"
MESSAGE = "replace(text, '@E', CAST(event_id AS VARCHAR))"
# The order in which a report lists the findings of one severity: by check, then by line.
REPORT_ORDER = [n for check in ("lint_braces", "lint_forbidden", "lint_literals", "lint_escapes", "lint_regex_compile") for n in LINT_RULES[check]]
for query_name, rule_names in LINT_RULES.items():
    ORACLES[query_name] = f"""WITH {ISSUES} SELECT event_id AS program_id, line, severity, rule, {MESSAGE} AS message FROM events
JOIN issues ON event_id % {len(PROGRAMS)} = k WHERE rule IN ({', '.join(lit(r) for r in rule_names)})"""
def report_block(severity: str, title: str, after: str) -> str:
    lines = f"string_agg('  Line ' || line || ': ' || {MESSAGE} || chr(10), '' ORDER BY list_position({REPORT_ORDER}, rule), line) FILTER (severity = '{severity}')"
    count = f"count(*) FILTER (severity = '{severity}')"
    return f"CASE WHEN {count} > 0 THEN '{title}' || {count} || '{after}' || chr(10) || {lines} ELSE '' END"


ORACLES["lint_summary"] = f"""WITH {ISSUES} SELECT event_id AS program_id,
  CAST(count(CASE WHEN severity = 'error' THEN 1 END) AS INT) AS errors, CAST(count(CASE WHEN severity = 'warning' THEN 1 END) AS INT) AS warnings,
  {report_block('error', 'STATIC ANALYSIS ERRORS (', '):')} || {report_block('warning', 'WARNINGS (', '):')} AS report
FROM events LEFT JOIN issues ON event_id % {len(PROGRAMS)} = k GROUP BY event_id"""

RUNS = view("runs", run_columns(DUCK))
CASE9 = "run_id % 9"
ORACLES["output_quality"] = f"""WITH {RUNS} SELECT run_id, CASE WHEN stdout = '' THEN {lit(audit.NO_OUTPUT)}
  WHEN {CASE9} = 3 THEN {lit(audit.NO_NEW_FIELDS)} WHEN {CASE9} = 4 THEN {lit(audit.ONLY_MESSAGE)} END AS warning FROM runs"""
GOOD_OUT = "concat('{\"a\":', run_id, ',\"at\":t', chr(39), '2024-01-01', chr(39), '}')"
ORACLES["run_triage"] = f"""WITH {RUNS} SELECT run_id,
  CASE {CASE9} WHEN 1 THEN 'runtime_error' WHEN 2 THEN 'empty' WHEN 5 THEN 'not_found' WHEN 6 THEN 'timeout' WHEN 7 THEN 'failed'
    WHEN 8 THEN 'failed' ELSE 'ok' END AS outcome,
  CASE {CASE9} WHEN 0 THEN {GOOD_OUT} WHEN 3 THEN stdout WHEN 4 THEN stdout END AS output,
  CASE {CASE9} WHEN 3 THEN {lit(audit.NO_NEW_FIELDS)} WHEN 4 THEN {lit(audit.ONLY_MESSAGE)} END AS warning,
  CASE {CASE9} WHEN 1 THEN 'Runtime error: function call error ' || run_id WHEN 2 THEN {lit(audit.EMPTY_RUN)}
    WHEN 5 THEN 'Vector binary not found at: vector' WHEN 6 THEN 'Vector timed out after 15000ms'
    WHEN 7 THEN CASE WHEN run_id % 2 = 1 THEN 'out ' ELSE 'spawn ' END || run_id
    WHEN 8 THEN 'bad ' || run_id END AS error,
  CAST(CASE {CASE9} WHEN 5 THEN -1 WHEN 6 THEN -2 WHEN 7 THEN 70 WHEN 8 THEN 70 ELSE 0 END AS INT) AS exit FROM runs"""
ORACLES["input_wrap"] = f"""WITH {RUNS} SELECT run_id,
  CASE WHEN {CASE9} = 8 THEN '{{"message":"plain ' || run_id || '"}}' ELSE input END AS event FROM runs"""

# ---- metrics and alerts ------------------------------------------------------------------------

NODE = "concat('node', user_id % 3)"
ALL_SAMPLES = f"all_samples AS ({metric_samples_sql(DUCK)})"
COUNTS = f"counts AS (SELECT ts, {NODE} AS instance, CAST(event_id % 500 AS DOUBLE) AS value FROM events)"
LEVELS = f"levels AS (SELECT ts, {NODE} AS instance, value FROM events)"


def stepped(table: str, keys: str, where: str = "true") -> str:
    """Rows with the counter's step since the row before in its series."""
    lag = f"lag(value) OVER (PARTITION BY {keys} ORDER BY ts)"
    return (f"(SELECT *, CASE WHEN {lag} IS NULL THEN 0 WHEN value < {lag} THEN value ELSE value - {lag} END AS step, "
            f"epoch_us(ts) AS us FROM {table} WHERE {where})")


def sample_rates(table: str, keys: str, window_s: int, where: str = "true") -> str:
    frame = f"(PARTITION BY {keys} ORDER BY us RANGE BETWEEN {window_s * 1_000_000} PRECEDING AND CURRENT ROW)"
    return f"""(SELECT {keys}, ts, rise / (span / 1e6) AS rate FROM (
  SELECT {keys}, ts, sum(step) OVER {frame} - first(step) OVER {frame} AS rise, us - first(us) OVER {frame} AS span
  FROM {stepped(table, keys, where)}) WHERE span > 0)"""


def grid_times(step_s: int, reach_s: int) -> str:
    step = step_s * 1_000_000
    first = f"CAST(ceil(us / {step}::DOUBLE) AS BIGINT)"
    last = f"CAST(floor((us + {reach_s * 1_000_000}) / {step}::DOUBLE) AS BIGINT)"
    return f"unnest(generate_series({first}, {last})) AS slot"


def grid_rates(table: str, keys: str, where: str = "true") -> str:
    step_s, window_s = catalog.STEP_S, catalog.RATE_S
    return f"""(SELECT {keys}, make_timestamp(slot * {step_s * 1_000_000}) AS ts,
  (sum(step) - arg_min(step, us)) / ((max(us) - min(us)) / 1e6) AS rate
  FROM (SELECT *, {grid_times(step_s, window_s)} FROM {stepped(table, keys, where)})
  GROUP BY {keys}, slot HAVING count(*) > 1 AND max(us) > min(us))"""


def grid_values(table: str, keys: str, where: str = "true") -> str:
    step_s, lookback_s = catalog.STEP_S, catalog.LOOKBACK_S
    return f"""(SELECT {keys}, make_timestamp(slot * {step_s * 1_000_000}) AS ts, arg_max(value, us) AS value
  FROM (SELECT *, {grid_times(step_s, lookback_s)} FROM (SELECT *, epoch_us(ts) AS us FROM {table} WHERE {where}))
  GROUP BY {keys}, slot)"""


ORACLES["metric_select"] = f"""WITH {ALL_SAMPLES} SELECT ts, instance, mountpoint, value FROM all_samples
WHERE metric = 'node_filesystem_avail_bytes' AND job = 'node' AND regexp_full_match(mountpoint, '/data/pcap[0-2]')"""
ORACLES["counter_rate"] = f"""WITH {COUNTS} SELECT instance, ts, round(rate, 9) AS rate
FROM {sample_rates('counts', 'instance', catalog.WINDOW_S)}"""
ORACLES["grid_rate"] = f"WITH {COUNTS} SELECT instance, ts, round(rate, 9) AS rate FROM {grid_rates('counts', 'instance')}"
DROPS, PACKETS = "suricata_capture_kernel_drops_total", "suricata_capture_kernel_packets_total"
ORACLES["drop_ratio"] = f"""WITH {ALL_SAMPLES},
d AS (SELECT * FROM {sample_rates('all_samples', 'job, instance', catalog.WINDOW_S, f"metric = '{DROPS}'")}),
p AS (SELECT * FROM {sample_rates('all_samples', 'job, instance', catalog.WINDOW_S, f"metric = '{PACKETS}'")})
SELECT job, instance, ts, round(d.rate / greatest(p.rate, 1) * 100, 9) AS ratio FROM d JOIN p USING (job, instance, ts)"""
ORACLES["gauge_ratio"] = f"""WITH {ALL_SAMPLES} SELECT a.instance, a.mountpoint, a.ts, round(a.value / s.value, 9) AS ratio
FROM all_samples a JOIN all_samples s ON a.ts = s.ts AND a.instance = s.instance AND a.mountpoint = s.mountpoint
WHERE a.metric = 'node_filesystem_avail_bytes' AND s.metric = 'node_filesystem_size_bytes'"""
ORACLES["match_ratio"] = f"""WITH {ALL_SAMPLES} SELECT a.instance, a.ts, round(a.value / greatest(s.value, 1), 9) AS ratio
FROM all_samples a JOIN all_samples s ON a.ts = s.ts AND a.instance = s.instance
WHERE a.metric = 'arkime_total_packets_suricataMatches' AND s.metric = 'arkime_total_packets_suricataAlerts'"""
ORACLES["rate_by_label"] = f"""WITH {ALL_SAMPLES} SELECT app_proto, ts, round(sum(rate), 9) AS rate
FROM {grid_rates('all_samples', 'instance, app_proto', "metric = 'suricata_app_layer_flow_total'")} GROUP BY app_proto, ts"""
ORACLES["totals_rollup"] = f"""SELECT date_trunc('hour', ts) AS ts, event_type AS metric, {NODE} AS instance, round(sum(value), 6) AS value
FROM events GROUP BY ALL"""
ORACLES["series_count"] = f"""SELECT count(DISTINCT (event_type, {NODE}, user_id % 44)) AS series_before,
  count(DISTINCT (event_type, {NODE})) AS series_after FROM events"""
ORACLES["eval_grid"] = f"WITH {LEVELS} SELECT instance, ts, value FROM {grid_values('levels', 'instance')}"


def states(source: str, keys: str, for_us: str, step_s: int) -> str:
    """Gaps and islands over the true grid rows."""
    step = step_s * 1_000_000
    island = f"epoch_us(ts) // {step} - row_number() OVER (PARTITION BY {keys} ORDER BY ts)"
    return f"""(SELECT *, CASE WHEN epoch_us(ts) - epoch_us(active_since) >= {for_us} THEN 'firing' ELSE 'pending' END AS state FROM (
  SELECT *, min(ts) OVER (PARTITION BY {keys}, island) AS active_since FROM (SELECT *, {island} AS island FROM {source})))"""


ORACLES["alert_states"] = f"""WITH {LEVELS}, grid AS {grid_values('levels', 'instance')},
active AS (SELECT * FROM grid WHERE value > 15)
SELECT instance, ts, value, state, active_since FROM {states('active', 'instance', '900000000', catalog.STEP_S)}
UNION ALL SELECT instance, ts, value, 'inactive', NULL FROM grid WHERE NOT value > 15"""

LABEL_LIST = ", ".join(alerts.RULE_LABELS)


def rule_sql(rule: alerts.Rule) -> str:
    def side(metric: str) -> str:
        where = " AND ".join([f"metric = '{metric}'"] + [
            f"regexp_full_match(coalesce({k}, ''), '{p}')" for k, p in rule.match.items()])
        grid = (grid_rates if rule.rate else grid_values)("all_samples", LABEL_LIST, where)
        return f"(SELECT {LABEL_LIST}, ts, {'rate' if rule.rate else 'value'} AS v FROM {grid})"

    same = " AND ".join(f"n.{k} IS NOT DISTINCT FROM d.{k}" for k in alerts.RULE_LABELS)
    if rule.den:
        den = f"greatest(d.v, {rule.floor})" if rule.floor is not None else "d.v"
        source = f"{side(rule.num)} n JOIN {side(rule.den)} d ON n.ts = d.ts AND {same}"
        value = f"n.v / {den}"
    else:
        source, value = f"{side(rule.num)} n", "n.v"
    text, op = lit(rule.summary), "=" if rule.op == "==" else rule.op
    for label in alerts.RULE_LABELS:
        text = f"replace({text}, '{{{label}}}', coalesce(n.{label}, ''))"
    about = lit(rule.description) if rule.description else "NULL"
    percent = f"({value} * 100)"
    scale = f"pow(10, 3 - floor(log10(abs({percent}))))"
    shown = f"regexp_replace(CAST(round({percent} * {scale}) / {scale} AS VARCHAR), '[.]0$', '') || '%'"
    about = f"replace({about}, '{{percent}}', {shown})" if "{percent}" in about else f"CAST({about} AS VARCHAR)"
    labels = ", ".join(f"n.{k}" for k in alerts.RULE_LABELS)
    return (f"SELECT '{rule.name}' AS rule, '{rule.severity}' AS severity, {labels}, n.ts, {value} AS value, {text} AS summary, {about} AS description, "
            f"CAST({rule.for_s} AS BIGINT) * 1000000 AS for_us FROM {source} WHERE {value} {op} {rule.threshold}")


RULESET = f"""{ALL_SAMPLES}, firing AS ({chr(10).join(' UNION ALL ' * (i > 0) + rule_sql(r) for i, r in enumerate(alerts.CAPTURE_RULES))}),
alert_rows AS (SELECT * FROM {states('firing', f'rule, {LABEL_LIST}', 'for_us', catalog.STEP_S)})"""
# The labels that no rule's metric has are not rendered here.
SERIES = "'[' || concat_ws(',', " + ", ".join(
    f"CASE WHEN {k} IS NOT NULL THEN concat('{{\"key\":\"{k}\",\"value\":\"', {k}, '\"}}') END" for k in ("device", "mountpoint", "node")) + ") || ']'"
ORACLES["alert_ruleset"] = f"""WITH {RULESET} SELECT rule, severity, {SERIES} AS series, {LABEL_LIST}, ts, round(value, 9) AS value, state, active_since, summary, description
FROM alert_rows"""
LOW_RULES = ", ".join(lit(r.name) for r in alerts.CAPTURE_RULES if r.op in ("<", "<="))
ORACLES["alerts_summary"] = f"""WITH {RULESET} SELECT rule, {SERIES} AS series, {LABEL_LIST}, active_since, min(ts) AS fired_at, max(ts) AS last_at,
  count(*) AS evaluations, round(CASE WHEN rule IN ({LOW_RULES}) THEN min(value) ELSE max(value) END, 9) AS worst
FROM alert_rows WHERE state = 'firing' GROUP BY rule, {LABEL_LIST}, active_since"""
ORACLES["relabel"] = f"""WITH {ALL_SAMPLES} SELECT metric, concat_ws(';', 'app=' || app_proto, 'app_proto=' || app_proto, 'device=fixed',
  'mountpoint=' || mountpoint, 'node=' || node, 'target=' || node) AS labels, count(*) AS n FROM all_samples GROUP BY ALL"""
ORACLES["series_retention"] = " UNION ALL ".join(
    f"SELECT ts, {NODE} AS instance, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM events "
    "WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM events)" for m, e in (("count_total", "event_id % 500"), ("level", "value")))
ORACLES["recording_rules"] = f"""WITH {ALL_SAMPLES}, p AS {grid_rates('all_samples', 'instance', f"metric = '{PACKETS}'")},
d AS {grid_rates('all_samples', 'instance', f"metric = '{DROPS}'")}
SELECT 'suricata:packets:rate' AS metric, instance, ts, round(rate, 9) AS value FROM p
UNION ALL SELECT 'suricata:drops:percent', instance, ts, round(d.rate / greatest(p.rate, 1) * 100, 9) FROM d JOIN p USING (instance, ts)"""

ORACLES["retain_recorded"] = f"""WITH r AS ({ORACLES["recording_rules"]})
SELECT * FROM r WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM r)"""

# ---- streams: what the batch plans give ----------------------------------------------------------

ORACLES["stream_parse"] = f"""WITH {MIXED} SELECT line_id, format, timestamp, level, service, status, message, extra,
  CASE WHEN ok THEN 'events' ELSE 'dead_letter' END AS route FROM mixed"""
ORACLES["stream_signatures"] = f"""WITH {LINES}, {SIGNED}, daily AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, source, signature, count(*) AS lines
  FROM signed JOIN events ON line_id = event_id GROUP BY 1, 2, 3)
SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, source, signature, lines FROM daily
WHERE window_start + INTERVAL 1 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"""
ORACLES["stream_route"] = f"""WITH {PARSERS}, {TOP}, sizes AS (SELECT signature, count(*) AS n FROM parsers GROUP BY signature),
asked AS (SELECT line_id, CASE WHEN line_id % 11 = 7 THEN 'unseen shape: ' || raw ELSE raw END AS raw FROM lines),
looked AS (SELECT line_id, substr(sha256({skeleton_of('raw')}), 1, 16) AS signature FROM asked)
SELECT line_id, CASE WHEN t.id IS NULL THEN 'needs_parser' ELSE 'cached' END AS action, l.signature, t.id AS parser_id,
  coalesce(n, 0) AS variants FROM looked l LEFT JOIN top t USING (signature) LEFT JOIN sizes USING (signature)"""
# The grid times that the watermark of ten minutes has passed.
ORACLES["stream_alerts"] = f"""SELECT s.* FROM ({ORACLES["alert_states"]}) s, (SELECT max(epoch_us(ts)) AS us FROM events) e
WHERE epoch_us(s.ts) // 1000 <= (e.us - 1) // 1000 - 600000"""
