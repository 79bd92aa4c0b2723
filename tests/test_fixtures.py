"""Example lines with their known skeletons, signatures and parsed columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lineforge.operators import fingerprint, ocsf, parsing

# Example lines as they are published with the formats.
LINES = {
    "syslog": "<34>Oct 11 22:14:15 mymachine su: 'su root' failed for lonvick on /dev/pts/8",
    "access": '93.180.71.3 - - [17/May/2015:08:05:32 +0000] "GET /downloads/product_1 HTTP/1.1" 304 0 "-" '
              '"Debian APT-HTTP/1.3 (0.8.16~exp12ubuntu10.21)"',
    "json": '{"timestamp":"2024-01-15T10:30:00Z","level":"error","service":"auth","msg":"token expired",'
            '"user_id":12345,"trace_id":"abc-def-123"}',
    "kv": "time=2024-01-15T10:30:00Z level=info component=api method=GET path=/health status=200 duration_ms=3",
    "app": "2024-01-15 10:30:00.123 [worker-3] ERROR c.e.PaymentService - Payment failed for order_id=ORD-9821 "
           'amount=149.99 currency=USD reason="insufficient funds"',
    "csv": "2024-01-15,10:30:00,192.168.1.1,GET,/api/users,200,0.034",
    "nested_json": '{"event":"user.login","props":{"uid":"u-3891","ip":"10.0.0.5","ua":"Mozilla/5.0"},"ts":1705312200}',
    "audit": "<134>Jan 15 10:30:00 dbhost oracle: DBUSER:'SYSTEM' ACTION:'100' RETCODE:'0'",
    "header": "2024-01-15 10:30:00 [worker-3] ERROR PaymentSvc - order=ORD-99 amt=149.99",
}
SHAPES = {
    "syslog": ("<<N>><TS> mymachine su: '<STR>' failed for lonvick on /dev/pts/<N>", "eb0a3ef645ad1537"),
    "access": ('<IP> - - [<TS>] "<STR>" <N> <N> "<STR>" "<STR>"', "1d0e4dca4a86b48f"),
    "json": ('{"<STR>":"<STR>","<STR>":"<STR>","<STR>":"<STR>","<STR>":"<STR>","<STR>":<N>,"<STR>":"<STR>"}',
             "a31f9fd6d689b473"),
    "kv": ("time=<TS> level=info component=api method=GET path=/health status=<N> duration_ms=<N>", "b71acdb8de5f2c2c"),
    "app": ("<TS> [worker-<N>] ERROR c.e.PaymentService - Payment failed for order_id=ORD-<N> amount=<N>.<N> "
            'currency=USD reason="<STR>"', "038d07cc517ce1d1"),
    "csv": ("<N>-<N>-<N>,<IP6>,<IP>,GET,/api/users,<N>,<N>.<N>", "c8fdd59dc5a9c178"),
    "nested_json": ('{"<STR>":"<STR>","<STR>":{"<STR>":"<STR>","<STR>":"<STR>","<STR>":"<STR>"},"<STR>":<EPOCH>}',
                    "56a86ffad41ad6d6"),
}


def one(spark, name):
    return spark.createDataFrame([(name, LINES[name])], "id string, raw string")


@pytest.fixture(scope="module")
def shaped(spark):
    rows = spark.createDataFrame(list(LINES.items()), "id string, raw string")
    return {r["id"]: r for r in fingerprint.line_signature(fingerprint.line_skeleton(rows)).collect()}


@pytest.mark.parametrize("name", SHAPES)
def test_shape(shaped, name):
    assert (shaped[name]["skeleton"], shaped[name]["signature"]) == SHAPES[name]


def test_syslog(spark):
    row = parsing.parse_syslog(one(spark, "syslog"), year=2023).first()
    assert row["ok"] and row["reason"] is None
    assert (row["appname"], row["hostname"], row["severity"], row["facility"]) == ("su", "mymachine", "crit", "auth")
    assert row["message"] == "'su root' failed for lonvick on /dev/pts/8"
    assert row["timestamp"] == dt.datetime(2023, 10, 11, 22, 14, 15)


def test_modern_syslog(spark):
    text = '<165>1 2003-10-11T22:14:15.003Z host.example evntslog - ID47 [ex@1 a="b"][x@2] An event'
    row = parsing.parse_syslog(spark.createDataFrame([(text,)], "raw string")).first()
    assert row["ok"]
    assert (row["version"], row["msgid"], row["procid"], row["message"]) == (1, "ID47", None, "An event")
    assert (row["facility"], row["severity"]) == ("local4", "notice")
    assert row["timestamp"] == dt.datetime(2003, 10, 11, 22, 14, 15, 3000)


def test_access(spark):
    row = parsing.parse_access_log(one(spark, "access")).first()
    assert row["ok"]
    assert (row["clientip"], row["verb"], row["request"], row["status"], row["bytes"]) == (
        "93.180.71.3", "GET", "/downloads/product_1", 304, 0)
    assert row["timestamp"] == dt.datetime(2015, 5, 17, 8, 5, 32)
    common = '1.2.3.4 - bob [17/May/2015:08:05:32 +0200] "GET / HTTP/1.0" 200 -'
    row = parsing.parse_access_log(spark.createDataFrame([(common,)], "raw string")).first()
    assert row["ok"] and row["bytes"] is None and row["agent"] is None
    assert row["timestamp"] == dt.datetime(2015, 5, 17, 6, 5, 32)


def test_json(spark):
    row = parsing.parse_json_log(one(spark, "json")).first()
    assert row["ok"]
    assert (row["level"], row["user_id"], row["trace_id"]) == ("error", 12345, "abc-def-123")
    assert row["timestamp"] == dt.datetime(2024, 1, 15, 10, 30)
    wrapped = '{"message":"{\\"level\\":\\"ERROR\\",\\"service\\":\\"auth\\",\\"user_id\\":\\"12\\"}","host":"srv01"}'
    row = parsing.parse_json_log(spark.createDataFrame([(wrapped,)], "raw string")).first()
    assert row["ok"] and (row["level"], row["service"], row["user_id"]) == ("error", "auth", 12)


def test_nested_json(spark):
    row = parsing.parse_json_log(one(spark, "nested_json"), fields=parsing.PROPS_JSON).first()
    assert row["ok"]
    assert (row["event_type"], row["user_id"], row["client_ip"]) == ("user.login", "u-3891", "10.0.0.5")
    assert row["timestamp"] == dt.datetime(2024, 1, 15, 9, 50)
    assert row["extra"] == {}


def test_key_value(spark):
    fields = {"timestamp": ("time", "timestamp"), "status": ("status", "int"), "duration_ms": ("duration_ms", "int")}
    row = parsing.parse_key_value(one(spark, "kv"), fields=fields).first()
    assert row["ok"] and (row["status"], row["duration_ms"]) == (200, 3)
    assert row["timestamp"] == dt.datetime(2024, 1, 15, 10, 30)
    assert row["fields"] == {"level": "info", "component": "api", "method": "GET", "path": "/health"}


def test_app(spark):
    row = parsing.parse_app_log(one(spark, "app")).first()
    assert row["ok"]
    assert (row["thread"], row["level"], row["logger"]) == ("worker-3", "error", "c.e.PaymentService")
    assert (row["order_id"], row["amount"], row["currency"], row["reason_text"]) == (
        "ORD-9821", 149.99, "USD", "insufficient funds")
    fields = {"order": ("order", "string"), "amount": ("amt", "double")}
    row = parsing.parse_app_log(one(spark, "header"), fields=fields).first()
    assert (row["level"], row["logger"], row["order"], row["amount"]) == ("error", "PaymentSvc", "ORD-99", 149.99)


def test_csv(spark):
    row = parsing.parse_csv_log(one(spark, "csv")).first()
    assert row["ok"] and row["timestamp"] == dt.datetime(2024, 1, 15, 10, 30)
    assert (row["client_ip"], row["method"], row["path"], row["status"], row["duration"]) == (
        "192.168.1.1", "GET", "/api/users", 200, 0.034)


def test_nested(spark):
    row = parsing.parse_nested(one(spark, "audit"), year=2024).first()
    assert row["ok"]
    assert (row["hostname"], row["appname"], row["db_user"], row["action_code"], row["return_code"]) == (
        "dbhost", "oracle", "SYSTEM", "100", "0")


def test_ocsf(spark):
    cases = [("syslog", 1001, 1, 100101, 1), ("access", 4002, 1, 400201, 4), ("app", 6003, 99, 600399, 6),
             ("audit", 3001, 1, 300101, 3), ("none", 1234, 5, 0, 0)]
    rows = spark.createDataFrame(cases, "id string, class int, activity int, type_uid_wanted int, category int")
    mapped = ocsf.ocsf_map(rows, F.col("class"), F.col("activity"), severity=F.lit("Crit"),
                           time=F.lit("2024-01-15 10:30:00").cast("timestamp")).collect()
    for row in mapped:
        assert (row["type_uid"], row["category_uid"]) == (row["type_uid_wanted"], row["category"])
        assert (row["severity_id"], row["time"]) == (5, 1705314600000)
        assert row["metadata"]["version"] == "1.1.0"


def test_formats(spark):
    rows = spark.createDataFrame([(k, v) for k, v in LINES.items()] + [("words", "nothing to see")], "id string, raw string")
    found = {r["id"]: r["format"] for r in parsing.detect_format(rows).collect()}
    assert found == {"syslog": "syslog", "access": "access", "json": "json", "kv": "key_value", "app": "app",
                     "csv": "csv", "nested_json": "json", "audit": "syslog", "header": "app", "words": "regex"}
