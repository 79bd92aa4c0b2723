"""Rows that do not fit, odd key-value text, coercion, flattening, routing."""

import json
import random
import time

import pytest

from pyspark.sql import functions as F

from lineforge.operators import parsing
from lineforge.session import scratch_path
from lineforge.sources import files, sinks


def table(spark, texts, name="raw"):
    return spark.createDataFrame([(t,) for t in texts], f"{name} string")


def pairs(spark, text, **options):
    return table(spark, [text]).select(parsing.key_value_map(F.col("raw"), **options).alias("m")).first()["m"]


def test_no_parser_fails_on_junk(spark):
    junk = table(spark, ["", "   ", "nonsense", "<999>Jan 1 00:00:00 h a: m", "<1>Foo 99 00:00:00 h a: m", "[", "{", '"', "=", None])
    for parse in (parsing.parse_syslog, parsing.parse_access_log, parsing.parse_json_log, parsing.parse_key_value,
                  parsing.parse_csv_log, parsing.parse_app_log, parsing.parse_nested, parsing.parse_mixed):
        rows = parse(junk).collect()
        assert len(rows) == 10
        assert not any(r["ok"] for r in rows), parse.__name__
        assert all(r["reason"] for r in rows if r["raw"] is not None), parse.__name__


def test_access_shaped_line_that_is_none(spark):
    row = parsing.parse_mixed(table(spark, ['a b c [x] "GET'])).first()
    assert row["format"] == "access" and not row["ok"]


def test_key_value_quotes_and_repeats(spark):
    assert pairs(spark, "a='x y' b=\"p=q r\" c= d=1") == {"a": "x y", "b": "p=q r", "c": "", "d": "1"}
    assert pairs(spark, "k=1 k=2") == {"k": "2"}
    assert pairs(spark, "lone k=v") == {"k": "v"}
    assert pairs(spark, "lone k=v e=", standalone_keys=True) == {"lone": "true", "k": "v", "e": ""}
    assert pairs(spark, "a: 1, b: x y", key_value_delimiter=": ", field_delimiter=", ") == {"a": "1", "b": "x y"}
    assert pairs(spark, "a:1|b:2 3", key_value_delimiter=":", field_delimiter="|") == {"a": "1", "b": "2 3"}


def test_bad_field_is_named(spark):
    row = parsing.parse_key_value(table(spark, ["n=x m=2"]), fields={"n": ("n", "int"), "m": ("m", "int")}).first()
    assert (row["ok"], row["reason"], row["n"], row["m"]) == (False, "bad field: n", None, 2)
    row = parsing.parse_json_log(table(spark, ['{"user_id":"x","level":"INFO"}'])).first()
    assert (row["ok"], row["reason"], row["level"]) == (False, "bad field: user_id", "info")


def test_json_shapes(spark):
    rows = parsing.parse_json_log(table(spark, ["[1]", "3", '{"a":1,"a":2}', "{}", '{"x":null}'])).collect()
    assert [r["ok"] for r in rows] == [False, False, True, True, True]
    assert rows[2]["extra"] == {"a": "2"} and rows[4]["extra"] == {"x": None}


def test_csv_quotes_and_width(spark):
    rows = parsing.parse_csv_log(table(spark, [
        '2024-01-15,10:30:00,1.1.1.1,GET,"/a,""b""",200,1.5', "2024-01-15,10:30:00,1.1.1.1,GET,/a,200",
        "2024-01-15,10:30:00,1.1.1.1,GET,/a,200,1,2", "2024-01-15,10:30:00,1.1.1.1,GET,/a,two,1"])).collect()
    assert rows[0]["path"] == '/a,"b"' and rows[0]["ok"]
    assert [r["reason"] for r in rows[1:]] == ["wrong number of columns", "wrong number of columns", "bad field: status"]


def test_coerce_words(spark):
    words = ["yes", "No", "1", "0", "TRUE", "false", "maybe", ""]
    rows = parsing.coerce_fields(table(spark, words, "b"), {"b": "bool"}).collect()
    assert [r["b"] for r in rows] == [True, False, True, False, True, False, None, None]
    assert [r["ok"] for r in rows] == [True] * 6 + [False] * 2


def test_flatten_and_compact(spark):
    deep = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1}}}}}},"n":null,"e":"","l":[1,{"x":2}],"o":{},"k":"v","s":"[]","m":[]}'
    row = parsing.compact_flatten(table(spark, [deep], "event_json")).first()
    # all levels, and a text that looks like an empty array stays
    assert row["flat"] == {"a.b.c.d.e.f.g": "1", "l": '[1,{"x":2}]', "k": "v", "s": "[]"}


def nested(levels):
    return '{"k":' * levels + "1" + "}" * levels


@pytest.mark.parametrize("text, flat", [
    (nested(60), {".".join("k" * 60): "1"}),
    (nested(1000), {".".join("k" * 1000): "1"}),
    (nested(1001), None),  # more than Spark's parser reads
    ("[1]", None), ("3", None), ("no json", None), ("", None), (None, None),
    ("{}", {}), ('{"a":{}}', {}),
    ('{"a":1.50,"b":1.0,"a":{"c":true}}', {"a.c": "true", "b": "1"}),  # the last of repeated keys
    (r'{"q\"u":{"x,":"a,\"b:"},"z":[[1.50],"],"],"t":"\\","u":"\u00e9"}',
     {'q"u.x,': 'a,"b:', "z": '[[1.5],"],"]', "t": "\\", "u": "é"}),
])
def test_flatten_any_depth(spark, text, flat):
    assert parsing.compact_flatten(table(spark, [text], "event_json")).first()["flat"] == flat


def test_flatten_wide_and_long(spark):
    """Members on both sides of the runs that a walk is cut into, and arrays across them."""
    many = {f"k{i}": {"x": str(i), "l": list(range(i % 150))} for i in range(700)}
    row = parsing.compact_flatten(table(spark, [json.dumps(many)], "event_json")).first()["flat"]
    wanted = {f"k{i}.x": str(i) for i in range(700)} | {
        f"k{i}.l": json.dumps(v["l"], separators=(",", ":")) for i, v in enumerate(many.values()) if v["l"]}
    assert row == wanted


def test_flatten_work_grows_with_the_text(spark):
    """Deep objects cost as much a token as flat ones: a walk that copies its stack takes three times as long or more."""
    texts = table(spark, [nested(500)] * 800, "event_json").coalesce(1)
    parsing.compact_flatten(texts.limit(1)).collect()
    begun = time.monotonic()
    rows = parsing.compact_flatten(texts).collect()
    assert time.monotonic() - begun < 25
    assert [r["flat"] for r in rows] == [{".".join("k" * 500): "1"}] * 800


def test_flatten_plan_does_not_read_the_data(spark):
    """Nothing runs while the plan is made, so it works on streams, and its size is that of the expression."""
    stream = spark.readStream.format("rate").load().selectExpr("cast(value as string) AS event_json")
    assert parsing.compact_flatten(stream).isStreaming


def test_epoch_out_of_range(spark):
    rows = parsing.coerce_fields(table(spark, ["99999999999999", "0"], "t"), {"t": "epoch"}).collect()
    assert [r["ok"] for r in rows] == [False, True] and rows[0]["t"] is None


def test_routing(spark):
    lines = table(spark, ["<34>Oct 11 22:14:15 h su: x", "junk"])
    path = scratch_path(spark, "routing")
    sinks.write_routed(parsing.parse_syslog(lines, year=2023), path)
    assert spark.read.parquet(f"{path}/route=events").count() == 1
    dead = spark.read.parquet(f"{path}/route=dead_letter").collect()
    assert [(r["raw"], r["reason"]) for r in dead] == [("junk", "not syslog")]


def test_logfmt(spark):
    rows = spark.createDataFrame([(1, None, 'a "b"\n', "")], "n int, x string, q string, e string")
    assert sinks.encode_events(rows, ["n", "x", "q", "e"], "logfmt").first()["encoded"] == 'n=1 q="a \\"b\\"\\n" e=""'


def random_json(rng, depth=0):
    """Values full of what could mislead a cut: commas, brackets, quotes and backslashes in strings."""
    kind = rng.randrange(7 if depth < 4 else 3)
    if kind < 3:
        text = "".join(rng.choice(',[]{}"\\ aé🙂:') for _ in range(rng.randrange(12)))
        return rng.choice([text, rng.randrange(100), None, True, -1.5])
    if kind < 5:
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {f"k{i},": random_json(rng, depth + 1) for i in range(rng.randrange(5))}


@pytest.mark.parametrize("split_bytes", ["37", "1000", "128m"])
def test_array_is_cut_in_blocks(spark, tmp_path, split_bytes):
    """One file of many splits gives the elements that reading it whole gives."""
    rng = random.Random(7)
    wanted = [random_json(rng) for _ in range(150)] + ["long " + '",[' * 300, list(range(300))]
    (tmp_path / "a b.json").write_text(" [" + " ,\n".join(json.dumps(x, ensure_ascii=rng.random() < 0.5) for x in wanted) + "\n]\n")
    (tmp_path / "one.json").write_text("[7]")
    (tmp_path / "none.json").write_text(" [ \n] ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        scanned = files.scan_events(spark, str(tmp_path), shape="array")
        rows = scanned.collect()
        parts = spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert all(r["ok"] for r in rows)
    assert sorted(json.dumps(json.loads(r["text"])) for r in rows) == sorted(json.dumps(x) for x in [*wanted, 7])
    assert split_bytes == "128m" or parts > 10


@pytest.mark.parametrize("body, wanted", [
    ("[1, 2", [("1", True, None), ("2", True, None), ("", False, "array does not end")]),
    ('[1, "a]', [("1", True, None), ('"a]', False, "not valid JSON"), ("", False, "array does not end")]),
    ("[1] 2, 3", [("1", True, None), ("2, 3", False, "outside the array")]),
    ("[1, bad, 3]", [("1", True, None), ("bad", False, "not valid JSON"), ("3", True, None)]),
    ('{"a": [1, 2]}', [('{"a": [1, 2]}', False, "not an array")]), ("", []), ("[]", []),
])
def test_arrays_that_are_broken(spark, tmp_path, body, wanted):
    (tmp_path / "a.json").write_text(body)
    rows = files.scan_events(spark, str(tmp_path), shape="array").collect()
    assert sorted((r["text"], r["ok"], r["reason"]) for r in rows) == sorted(wanted)
    with pytest.raises(Exception):
        if all(ok for _, ok, _ in wanted):
            raise ValueError("nothing to fail on")
        files.scan_events(spark, str(tmp_path), shape="array", mode="failfast").collect()


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [\n {"a": 1},\n 2, {"a": 3}]\n')
    (tmp_path / "b.json").write_text('{"a": 4}\n\n  {"a": 5}\nbad\n')
    events = files.scan_events(spark, str(tmp_path), shape="auto").collect()
    assert sorted((r["text"], r["ok"]) for r in events) == sorted([
        ('{"a": 1}', True), ("2", True), ('{"a": 3}', True), ('{"a": 4}', True), ('{"a": 5}', True), ("bad", False)])
    shapes = {r["file"].rsplit("/", 1)[1]: r["shape"] for r in files.detect_input_shape(spark, str(tmp_path)).collect()}
    assert shapes == {"a.json": "batch", "b.json": "single"}
    firsts = sorted(r["raw"] for r in files.scan_lines(spark, str(tmp_path), "first").collect())
    assert firsts == [" [", '{"a": 4}']
    assert files.scan_lines(spark, str(tmp_path), "whole").count() == 2
    try:
        files.scan_events(spark, str(tmp_path / "b.json"), mode="failfast").collect()
        raise AssertionError("a bad line went through")
    except Exception as problem:
        assert "MALFORMED" in str(problem).upper()


@pytest.mark.parametrize("data, wanted", [
    ("-", None),
    ("[only@1]", {"only@1": {}}),
    (r'[a x="1" y="a\"b\]c\\d"][b z=""]', {"a": {"x": "1", "y": 'a"b]c\\d'}, "b": {"z": ""}}),
    ('[a x="]"]', {"a": {"x": "]"}}),  # bare brackets in quotes are read as well
    ('[a x="1" x="2"][a y="3"]', {"a": {"y": "3"}}),
])
def test_structured_data(spark, data, wanted):
    row = parsing.parse_syslog(table(spark, [f"<34>1 2024-01-05T10:00:00Z h app 7 ID1 {data} the [message]"])).first()
    assert (row["ok"], row["message"], row["structured_data"]) == (True, "the [message]", wanted)


def test_structured_data_that_does_not_end(spark):
    lines = [f"<34>1 2024-01-05T10:00:00Z h app 7 ID1 {d} m" for d in ('[a x="1"', '[a x="1\\"]', "[" * 5000)]
    assert [r["ok"] for r in parsing.parse_syslog(table(spark, lines)).collect()] == [False] * 3


def test_mixed_lines_keep_all_fields(spark):
    lines = [
        "time=2024-01-05T10:00:00Z level=info extra=7 user=bob",
        '{"time":"2024-01-05T10:00:00Z","timestamp":"2024-01-05T11:00:00Z","level":"x","a":{"b":1},"n":null}',
        '<34>1 2024-01-05T10:00:00Z h app 7 ID1 [e@1 k="v w"] text',
        '1.2.3.4 - - [05/Jan/2024:10:00:00 +0000] "GET /x HTTP/1.1" 200 -',
        "2024-01-05 10:00:00 [t1] INFO c.x - did it id=5",
        "2024-01-05,10:00:00,1.2.3.4,GET,/x,200,1.5", "no shape at all",
    ]
    rows = parsing.parse_mixed(table(spark, lines)).collect()
    assert [r["extra"] for r in rows] == [
        {"extra": "7", "user": "bob"}, {"time": "2024-01-05T10:00:00Z", "a": '{"b":1}'},
        {"facility": "auth", "hostname": "h", "procid": "7", "msgid": "ID1", "version": "1", "e@1.k": "v w"},
        {"httpversion": "1.1"}, {"thread": "t1", "id": "5"}, {"duration": "1.5"}, None]
    assert [r["ok"] for r in rows] == [True] * 6 + [False]


def test_own_patterns(spark):
    lines = ["id=5 by bob", "by ann", "x id=7 y by", "", None, "id=(9)"]
    parsed = parsing.parse_regex(
        table(spark, lines), [r"id=(?P<number>\d+)(?: by (?<who_is>\w+))?", r"^by (?P<who_is>\w+)$", r"id=\((\d)\)"],
        fields={"number": ("number", "long")})
    rows = parsed.collect()
    assert [r["pattern"] for r in rows] == [0, 1, 0, None, None, 2]
    assert [r["number"] for r in rows] == [5, None, 7, None, None, None]
    assert [r["fields"] for r in rows] == [{"who_is": "bob"}, {"who_is": "ann"}, {}, None, None, {}]
    assert [r["reason"] for r in rows] == [None, None, None, "no pattern found", "no pattern found", None]


def test_named_groups():
    assert parsing.named_groups(r"(a)(?P<x_1>b)(?:c)[(?<no>]\(?(?<y>d(?=e)(?<!f))") == (
        r"(a)(b)(?:c)[(?<no>]\(?(d(?=e)(?<!f))", {"x_1": 2, "y": 3})


def test_groks(spark):
    lines = ["10.0.0.1 took 5", "fe80::1 took x", "host-1.example took 12"]
    parsed = parsing.parse_groks(table(spark, lines), ["^%{IPORHOST:client} took %{NUM:ms:int}$"], aliases={"NUM": "%{INT}"})
    rows = parsed.collect()
    assert [(r["ms"], r["fields"]) for r in rows] == [
        (5, {"client": "10.0.0.1"}), (None, None), (12, {"client": "host-1.example"})]
    for pattern in ("%{NOPE}", "%{LOOP}"):
        with pytest.raises(ValueError):
            parsing.expand_groks(pattern, {"LOOP": "%{LOOP}"})
