"""Lint checks against a character scan, and odd programs."""

import random
import re

import pytest

from lineforge.operators import audit


def programs(spark, codes):
    return spark.createDataFrame(list(enumerate(codes)), "program_id long, code string")


def scan_braces(code):
    """Plain state machine over characters: (line, rule) per finding."""
    found, depth, line, state, i = [], 0, 1, "code", 0
    while i < len(code):
        ch, nxt, prev = code[i], code[i + 1:i + 2], code[i - 1] if i else ""
        if ch == "\n":
            line += 1
            state = "code" if state == "comment" else state
        elif state == "comment":
            pass
        elif state == "code" and ch == "#":
            state = "comment"
        elif state != "regex" and ch == '"' and prev != "\\":
            state = "code" if state == "string" else "string"
        elif state == "code" and ch == "r" and nxt == "'":
            state = "regex"
            i += 1
        elif state == "regex" and ch == "'" and prev != "\\":
            state = "code"
        elif state == "code" and ch in "st" and nxt == "'":
            i += 2
            while i < len(code) and code[i] != "'":
                line += code[i] == "\n"
                i += 1
        elif state == "code" and ch == "{":
            depth += 1
        elif state == "code" and ch == "}":
            if depth:
                depth -= 1
            else:
                found.append((line, "unexpected_brace"))
        i += 1
    if depth:
        found.append((line, "unclosed_brace"))
    if state == "string":
        found.append((line, "unclosed_string"))
    if state == "regex":
        found.append((line, "unclosed_regex"))
    return found


def test_braces_equal_character_scan(spark):
    rng = random.Random(11)
    alphabet = ["{", "}", '"', "'", "\\", "r'", "s'", "t'", "#", "\n", "a", " ", "r", "t"]
    codes = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    codes += ["", '"', "r'", "r'\\'", "r''", '"\\"', '""', "s'", "{\n{", "}}", "# {", "r'a' }\n"]
    got = {}
    for r in audit.lint_braces(programs(spark, codes)).collect():
        got.setdefault(r["program_id"], []).append((r["line"], r["rule"]))
    for i, code in enumerate(codes):
        assert got.get(i, []) == scan_braces(code), repr(code)


CASES = [
    ("  let a = 1", [("let", 1)]), ("var a\nconst b = 2", [("var", 1), ("const", 2)]), ("return .a", [("return", 1)]),
    (".a = 1; # x", [("semicolon", 1)]), ("for x in y", [("for", 1)]), ("while true", [("while", 1)]),
    ("fn f()", [("fn", 1)]), ("def f", [("def", 1)]), ("match {", [("match", 1), ("unclosed_brace", 1)]),
    (".a ?? 1", [("coalesce", 1)]), ("# let a = 1", []), (".a = \"# let\" + 'x'", [("odd_quotes", 1)]),
    (".a = r 'x'", []), (".a = s'x' + t'y' + r'z'", []), (".a = 'it''s'", []),
    ('.a = r"x"', [("regex_double_quotes", 1)]), ('parse_regex!(.m, "a(b)")', [("regex_plain_string", 1)]),
    ("x = /ab/g", [("regex_slashes", 1)]), ("x = 4 / 2 / 1", []), ("r'(?<a>x)' + r'(?P<b>y)'", [("regex_capture_name", 1)]),
    (r'"\d \q \x41 \' \/ \n"', [("regex_escape", 1), ("unknown_escape", 1)]), (r"r'\\d'", [("double_escaped_regex", 1)]),
    (r"r'a\'b('", [("regex_compile", 1)]), ("r'(?P<n>a' r'[' r'ok'", [("regex_compile", 1)] * 2),
]


@pytest.fixture(scope="module")
def linted(spark):
    return [r["issues"] for r in audit.with_issues(programs(spark, [c for c, _ in CASES])).orderBy("program_id").collect()]


def single_quotes(code):
    """Lines of quoted texts that no r, s or t stands before; comments are cut first."""
    found = []
    for number, line in enumerate(code.split("\n"), 1):
        line = re.sub(r"#.*$", "", line)
        for hit in re.finditer(r"(?<![rst])'([^'\\]|\\.)*'", line):
            if not re.search(r"[rst]\s*$", line[: hit.start()]):
                found.append(number)
    return found


@pytest.mark.parametrize("index", range(len(CASES)))
def test_rules(linted, index):
    """Quote warnings also hit the gap between two literals; they are counted apart."""
    code, wanted = CASES[index]
    got = [(i["rule"], i["line"]) for i in linted[index]]
    assert sorted(g for g in got if g[0] != "single_quotes") == sorted(wanted)
    assert [line for rule, line in got if rule == "single_quotes"] == single_quotes(code)


def test_single_quotes_equal_python(spark):
    rng = random.Random(3)
    alphabet = ["'", "'", "\\", "r", "s", "t", " ", "a", "#", "\n"]
    codes = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    got = {}
    for r in audit.lint_literals(programs(spark, codes)).filter("rule = 'single_quotes'").collect():
        got.setdefault(r["program_id"], []).append(r["line"])
    for i, code in enumerate(codes):
        assert sorted(got.get(i, [])) == single_quotes(code), repr(code)


def test_messages(spark):
    codes = ['parse_regex!(.m, "a(b)")', "{\n{", r'"\d"', "x = '1'\nlet a = 1"]
    rows = {r["program_id"]: r for r in audit.lint_summary(programs(spark, codes)).collect()}
    assert "Change \"a(b)\" to r'a(b)'" in rows[0]["report"]
    assert "  Line 2: 2 unclosed brace(s) — missing '}'\n" in rows[1]["report"]
    assert "Escape '\\d' is a regex escape" in rows[2]["report"]
    assert rows[3]["report"].startswith("STATIC ANALYSIS ERRORS (1):\n  Line 2: VRL does not use 'let'")
    assert "WARNINGS (1):\n  Line 1: Possible single-quoted" in rows[3]["report"]
    assert (rows[3]["errors"], rows[3]["warnings"]) == (1, 1)


def test_long_program(spark):
    code = "x = \"" + "a\\n" * 30_000 + "\"\n" + "y = r'" + "\\d" * 20_000 + "'\n{"
    rows = audit.lint_summary(programs(spark, [code])).collect()
    assert (rows[0]["errors"], rows[0]["warnings"]) == (1, 0)


def test_quality(spark):
    rows = spark.createDataFrame([
        (1, '{"message":"m"}', ""), (2, '{"message":"m"}', '{"message":"m"}'), (3, '{"message":"m"}', '{"message":"m","x":1}'),
        (4, '{"message":"m"}', '{"message":"","x":1}'), (5, "raw", '{"a":1}'), (6, '{"message":"m"}', "{bad"),
        (7, '{"message":"m"}', "{\"a\":t'2024',\"b\":r'x',\"c\":1}"), (8, '{"a":1,"b":2}', '{"a":1}')],
        "run_id long, input string, stdout string")
    got = [r["warning"] for r in audit.output_quality(rows).orderBy("run_id").collect()]
    assert got == [audit.NO_OUTPUT, audit.NO_NEW_FIELDS, audit.ONLY_MESSAGE, None, None, None, None, audit.NO_NEW_FIELDS]


def test_triage(spark):
    rows = spark.createDataFrame([
        (1, "m", '{"a":1}', "2024-01-01T00:00:00Z  INFO x", 0, False, None), (2, "m", "x", "error: bad", 0, False, None),
        (3, "m", "x", "an error here", 0, False, None), (4, "m", "\x1b[0m \n", "", 0, False, None),
        (5, "m", "", "", 1, False, "ENOENT"), (6, "m", "", "", 1, True, None), (7, "m", "o", "e", 2, False, None),
        (8, "m", "", "", 2, False, None)],
        "run_id long, input string, stdout string, stderr string, exit_code int, killed boolean, error_code string")
    got = {r["run_id"]: (r["outcome"], r["error"]) for r in audit.run_triage(rows).collect()}
    assert [got[i][0] for i in range(1, 9)] == [
        "ok", "runtime_error", "ok", "empty", "not_found", "timeout", "failed", "failed"]
    assert got[7][1] == "e" and got[8][1] == "Unknown error" and got[2][1] == "Runtime error: error: bad"


def test_wrap(spark):
    rows = spark.createDataFrame([('{ "b" : "x y" , "a":1}',), ("[1]",), ("plain \"q\"",)], "input string")
    assert [r["event"] for r in audit.input_wrap(rows).collect()] == [
        '{"b":"x y","a":1}', '{"message":"[1]"}', '{"message":"plain \\"q\\""}']


def test_triage_reads_signal_and_message(spark):
    rows = spark.createDataFrame([
        (1, None, None, None, None, None, False, "SIGTERM", None), (2, None, None, None, None, None, False, "SIGKILL", "\x1b[31mgone"),
        (3, "", "", "", 3, None, None, None, None), (4, "{}", "", "", 0, None, True, None, "m"), (5, "{}", "o", "e", 0, "ENOENT", True, None, "m"),
        (6, "{}", "o", "e", 0, None, False, "SIGSEGV", "m")],
        "run_id long, input string, stdout string, stderr string, exit_code int, error_code string, killed boolean, signal string, message string")
    found = {r["run_id"]: (r["outcome"], r["error"], r["exit"]) for r in audit.run_triage(rows, timeout_ms=9).collect()}
    assert found == {
        1: ("timeout", "Vector timed out after 9ms", -2), 2: ("failed", "gone", 1), 3: ("failed", "Unknown error", 3),
        4: ("timeout", "Vector timed out after 9ms", -2), 5: ("not_found", "Vector binary not found at: vector", -1),
        6: ("failed", "e", 0)}
    plain = audit.run_triage(rows.drop("signal", "message")).where("run_id = 2").first()
    assert (plain["outcome"], plain["error"]) == ("failed", "Unknown error")
