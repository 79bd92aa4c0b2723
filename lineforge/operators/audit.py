"""Audits of parser programs, of their output, and of tool runs.

Lint checks are column expressions that turn one program into an array of issues, so a whole
library is audited without a shuffle; ``lint_*`` only opens the arrays into rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineforge.functions import json as js
from lineforge.functions import text as tx

ISSUE = "struct<line:int,severity:string,rule:string,message:string>"
ISSUES = f"array<{ISSUE}>"

# Constructs the language lacks, with the message each one gets.
FORBIDDEN_RULES: list[tuple[str, str, str]] = [
    ("let", r"^\s*let\s+\w+", "VRL does not use 'let' — write: variable_name = value"),
    ("var", r"^\s*var\s+\w+", "VRL does not use 'var' — write: variable_name = value"),
    ("const", r"^\s*const\s+\w+", "VRL does not use 'const' — write: variable_name = value"),
    ("return", r"\breturn\s", "VRL does not use 'return' — the last expression is the return value"),
    ("semicolon", r";\s*$", "VRL does not use semicolons — use newlines to separate statements"),
    ("for", r"^\s*for\s+", "VRL does not have for loops"),
    ("while", r"^\s*while\s+", "VRL does not have while loops"),
    ("fn", r"^\s*fn\s+", "VRL does not support custom function definitions"),
    ("def", r"^\s*def\s+", "VRL does not support custom function definitions"),
    ("match", r"\bmatch\s*\{", "VRL does not have match/switch — use if/else if/else"),
    ("coalesce", r"\?\?", "Do not use ?? operator — use ', err = ' error assignment pattern instead"),
]

# Messages of the other checks.
MESSAGES = {
    "unexpected_brace": "Unexpected closing '}' — no matching '{'",
    "unclosed_brace": " unclosed brace(s) — missing '}'",
    "unclosed_string": "Unclosed string literal — missing closing '\"'",
    "unclosed_regex": "Unclosed regex literal — missing closing \"'\" for r'...'",
    "single_quotes": "Possible single-quoted string — VRL strings use double quotes \"...\". "
                     "Single quotes are for r'regex', s'raw', t'timestamp' only.",
    "odd_quotes": "Unmatched double quote — unclosed string literal on this line",
    "regex_double_quotes": "Regex must use single quotes: r'pattern' — not r\"pattern\"",
    "regex_slashes": "VRL does not use /regex/ syntax — use r'pattern' instead",
    "regex_capture_name": "VRL named captures use (?P<name>...) syntax — not (?<name>...). Add the 'P' after '?'.",
    "double_escaped_regex": "Double-escaped regex inside r'...' — backslashes in r'...' are regex escapes "
                            "directly. Use \\d not \\\\d.",
}

DOUBLE_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
REGEX_LITERAL = r"r'([^'\\]*+(?:\\.[^'\\]*+)*+)'"
SINGLE_QUOTED = r"([rst]\s++)?(?<![rst])'[^'\\]*+(?:\\.[^'\\]*+)*+'"
PLAIN_PATTERN = r'parse_regex!\s*\([^,]+,\s*"([^"]+)"\s*\)'
# Comments, strings, r'' literals, s'' and t'' literals, braces and line ends, in scan order. A
# quote closes a literal unless the character before it is a backslash, and literals may span lines.
TOKENS = (
    r"(#[^\n]*+"
    r"|(?<!\\)\"(?:[^\"]++|(?<=\\)\")*+(?:\"|\z)"
    r"|r'(?:[^']++|(?<=\\)')*+(?:'|\z)"
    r"|[st]'[^']*+(?:'|\z)"
    r"|[{}\n])"
)


def _issue(line: Column, severity: str, rule: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        line.cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
        text.alias("message"))


def _present(*issues: Column) -> Column:
    return F.filter(F.array(*issues), lambda i: i.isNotNull())


def _numbered(code: Column, check: Callable[[Column, Column], Column]) -> Column:
    """Issues of every line, comments cut off; ``check(line_text, line_number)`` gives an array."""
    lines = F.split(code, "\n", -1)
    return F.flatten(F.transform(lines, lambda text, i: check(F.regexp_replace(text, r"#.*$", ""), i + 1)))


def forbidden_issues(code: Column) -> Column:
    return _numbered(code, lambda text, n: _present(*[
        F.when(text.rlike(pattern), _issue(n, "error", rule, message)) for rule, pattern, message in FORBIDDEN_RULES]))


def brace_issues(code: Column) -> Column:
    """Brace balance and unclosed literals, by one pass over the program's tokens."""
    start = F.struct(
        F.lit(1).alias("line"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("unexpected"))

    def step(state: Column, token: Column) -> Column:
        extra = (token == "}") & (state["depth"] == 0)
        newlines = F.length(token) - F.length(F.regexp_replace(token, "\n", ""))
        depth = (
            F.when(token == "{", state["depth"] + 1)
            .when((token == "}") & (state["depth"] > 0), state["depth"] - 1)
            .otherwise(state["depth"]))
        return F.struct(
            (state["line"] + newlines).cast("int").alias("line"), depth.cast("int").alias("depth"),
            F.when(extra, F.array_append(state["unexpected"], state["line"]))
            .otherwise(state["unexpected"]).alias("unexpected"))

    def finish(state: Column, last: Column) -> Column:
        is_text, is_regex = last.startswith('"'), last.startswith("r'")
        text_closed = last.rlike(r'(?s)\A".*(?<!\\)"\z')
        regex_closed = last.rlike(r"(?s)\Ar'(?:.*(?<!\\))?'\z")
        stray = F.transform(
            state["unexpected"], lambda n: _issue(n, "error", "unexpected_brace", MESSAGES["unexpected_brace"]))
        depth_text = F.concat(state["depth"].cast("string"), F.lit(MESSAGES["unclosed_brace"]))
        ends = _present(
            F.when(state["depth"] > 0, _issue(state["line"], "error", "unclosed_brace", depth_text)),
            F.when(is_text & ~text_closed,
                   _issue(state["line"], "error", "unclosed_string", MESSAGES["unclosed_string"])),
            F.when(is_regex & ~regex_closed,
                   _issue(state["line"], "error", "unclosed_regex", MESSAGES["unclosed_regex"])))
        return F.concat(stray, ends)

    def scan(tokens: Column) -> Column:
        found = F.aggregate(tokens, start, step, lambda state: finish(state, F.element_at(tokens, -1)))
        return F.when(F.size(tokens) > 0, found).otherwise(F.array().cast(ISSUES))

    # an array of one names the tokens, so that they are cut once
    return F.transform(F.array(F.regexp_extract_all(code, F.lit(TOKENS), F.lit(1))), scan)[0]


def literal_issues(code: Column) -> Column:
    """Quotes line by line: single-quoted text and an odd number of double quotes."""
    def check(text: Column, n: Column) -> Column:
        lead = F.regexp_extract_all(text, F.lit(SINGLE_QUOTED), F.lit(1))
        single = F.transform(
            F.filter(lead, lambda p: p == ""),
            lambda _: _issue(n, "warning", "single_quotes", MESSAGES["single_quotes"]))
        quotes = F.size(F.filter(F.regexp_extract_all(text, F.lit(r'\\.|(")'), F.lit(1)), lambda q: q != ""))
        return F.concat(single, _present(
            F.when(quotes % 2 != 0, _issue(n, "error", "odd_quotes", MESSAGES["odd_quotes"]))))

    return _numbered(code, check)


def regex_issues(code: Column) -> Column:
    """Regex literals in the wrong quotes, plain strings as patterns, slashes, capture names."""
    def check(text: Column, n: Column) -> Column:
        plain = F.regexp_extract(text, PLAIN_PATTERN, 1)
        plain_text = F.concat(
            F.lit("Regex pattern must use r'...' syntax — not a double-quoted string. Change \""), plain,
            F.lit("\" to r'"), plain, F.lit("'"))
        named = F.filter(
            F.regexp_extract_all(text, F.lit(REGEX_LITERAL), F.lit(0)),
            lambda p: p.contains("(?<") & ~p.contains("(?P<"))
        return F.concat(
            _present(
                F.when(text.rlike(r'r"[^"]*"'),
                       _issue(n, "error", "regex_double_quotes", MESSAGES["regex_double_quotes"])),
                F.when(text.rlike(PLAIN_PATTERN), _issue(n, "error", "regex_plain_string", plain_text)),
                F.when(text.rlike(r"[=,(\s]/[^/\s][^/]*/[gimsy]*"),
                       _issue(n, "error", "regex_slashes", MESSAGES["regex_slashes"]))),
            F.transform(named, lambda _: _issue(n, "error", "regex_capture_name", MESSAGES["regex_capture_name"])))

    return _numbered(code, check)


def escape_issues(code: Column) -> Column:
    """Escapes inside strings, and doubled backslashes inside regex literals."""
    def of_escape(escape: Column, n: Column) -> Column:
        shown = F.concat(F.lit("\\"), escape)
        regex_text = F.concat(
            F.lit("Escape '"), shown,
            F.lit("' is a regex escape, not a string escape. If this is a regex pattern, use r'...' syntax "
                  'instead of "..."'))
        unknown_text = F.concat(
            F.lit("Unknown string escape sequence '"), shown,
            F.lit("'. Valid VRL string escapes: \\n \\t \\r \\\\ \\\" \\0"))
        return (
            F.when(escape.isin("n", "t", "r", "\\", '"', "0", "'", "/", "x", "u"), None)
            .when(escape.isin("d", "w", "s", "b"), _issue(n, "error", "regex_escape", regex_text))
            .otherwise(_issue(n, "warning", "unknown_escape", unknown_text)))

    def check(text: Column, n: Column) -> Column:
        strings = F.regexp_extract_all(text, F.lit(DOUBLE_QUOTED), F.lit(1))
        escapes = F.flatten(F.transform(strings, lambda s: F.regexp_extract_all(s, F.lit(r"\\(.)"), F.lit(1))))
        in_strings = F.filter(F.transform(escapes, lambda e: of_escape(e, n)), lambda i: i.isNotNull())
        literals = F.regexp_extract_all(text, F.lit(REGEX_LITERAL), F.lit(1))
        doubled = F.filter(
            literals, lambda p: p.contains("\\\\d") | p.contains("\\\\w") | p.contains("\\\\s"))
        return F.concat(in_strings, F.transform(
            doubled, lambda _: _issue(n, "warning", "double_escaped_regex", MESSAGES["double_escaped_regex"])))

    return _numbered(code, check)


@F.pandas_udf(T.ArrayType(T.StringType()))
def compile_errors(patterns: pd.Series) -> pd.Series:
    """Per list of patterns: the compile error of each, or null. A pattern is tried once a batch."""
    seen: dict[str, str | None] = {}

    def error(pattern: str) -> str | None:
        if pattern not in seen:
            try:
                # Both spellings of a named group count as valid here; another check tells them apart.
                re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
                seen[pattern] = None
            except (re.error, RecursionError, OverflowError) as problem:
                seen[pattern] = str(problem)
        return seen[pattern]

    return patterns.map(lambda items: [error(p) for p in items])


# Kept out of filters and other projections, so that it runs once per program.
compile_errors = compile_errors.asNondeterministic()


def _regex_literals(code: Column) -> Column:
    """All regex literals of a program with their line."""
    return _numbered(code, lambda text, n: F.transform(
        F.regexp_extract_all(text, F.lit(REGEX_LITERAL), F.lit(1)),
        lambda p: F.struct(n.alias("line"), p.alias("pattern"))))


def _with_compile_issues(programs: DataFrame, code: str, out: str) -> DataFrame:
    """Adds the regex compile issues; the only Python in an audit, fed with patterns alone."""
    found = programs.withColumn("__found", _regex_literals(F.col(code)))
    tried = F.transform("__found", lambda f: F.regexp_replace(f["pattern"], r"\\'", "'"))
    errors = found.withColumn("__errors", compile_errors(tried))
    shown = F.transform(F.arrays_zip("__found", "__errors"), lambda z: F.when(
        z["__errors"].isNotNull(), _issue(
            z["__found"]["line"], "error", "regex_compile", F.concat(
                F.lit("Regex r'"), F.substring(z["__found"]["pattern"], 1, 60),
                F.when(F.length(z["__found"]["pattern"]) > 60, "...").otherwise(""),
                F.lit("' is invalid: "), z["__errors"]))))
    return errors.withColumn(out, F.filter(shown, lambda i: i.isNotNull())).drop("__found", "__errors")


def _rows(programs: DataFrame, issues: Column, key: str) -> DataFrame:
    return programs.select(key, F.explode(issues).alias("i")).select(key, "i.*")


def lint_forbidden(programs: DataFrame, key: str = "program_id", code: str = "code") -> DataFrame:
    return _rows(programs, forbidden_issues(F.col(code)), key)


def lint_braces(programs: DataFrame, key: str = "program_id", code: str = "code") -> DataFrame:
    return _rows(programs, brace_issues(F.col(code)), key)


def lint_literals(programs: DataFrame, key: str = "program_id", code: str = "code") -> DataFrame:
    return _rows(programs, F.concat(literal_issues(F.col(code)), regex_issues(F.col(code))), key)


def lint_escapes(programs: DataFrame, key: str = "program_id", code: str = "code") -> DataFrame:
    return _rows(programs, escape_issues(F.col(code)), key)


def lint_regex_compile(programs: DataFrame, key: str = "program_id", code: str = "code") -> DataFrame:
    return _rows(_with_compile_issues(programs, code, "__issues"), F.col("__issues"), key)


def with_issues(programs: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``issues``: all checks' findings in check order."""
    compiled = _with_compile_issues(programs, code, "__compile")
    c = F.col(code)
    everything = F.concat(
        brace_issues(c), forbidden_issues(c), literal_issues(c), regex_issues(c), escape_issues(c),
        F.col("__compile"))
    return compiled.withColumn("issues", everything).drop("__compile")


def lint_summary(programs: DataFrame, key: str = "program_id", code: str = "code") -> DataFrame:
    """Per program: errors, warnings and the findings as text, errors first. No shuffle."""
    errors = F.filter("issues", lambda i: i["severity"] == "error")
    warnings = F.filter("issues", lambda i: i["severity"] == "warning")

    def block(found: Column, title: str, after: str) -> Column:
        lines = F.transform(found, lambda i: F.concat(
            F.lit("  Line "), i["line"].cast("string"), F.lit(": "), i["message"], F.lit("\n")))
        head = F.concat(F.lit(title), F.size(found).cast("string"), F.lit(after))
        return F.when(F.size(found) > 0, F.concat(head, F.array_join(lines, ""))).otherwise("")

    split = with_issues(programs, code).select(key, errors.alias("e"), warnings.alias("w"))
    text = F.concat(block(F.col("e"), "STATIC ANALYSIS ERRORS (", "):\n"), block(F.col("w"), "WARNINGS (", "):\n"))
    return split.select(key, F.size("e").alias("errors"), F.size("w").alias("warnings"), text.alias("report"))


# ---- output and run audits ---------------------------------------------------------------------

# Warnings on output that holds nothing new.
NO_OUTPUT = "Output is empty"
NO_NEW_FIELDS = (
    "Output has no new fields compared to input — VRL may not have parsed the message. "
    "The .message field might still be raw/unparsed."
)
ONLY_MESSAGE = "Output only has 'message' field — VRL did not extract structured fields from the log."
EMPTY_RUN = "VRL produced empty output — the program may have aborted or the input didn't match."


def with_quality(rows: DataFrame, given: Column, output: Column) -> DataFrame:
    """Adds ``warning``: compares the key sets of input and output JSON.

    Null when all is well or the two are not comparable. Texts are parsed once, in columns of their
    own.
    """
    plain = F.regexp_replace(
        F.regexp_replace(output, r"t'[^']*'", '"__timestamp__"'), r"r'[^']*'", '"__regex__"')
    none = F.array().cast("array<string>")
    before, after, old, new = (F.col(n) for n in ("__before", "__after", "__old", "__new"))
    parsed = rows.withColumns({"__before": F.try_parse_json(given), "__after": F.try_parse_json(plain)}).withColumns({
        "__old": F.coalesce(F.map_keys(js.fields(before)), none),
        "__new": F.coalesce(F.map_keys(js.fields(after)), none)})
    message = F.try_variant_get(after, "$.message", "string")
    # An empty text, zero or false counts as no message.
    has_message = message.isNotNull() & ~message.isin("", "0", "false")
    nothing_new = (F.size(F.array_except(new, old)) == 0) & (F.size(new) <= F.size(old))
    warning = (
        F.when(F.coalesce(output, F.lit("")) == "", NO_OUTPUT)
        .when(before.isNull() | after.isNull(), None)
        .when(nothing_new, NO_NEW_FIELDS)
        .when(has_message & (F.size(new) <= 2), ONLY_MESSAGE))
    return parsed.withColumn("warning", warning).drop("__before", "__after", "__old", "__new")


def output_quality(runs: DataFrame, given: str = "input", output: str = "stdout") -> DataFrame:
    return with_quality(runs, F.col(given), F.col(output))


# Terminal sequences, the tool's own log lines, what marks an error in its output, texts of outcomes.
ANSI_SEQUENCES = [r"\x1b\[[0-9;]*[a-zA-Z]", r"\x1b\][^\x07]*\x07", r"\x1b[^\[\]()][^\x1b]*"]
TOOL_LOG_LINE = r"^\d{4}-\d{2}-\d{2}T\S+\s+(INFO|WARN|DEBUG)\s"
ERROR_PHRASES = ["function call error", "runtime error", "error[E"]
ERROR_LINE = r"(?m)^error\b"
NO_TOOL, NO_BINARY, STOPPED, UNKNOWN = "ENOENT", "Vector binary not found at: ", "SIGTERM", "Unknown error"
EXIT_CODES = {"not_found": -1, "timeout": -2}


def strip_ansi(text: Column) -> Column:
    """Removes terminal escape sequences."""
    for pattern in ANSI_SEQUENCES:
        text = F.regexp_replace(text, pattern, "")
    return text


def wrap_input(sample: Column) -> Column:
    """A JSON object as it is (white space between tokens dropped), anything else as a message."""
    is_object = js.fields(F.try_parse_json(sample)).isNotNull()
    return F.when(is_object, js.compact_text(sample)).otherwise(
        F.to_json(F.struct(sample.alias("message")), {"ignoreNullFields": "false"}))


def input_wrap(rows: DataFrame, col: str = "input") -> DataFrame:
    return rows.withColumn("event", wrap_input(F.col(col)))


def run_triage(runs: DataFrame, tool: str = "vector", timeout_ms: int = 15000) -> DataFrame:
    """Adds outcome, output, warning, error and exit to tool runs.

    Outcomes: ok, runtime_error, empty, not_found, timeout, failed. Exit code 0 means the tool came
    back normally; its own log lines in stderr do not count as errors. A run that was killed or ended by the
    signal to terminate has timed out. ``signal`` and ``message`` (of the error itself, used where the tool wrote nothing) are
    read where ``runs`` has them. ``exit`` is the exit code, -1 without a tool, -2 after a timeout, 1 if unknown.
    """
    def given(name: str) -> Column:
        return F.col(name) if name in runs.columns else F.lit(None).cast("string")

    cleaned = runs.withColumns({
        "__out": tx.strip(strip_ansi(F.col("stdout"))), "__err": tx.strip(strip_ansi(F.col("stderr"))),
        "__signal": given("signal"), "__message": strip_ansi(given("message"))})
    kept = F.filter(F.split("__err", "\n", -1), lambda line: ~line.rlike(TOOL_LOG_LINE))
    cleaned = cleaned.withColumn("__real", F.coalesce(tx.strip(F.array_join(kept, "\n")), F.lit("")))
    real, out, err = F.col("__real"), F.coalesce("__out", F.lit("")), F.col("__err")
    killed = F.coalesce("killed", F.lit(False)) | F.coalesce(F.col("__signal") == STOPPED, F.lit(False))
    normal = F.coalesce(F.col("exit_code") == 0, F.lit(False)) & F.col("error_code").isNull() & ~killed & F.col("__signal").isNull()
    broken = real.rlike(ERROR_LINE)
    for phrase in ERROR_PHRASES:
        broken = broken | real.contains(phrase)
    outcome = (
        F.when(normal & broken, "runtime_error").when(normal & (out == ""), "empty").when(normal, "ok")
        .when(F.col("error_code") == NO_TOOL, "not_found").when(killed, "timeout").otherwise("failed"))
    judged = cleaned.withColumn("outcome", outcome)
    kind = F.col("outcome")
    is_ok = kind == "ok"
    error = (
        F.when(kind == "runtime_error", F.concat(F.lit("Runtime error: "), real))
        .when(kind == "empty", EMPTY_RUN)
        .when(kind == "not_found", f"{NO_BINARY}{tool}")
        .when(kind == "timeout", f"Vector timed out after {timeout_ms}ms")
        .when(kind == "failed", F.coalesce(
            tx.blank_to_null(err), tx.blank_to_null(out), tx.blank_to_null(F.col("__message")), F.lit(UNKNOWN))))
    exit_code = F.when(kind.isin("ok", "empty", "runtime_error"), 0)
    for name, code in EXIT_CODES.items():
        exit_code = exit_code.when(kind == name, code)
    # Only runs that went well are compared with their input.
    compared = with_quality(judged, F.when(is_ok, wrap_input(F.col("input"))), F.when(is_ok, out))
    return compared.select(
        *runs.columns, "outcome", F.when(is_ok, out).alias("output"), F.when(is_ok, F.col("warning")).alias("warning"),
        error.alias("error"), exit_code.otherwise(F.coalesce("exit_code", F.lit(1))).cast("int").alias("exit"))
