"""Column expressions over text: line skeletons, signatures, cleaning and screening.

Functions take string columns and return columns, so they work in batch and streaming plans alike. Patterns carry ``(?U)`` so that ``\\w \\d \\s \\b`` follow Unicode whatever the JDK.
Shapes of ASCII text are matched without it, which gives the same and is cheaper, and a pattern is tried only where the text
holds the characters or words that a match needs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ordered shape rules. Order matters and has visible effects: a bare
# 10:30:00 turns into <IP6> and a dotted version 1.2.3.4 into <IP>.
SHAPE_RULES: list[tuple[str, str]] = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\d{1,2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s*[+-]?\d{4}", "<TS>"),
    (r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "<TS>"),
    (r"\b\d{10,13}\b", "<EPOCH>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<IP>"),
    (r"([0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}", "<IP6>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<HEX>"),
    (r"\b\d+\b", "<N>"),
    (r'"[^"]*"', '"<STR>"'),
    (r"'[^']*'", "'<STR>'"),
]

# Characters without which a shape rule cannot match, rule by rule.
SHAPE_NEEDS = ["-:", "/:", ":", "", "-", ".", ":", "", "", '"', "'"]

# The ordered screening rules and the description each one reports.
SCREEN_RULES: list[tuple[str, str]] = [
    (r"ignore\s+(all\s+)?(previous|above|prior)\s+(instructions|prompts)", "ignore previous instructions"),
    (r"you\s+are\s+now\s+a", "role reassignment"),
    (r"new\s+instructions?\s*:", "new instructions block"),
    (r"system\s*:\s*", "system prompt injection"),
    (r"forget\s+(everything|your\s+(instructions|role|prompt))", "memory wipe"),
    (r"disregard\s+(all|any|the)\s+(rules|instructions|guidelines)", "disregard rules"),
    (r"override\s+(system|prompt|instructions)", "override attempt"),
    (r"pretend\s+(you\s+are|to\s+be)", "persona hijack"),
    (r"act\s+as\s+(if|though)\s+you", "persona hijack"),
    (r"do\s+not\s+follow\s+(your|the)\s+(rules|instructions)", "rule bypass"),
    (r"\bDAN\b.*\bmode\b", "DAN jailbreak"),
    (r"(sudo|admin)\s+mode", "privilege escalation"),
    (r"reveal\s+(your|the)\s+(system|initial)\s+prompt", "prompt exfiltration"),
]
# A word without which a screening rule cannot match ASCII text, in lower case, rule by rule.
SCREEN_NEEDS = [
    "ignore", "you", "new", "system", "forget", "disregard", "override", "pretend", "act", "follow", "dan", "mode", "reveal",
]
# Fixed value: in the "ts" dialect the fourth rule wants the word "prompt" too.
SYSTEM_RULE_TS = r"system\s+prompt\s*:"

# Openings of an off-task reply.
OFF_TASK_OPENINGS = [
    "as an ai", "as a language model", "i cannot", "i can't",
    "i'm sorry", "sure! here", "certainly!", "of course!",
    "i'd be happy to", "absolutely!",
]

# Characters stripped from both ends: every Unicode white-space character.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# What cleaning removes, and the fences of a reply's code block.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
BLANK_LINES = r"\n{3,}"
OPENING_FENCE = r"\A```(?:vrl|rust|toml)?\n?"
CLOSING_FENCE = r"\n?```\z"
FENCED = r"(?s)```(?:vrl|rust|toml)?\n(.*?)\n?```"


def strip(text: Column) -> Column:
    """Strip white space of any kind; linear however long the runs are."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def skeleton(text: Column) -> Column:
    """The line with every variable token replaced by a placeholder."""
    def replaced(flags: str) -> Column:
        named = F.array(text)  # an array of one names the text between two rules
        for (pattern, token), needs in zip(SHAPE_RULES, SHAPE_NEEDS, strict=True):
            named = F.transform(named, _rule(flags + pattern, token, needs))
        return named[0]

    return F.when(is_ascii(text), replaced("")).otherwise(replaced("(?U)"))


def _rule(pattern: str, token: str, needs: str) -> Callable[[Column], Column]:
    def apply(text: Column) -> Column:
        done = F.regexp_replace(text, pattern, token)
        return F.when(reduce(and_, [text.contains(x) for x in needs]), done).otherwise(text) if needs else done

    return apply


def signature_of_skeleton(shape: Column) -> Column:
    return F.substring(F.sha2(shape, 256), 1, 16)


def signature(text: Column) -> Column:
    """First 16 hex digits of SHA-256 over the UTF-8 skeleton."""
    return signature_of_skeleton(skeleton(text))


def sanitize(text: Column) -> Column:
    """Drop control characters but tab and line ends, fold 3+ newlines to 2, strip."""
    return strip(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), BLANK_LINES, "\n\n"))


def screen(text: Column, dialect: str = "py") -> Column:
    """Description of the first screening rule that hits, else null."""
    if dialect not in ("py", "ts"):
        raise ValueError(f"unknown dialect {dialect!r}")
    rules = list(SCREEN_RULES)
    if dialect == "ts":
        rules[3] = (SYSTEM_RULE_TS, rules[3][1])
    # (?d): only a newline ends a line for "."; (?U) also folds case beyond ASCII.
    def first_hit(named: Column) -> Column:
        whole, lower, ascii = named["whole"], named["lower"], named["ascii"]
        return F.coalesce(*[
            F.when((~ascii | lower.contains(word)) & whole.rlike("(?iUd)" + pattern), F.lit(label))
            for (pattern, label), word in zip(rules, SCREEN_NEEDS, strict=True)])

    # an array of one names values that are used more than once
    named = F.array(F.struct(text.alias("whole"), F.lower(text).alias("lower"), is_ascii(text).alias("ascii")))
    return F.transform(named, first_hit)[0]


def strip_fences(text: Column) -> Column:
    """Remove one code fence at the very start and one at the very end."""
    return F.regexp_replace(F.regexp_replace(strip(text), OPENING_FENCE, ""), CLOSING_FENCE, "")


def extract_fenced(text: Column) -> Column:
    """Content of the first fenced block anywhere; without one, as ``strip_fences``."""
    text = strip(text)
    return F.when(text.rlike(FENCED), F.regexp_extract(text, FENCED, 1)).otherwise(strip_fences(text))


def off_task(reply: Column) -> Column:
    """Whether a cleaned reply opens with one of the off-task phrases."""
    lowered = F.lower(reply)
    flag = F.lit(False)
    for opening in OFF_TASK_OPENINGS:
        flag = flag | lowered.startswith(opening)
    return flag


def with_captures(rows: DataFrame, name: str, text: Column, pattern: str, groups: int) -> DataFrame:
    """Adds all capture groups of a whole-text match as one array; null when there is no match.

    The text is matched once: the groups are written out between separators and split again, in a
    column of their own, so that taking the array apart does not repeat the match. A text that
    itself holds the separator (a control character) is read group by group instead. Groups that
    took no part in the match come back empty.
    """
    whole = rf"\A(?:{pattern})\z"
    mark = "\x1f"
    joined = mark.join(f"${i}" for i in range(1, groups + 1)) + mark
    fast = F.split(F.regexp_replace(text, whole, joined), mark)
    slow = F.array(*[F.regexp_extract(text, whole, i) for i in range(1, groups + 1)], F.lit(""))
    parts = F.when(text.contains(mark), F.when(text.rlike(whole), slow)).otherwise(fast)
    return rows.withColumn(name, parts).withColumn(name, F.when(F.size(name) == groups + 1, F.col(name)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
