"""Personal data: patterns propose spans, checksums and number rules confirm them, context scores them.

Words around a span raise or lower its score, and a span below its kind's least score is dropped. Weak kinds (bare
account numbers, dates of birth, random-looking values) lie below it unless their context speaks for them; the
four base kinds always stay.

Offsets are code points, ends exclusive. A kind's matches are the leftmost non-overlapping ones. Spark
gives a pattern's matches and the pieces between them; a running sum of their lengths gives the positions.
Every pattern is anchored at the start of its run of characters and consumes possessively, so that a
long run is read once; the matches are those of the plain pattern. Texts that lack a character a kind
cannot do without are not searched for it. Everything is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,rank:int,start:int,end:int,score:double>"
CONTEXT = 40  # code points looked at on either side
LOSS = 0.3


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _ip_ok(text: Column) -> Column:
    """Every part is at most 255, however many zeros lead it."""
    return F.forall(F.split(text, r"\."), lambda part: F.regexp_replace(part, "^0+(?=.)", "").rlike(
        "^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda acc, v: acc + v) % 10 == 0


def _card_ok(text: Column) -> Column:
    digits = _digits(text)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def _iban_ok(text: Column) -> Column:
    """15 to 34 letters and digits whose rearranged number is 1 modulo 97."""
    compact = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(compact, 5, 64), F.substring(compact, 1, 4))
    # a letter stands for two digits, A = 10 to Z = 35
    value = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.when(
        c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97).cast("int"))
    return F.when(F.length(compact).between(15, 34), value == 1).otherwise(False)


def _mixed_ok(text: Column) -> Column:
    """At least four letters and four digits: neither a word nor a number."""
    return (F.length(F.regexp_replace(text, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) >= 4)


def _date_ok(text: Column) -> Column:
    """A day of the calendar, year first or last."""
    parts = F.split(text, "[-./]")
    year_first = F.length(parts[0]) == 4
    year, month, day = F.when(year_first, parts[0]).otherwise(parts[2]), parts[1], F.when(year_first, parts[2]).otherwise(parts[0])
    return year.cast("int").between(1900, 2099) & F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-M-d").isNotNull()


def _national_ok(text: Column) -> Column:
    """Three groups of digits in the allotted ranges."""
    area, group, serial = (F.substring(text, *at) for at in ((1, 3), (5, 2), (8, 4)))
    return ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000")


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``confirm`` decides, ``needs`` is a pattern of what any match holds."""

    name: str
    pattern: str
    needs: str
    confirm: Callable[[Column], Column]
    base: float  # score of a confirmed span without context
    words: str  # context that raises the score
    least: float = 0.0  # spans that score less are dropped
    gain: float = 0.2  # what such context adds
    denied: str = ""  # context that takes ``LOSS`` away


# The patterns of the first four kinds and their number rules.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda t: F.lit(True), 0.9, "e-?mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
         _ip_ok, 0.7, "address|host|server|login|adresse|direcci"),
    Kind("card", r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+", r"[0-9][ -]?[0-9]",
         _card_ok, 0.8, "card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]",
         lambda t: F.length(_digits(t)).between(10, 15), 0.7, "phone|tel|call|mobile|anruf|llam"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         "[A-Z]{2}[0-9]{2}", _iban_ok, 0.9, "iban|account|konto|cuenta|compte"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]",
         _national_ok, 0.5, "ssn|social security|tax|id", 0.4, denied="order|invoice|part|version|isbn|article"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}"
         r"|[rs]k_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+)(?![A-Za-z0-9])",
         "(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|k_live_|AIza|eyJ)", lambda t: F.lit(True), 0.9, "key|secret|token|aws"),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?s:.*?)-----END [A-Z ]{0,20}PRIVATE KEY-----",
         "-----BEGIN ", lambda t: F.lit(True), 0.9, "key|rsa"),
    Kind("url_password", r"(?<![A-Za-z0-9])[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s/@]{1,64}@", "://",
         lambda t: F.lit(True), 0.8, "login|user|database|server"),
    # the weak ones: what only its context makes personal
    Kind("secret_value", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+=*+", "[A-Za-z0-9+/_-]{20}",
         _mixed_ok, 0.3, "token|secret|key|passw|bearer|credential|schl.ssel|clave|jeton", 0.5, 0.4, "checksum|digest|commit|sha-?[0-9]"),
    Kind("account", r"(?<![0-9A-Za-z+.-])[0-9]{8,12}(?![0-9A-Za-z.-])", "[0-9]{8}",
         lambda t: F.lit(True), 0.2, "account|acct|konto|cuenta|compte|routing", 0.5, 0.4, "order|invoice|page|part"),
    Kind("birth_date", r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![0-9./-])", "[0-9][./-][0-9]",
         _date_ok, 0.2, "born|birth|dob|geboren|geburt|nacid|nacim|n.e? le|naissance", 0.5, 0.4, "published|updated|release"),
]
BASE_KINDS = ("email", "ip", "card", "phone")


def _spans(text: Column, kind: Kind, rank: int) -> Column:
    """Confirmed spans of one kind, in order, as an array of ``SPAN``."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern)
    pairs = F.arrays_zip(found.alias("match"), between.alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        return F.when(pair["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(
            acc["out"], F.array(F.struct(pair["match"].alias("match"), begin.alias("start"), end.alias("end")))).alias("out")))

    placed = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    good = F.filter(placed, lambda m: kind.confirm(m["match"]))

    def scored(m: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.substring(text, F.greatest(m["start"] - CONTEXT + 1, F.lit(1)), F.least(
            m["start"], F.lit(CONTEXT))), F.substring(text, m["end"] + 1, F.lit(CONTEXT))))
        score = F.lit(kind.base) + F.when(near.rlike(rf"\b(?:{kind.words})"), kind.gain).otherwise(0.0)
        if kind.denied:
            score = score - F.when(near.rlike(rf"\b(?:{kind.denied})"), LOSS).otherwise(0.0)
        score = F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2)
        return F.struct(F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), m["start"].alias("start"),
                        m["end"].alias("end"), score.cast("double").alias("score"))

    kept = F.filter(F.transform(good, scored), lambda s: s["score"] >= kind.least)
    return F.when(text.rlike(kind.needs), kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame) -> DataFrame:
    """Adds ``pii``: all confirmed spans of ``text``, by start, then kind in the order of ``KINDS``.

    A span is ``kind, rank, start, end, score``. A null text is empty and has none. The column replaces one
    of the same name; others, ids and repeated rows pass as they are. No rows: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    spans = F.flatten(F.array(*[_spans(text, kind, i) for i, kind in enumerate(KINDS)]))
    ordered = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(
        x["rank"] - y["rank"]))
    return docs.withColumn("pii", ordered)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by its first kind in angle brackets."""
    text = F.coalesce(text, F.lit(""))
    start = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        fresh = F.concat(acc["out"], F.substring(text, acc["upto"] + 1, s["start"] - acc["upto"]), tag)
        return F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"),
                        F.when(s["start"] >= acc["upto"], fresh).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["upto"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
