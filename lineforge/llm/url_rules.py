"""URL filtering by association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens, at most one of each kind: scheme, top-level domain, site (the last two labels), name (the
label before), sub-domain (the first label of four or more), first directory, ending of the path, first query key and
fragment. So a set has at most nine tokens and a frequent set at most 512 subsets, however long the URL. Frequent sets
that hold a label become rules ``tokens => verdict``. A rule is pruned by support, by confidence, and if a rule on fewer of
its tokens is as confident. The rules are matched through an inverted index from token to rule: distinct token sets
are looked up token by token, and a rule fits where all its tokens were found.

Everything is DataFrame functions and Spark's own FP-growth.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineforge.llm.decontam import LOWER, UPPER
from lineforge.session import materialize

PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
LABEL = "label="


@dataclass(frozen=True)
class Rule:
    """A given rule: ``verdict`` for the host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


# The given rules.
GIVEN = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Settings:
    support: float = 0.01  # share of the labelled URLs that have a rule's tokens and its verdict
    confidence: float = 0.9  # share of the labelled URLs with its tokens that have its verdict
    default: str = "allow"  # where no rule fits


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def given_rule(host: Column, path: Column, rules: Sequence[Rule] = GIVEN) -> Column:
    """The longest given rule (by host, then path) that fits, as a struct; null if none does."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(
            F.lit(len(r.host)).alias("host_size"), F.lit(len(r.path)).alias("path_size"),
            F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules]
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The sorted token set of a URL; without ``://`` it is the token ``bare`` alone, and a null URL has none."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    part = lambda kind, value: F.concat(F.lit(kind + "="), value)
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^?#]*(.*)", 1)
    folder = F.regexp_extract(path, r"(?s)\A/([^/]+)/", 1)
    ending = F.regexp_extract(path, r"(?s)(/|\.[A-Za-z0-9]+)\z", 1)
    key = F.regexp_extract(rest, r"(?s)\A\?([^=&#]+)", 1)
    found = F.array(
        part("scheme", F.translate(F.regexp_extract(url, r"(?s)\A(.*?)://", 1), UPPER, LOWER)),
        F.when(host != "", part("tld", F.element_at(labels, -1))),
        F.when(count >= 2, part("site", F.array_join(F.slice(labels, -2, 2), "."))),
        F.when(count >= 3, part("name", F.try_element_at(labels, F.lit(-3)))),
        F.when(count >= 4, part("sub", F.get(labels, F.lit(0)))),
        F.when(folder != "", part("dir", folder)),
        F.when(ending != "", part("end", ending)),
        F.when(key != "", part("key", key)),
        F.when(rest.contains("#"), F.lit("fragment")))
    return F.when(url.isNull(), F.array().cast("array<string>")).when(
        F.instr(url, "://") == 0, F.array(F.lit("bare"))).otherwise(F.array_sort(F.array_compact(found)))


def _subsets(items: Column) -> Column:
    """All non-empty proper subsets of a small sorted array."""
    size = F.size(items)
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), size) - 2)
    pick = lambda mask: F.filter(items, lambda x, i: F.getbit(mask, i) == 1)
    return F.when(size > 1, F.transform(masks, pick)).otherwise(F.array().cast("array<array<string>>"))


def mine(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rules from ``labelled(tokens, verdict)``: ``tokens``, ``verdict``, ``joint``, ``having``, ``confidence``.

    ``having`` counts the labelled rows with all the tokens, ``joint`` those of them with the verdict. Rows with null or
    empty token sets or without verdict teach nothing; repeated rows count as often as they occur. No rows: no rules.
    """
    rows = labelled.where("size(tokens) > 0 and verdict is not null").select(
        F.concat("tokens", F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items"))
    schema = "tokens array<string>, verdict string, joint long, having long, confidence double"
    if rows.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=settings.support, minConfidence=1.0).fit(rows)
    is_label = lambda x: x.startswith(LABEL)
    sets = materialize(model.freqItemsets.select(
        F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("tokens"),
        F.substring(F.get(F.filter("items", is_label), F.lit(0)), len(LABEL) + 1, 1 << 30).alias("verdict"), "freq"), "url-sets")
    plain = sets.where("verdict is null").select("tokens", F.col("freq").alias("having"))
    rules = sets.where("verdict is not null and size(tokens) > 0").select("tokens", "verdict", F.col("freq").alias("joint"))
    rules = rules.join(plain, "tokens").withColumn("confidence", F.col("joint") / F.col("having"))
    rules = materialize(rules.where(F.col("confidence") >= settings.confidence), "url-rules")
    smaller = rules.select("tokens", "verdict", F.col("confidence").alias("__own"), F.explode(_subsets(F.col("tokens"))).alias("__less"))
    general = rules.select(F.col("tokens").alias("__less"), "verdict", F.col("confidence").alias("__general"))
    redundant = smaller.join(general, ["__less", "verdict"]).where("__general >= __own").select("tokens", "verdict").distinct()
    return rules.join(redundant, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "joint", "having", "confidence")


def rule_text(tokens: Column, verdict: Column) -> Column:
    return F.concat(F.array_join(tokens, " "), F.lit(" => "), verdict)


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct ``tokens`` that a rule fits: the most confident rule, by the inverted index.

    Columns ``tokens``, ``mined_rule``, ``mined_verdict``, ``confidence``. Of equally confident rules the one of more
    support, of more tokens, and of the smaller text is taken.
    """
    index = rules.select(F.size("tokens").alias("size"), F.explode("tokens").alias("token"), "confidence", "joint", "verdict",
                         rule_text(F.col("tokens"), F.col("verdict")).alias("rule"))
    looked_up = token_sets.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fitting = looked_up.groupBy("tokens", "rule", "size", "confidence", "joint", "verdict").agg(
        F.count("*").alias("found")).where("found = size")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("joint")).alias("j"), (-F.col("size")).alias("s"), "rule", "verdict"))
    return fitting.groupBy("tokens").agg(best.alias("best")).select(
        "tokens", F.col("best.rule").alias("mined_rule"), F.col("best.verdict").alias("mined_verdict"), (-F.col("best.c")).alias("confidence"))


def judge(pages: DataFrame, rules: Sequence[Rule] = GIVEN, settings: Settings = Settings()) -> DataFrame:
    """A verdict for every row of ``pages(page_id, url)``: the given rules' where one fits, else the mined rules'.

    The URLs that given rules decide are the labels. Columns: ``page_id``, ``host``, ``path``, ``rule`` (the given one,
    else null), ``verdict``, ``mined_rule``, ``confidence`` (of the mined rule; null if none fits), ``method_verdict`` (what the
    mined rules say, also where a given rule decides). Null and empty URLs and those without ``://`` have an empty host
    and path; null ones get the default. Repeated rows are judged each. Other columns are not read. No pages: no rows.
    """
    url = F.col("url")
    split = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    split = split.withColumn("given", given_rule(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("given_verdict"),
        tokens_of(url, F.col("host"), F.col("path")).alias("tokens"))
    mined = mine(split.select("tokens", F.col("given_verdict").alias("verdict")), settings)
    found = match(split.where("size(tokens) > 0"), mined).withColumnRenamed("tokens", "__tokens")
    method = F.coalesce("mined_verdict", F.lit(settings.default))
    return split.join(found, F.col("tokens") == F.col("__tokens"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given_verdict", method).alias("verdict"), "mined_rule", "confidence",
        method.alias("method_verdict"))
