"""URL rules: splitting, mining and matching against plain versions."""

import collections
import itertools
import math

import pytest
from pyspark.sql import functions as F

from lineforge.llm import url_rules

URLS = [
    "http://WWW.Example.com/en/1?x=1#top", "https://a.b.example.net/es/2.html", "https://example.com/en/", "http://example.com",
    "net/es/3", "", None, "http://", "http:///es/", "ftp://user@net:8/fr/x", "http://net/fr/", "http://xnet/fr/", "http://h.net/fr",
    "x://y://z/a", "http://a.com?b://c/d", "http://a.com#b", "line\nbreak://a.net/es/\n?k\n=1", "http://a.org/" + "p/" * 30_000,
    "http://a..com./x", "://a.com/b", "http://A.É.com/É.Html",
]


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    lower = "".join(c.lower() if c.isascii() else c for c in host)
    return lower, rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def plain_rule(host, path):
    fits = [r for r in url_rules.GIVEN if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)


def plain_mine(labelled, settings):
    least = math.ceil(settings.support * len(labelled))
    having, joint = collections.Counter(), collections.Counter()
    for tokens, verdict in labelled:
        for size in range(1, len(tokens) + 1):
            for some in itertools.combinations(tokens, size):
                having[some] += 1
                joint[some, verdict] += 1
    strong = {k: n / having[k[0]] for k, n in joint.items() if n >= least and n / having[k[0]] >= settings.confidence}
    return {k: (joint[k], having[k[0]], c) for k, c in strong.items() if not any(
        v == k[1] and set(t) < set(k[0]) and other >= c for (t, v), other in strong.items())}


@pytest.fixture(scope="module")
def labelled(spark):
    kinds = [("a=1", "b=1"), ("a=1", "b=2"), ("a=2", "b=1", "c"), ("a=2", "c"), ("c",)]
    rows = [(list(kinds[i % 5]), "block" if i % 5 in (0, 2) or i % 35 == 1 else "allow") for i in range(200)]
    return rows, spark.createDataFrame(rows + [([], "block"), (["z"], None), (None, "allow")], "tokens array<string>, verdict string")


@pytest.mark.parametrize("support, confidence", [(0.01, 0.9), (0.05, 0.5), (0.5, 0.1), (0.01, 1.0)])
def test_rules_equal_all_subsets(labelled, support, confidence):
    rows, table = labelled
    settings = url_rules.Settings(support=support, confidence=confidence)
    found = {(tuple(r["tokens"]), r["verdict"]): (r["joint"], r["having"], r["confidence"])
             for r in url_rules.mine(table, settings).collect()}
    assert found == plain_mine([(tuple(t), v) for t, v in rows], settings)


def test_index_finds_the_best_rule(spark, labelled):
    rules = url_rules.mine(labelled[1], url_rules.Settings(confidence=0.5))
    plain = [(r["confidence"], r["joint"], len(r["tokens"]), set(r["tokens"]), r["verdict"], " ".join(r["tokens"])) for r in rules.collect()]
    sets = [list(s) for n in range(1, 5) for s in itertools.combinations(["a=1", "b=1", "b=2", "c", "q"], n)]
    found = {tuple(r["tokens"]): r for r in url_rules.match(spark.createDataFrame([(s,) for s in sets] * 2, "tokens array<string>"), rules).collect()}
    for tokens in sets:
        fits = [p for p in plain if p[3] <= set(tokens)]
        if not fits:
            assert tuple(tokens) not in found
            continue
        best = min(fits, key=lambda p: (-p[0], -p[1], -p[2], f"{p[5]} => {p[4]}"))
        assert (found[tuple(tokens)]["mined_rule"], found[tuple(tokens)]["confidence"]) == (f"{best[5]} => {best[4]}", best[0])


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "t", "h", "r") for i, u in enumerate(URLS)] * 2 + [(None, URLS[0], "t", "h", "r")],
                                  "page_id long, url string, tokens string, host string, rule string")
    rows = url_rules.judge(pages).collect()
    assert sorted(r["page_id"] for r in rows if r["page_id"] is not None) == sorted([*range(len(URLS))] * 2)
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        url = URLS[r["page_id"] or 0]
        assert (r["host"], r["path"]) == plain_split(url)
        given = plain_rule(r["host"], r["path"])
        assert r["rule"] == (given.host + given.path if given else None)
        assert r["verdict"] == (given.verdict if given else r["method_verdict"])
        assert url is not None or r["verdict"] == "allow"


def test_tokens_are_one_of_a_kind(spark):
    table = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    sets = [r["t"] for r in table.select(url_rules.tokens_of(F.col("url"), host, path).alias("t")).collect()]
    assert all(t == sorted(set(t)) and len(t) <= 9 and len({x.split("=")[0] for x in t}) == len(t) for t in sets)
    assert sets[0] == ["dir=en", "fragment", "key=x", "name=www", "scheme=http", "site=example.com", "tld=com"]
    assert sets[4:7] == [["bare"], ["bare"], []]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(empty).collect() == []
