"""SETM collocations against a plain version, both ways of the semi-join, and odd rows."""

import collections
import re

import pytest

from lineforge.llm import collocations
from lineforge.llm.collocations import Settings

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, doc_id long, code string, word string, a string, unit string"
ODD = [(None, "en"), ("", "en"), (" \t ", None), ("a a a a a a", "en"), ("A b,a b. a\tb c", None), ("a b c d " * 5000, "xx"),
       ("a b c d " * 3, "und"), ("x" * 60_000, "xx"), ("é🙂 é🙂 é🙂!é🙂", "en"), ("a b\u00a0c a b\u00a0c", "en"), ("same line\nsame line", "en")]


def plain(rows, settings):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, settings.longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i:i + size])] += 1
    out = []
    for lang, counts in f.items():
        n = sum(c for run, c in counts.items() if len(run) == 1)
        found = {run: a for run, a in counts.items() if len(run) > 1 and a >= settings.least}
        covered = collections.Counter()
        for run, a in found.items():
            for size in range(2, len(run)):
                for i in range(len(run) - size + 1):
                    covered[run[i:i + size]] = max(covered[run[i:i + size]], a)
        report = []
        for run, a in found.items():
            if run in covered and 100 * covered[run] >= settings.covered_percent * a:
                continue
            score, k = min((1_000_000 * a * a // (counts[run[:k]] * counts[run[k:]]), k) for k in range(1, len(run)))
            report.append((-score, -a, " ".join(run).encode(), counts[run[:k]], counts[run[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(report)[:settings.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize("settings", [
    Settings(least=2), Settings(least=2, longest=5, unit_bytes=1), Settings(least=1, longest=2, broadcast_bytes=0),
    Settings(least=2, longest=4, covered_percent=100, broadcast_bytes=0, unit_bytes=20_000), Settings(least=3, top=2)])
def test_odd_rows(spark, settings):
    docs = spark.createDataFrame([(t, lang, 1, "c", "w", "a", "u") for t, lang in ODD * 2], SCHEMA)
    found = collocations.collocations(docs, settings)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(ODD * 2, settings)


@pytest.mark.parametrize("broadcast_bytes", [0, 16 << 20])
def test_whole_table(spark, broadcast_bytes):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    settings = Settings(least=5, longest=4, broadcast_bytes=broadcast_bytes, unit_bytes=50_000)
    found = collocations.collocations(table, settings).collect()
    assert sorted(map(tuple, found)) == plain([tuple(r) for r in table.select("text", "lang").collect()], settings)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, "en"), ("a b", "en")], "text string, lang string")).collect() == []
