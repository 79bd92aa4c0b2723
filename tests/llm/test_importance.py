"""Importance resampling against a plain version, and odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lineforge.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i}" for i in range(60))
ODD = [(1, None), (2, ""), (3, " \n"), (4, LONG), (4, LONG), (5, LONG), (None, LONG), (7, "x" * 60_000), (8, "É🙂 The-end 3.5 " * 9)]
SCHEMA = "doc_id long, text string, weight string, score string, rank string, bucket string, n long"


def plain_features(text, shortest, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i:i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), runs


def plain(rows, target, settings):
    def bucket(run):
        return zlib.crc32(run.encode()) % settings.buckets

    texts = [plain_features(t, settings.shortest, settings.longest) for _, t in rows]
    source = collections.Counter(bucket(r) for _, runs in texts for r in runs)
    wanted = collections.Counter(bucket(r) for t in target for r in plain_features(t, settings.shortest, settings.longest)[1])
    s_all, t_all, n = sum(source.values()), sum(wanted.values()), settings.buckets
    out = []
    for (doc_id, _), (words, runs) in zip(rows, texts):
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s_all + n) / ((source[b] + 1) * (t_all + n)))) for b in map(bucket, runs))
        h = int(hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, words, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= settings.least_words), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))
    for rank, x in enumerate(able[:len(able) * settings.percent // 100], 1):
        x.append(rank)
    return sorted(map(str, ([*x, None] if len(x) == 5 else x for x in out)))


@pytest.mark.parametrize("settings", [
    importance.Settings(), importance.Settings(shortest=1, longest=3, buckets=50, percent=40, least_words=1),
    importance.Settings(percent=100, least_words=0), importance.Settings(percent=0)])
def test_odd_rows(spark, settings):
    docs = spark.createDataFrame([(i, t, "w", "s", "r", "b", 1) for i, t in ODD], SCHEMA)
    target = ["Word1 word2 word3", None, "", "the end"]
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), settings)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in found.collect()) == plain(ODD, target, settings)


def test_whole_table_of_word_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    settings = importance.Settings(longest=2, buckets=1000, percent=30)
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    found = importance.resample(table, bench, settings).collect()
    assert sorted(str(list(r)) for r in found) == plain(rows, [r["text"] for r in bench.collect()], settings)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    assert importance.resample(docs, some).collect() == []
    assert [r["doc_id"] for r in importance.resample(some, docs).collect()] == [1]


def test_checksums_by_matrix():
    strings = [b"", b"a", b"abc", bytes(range(128)), b"x" * 5000, "é🙂".encode(), b"abd", b"b"]
    assert importance.crc32_strings(pa.array([s.decode() for s in strings], pa.large_string())).tolist() == [zlib.crc32(s) for s in strings]
    assert importance.crc32_rows(np.zeros((0, 4), dtype=np.uint8)).tolist() == []
