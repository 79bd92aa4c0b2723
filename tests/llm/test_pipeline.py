"""The corpus pipeline stage by stage against plain versions, each over what the stage before it kept."""

import collections
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lineforge.llm import bpe, pii
from lineforge.llm import toxicity as toxic
from lineforge.llm.tables import DOCUMENT_COLUMNS, table
from lineforge.session import materialize

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the result of every stage, by name."""
    docs, out = table(spark, FOLDER, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = materialize(stage(spark, docs, FOLDER), f"test-{name}")
        out[name] = (docs, result)
        docs = result
    return out


def rows(df):
    return sorted(map(repr, df.collect()))


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_dedup", "decontamination", "personal_data", "byte_pairs"]


def test_columns(stages):
    for name, (_, after) in stages.items():
        assert name == "byte_pairs" or after.columns == DOCUMENT_COLUMNS


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    scored = toxic.toxicity(before, table(spark, FOLDER, "labels")).collect()
    assert ids(after) == sorted(r["doc_id"] for r in scored if r["score"] < 0.7) and len(ids(after)) > 0
    kept = before.join(after.select("doc_id"), "doc_id", "left_semi").select(*DOCUMENT_COLUMNS)
    assert rows(kept) == rows(after)


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in before.collect()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    assert ids(after) == sorted(i for i in sets if root(i) == i)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    windows = collections.defaultdict(set)
    for r in table(spark, FOLDER, "benchmark").collect():
        words = item_words(r["text"])
        for i in range(max(0, len(words) - 13) + 1 if words else 0):
            windows[len(words[i:i + 13])].add(tuple(words[i:i + 13]))
    clean = []
    for r in before.collect():
        words, hit = item_words(r["text"]), set()
        for size, found in windows.items():
            for i in range(len(words) - size + 1):
                if tuple(words[i:i + size]) in found:
                    hit |= set(range(i, i + size))
        if not (hit and 20 * len(hit) >= len(words)):
            clean.append(r["doc_id"])
    assert ids(after) == sorted(clean) and len(clean) < before.count()


def test_personal_data(stages):
    before, after = stages["personal_data"]
    spans = {r["doc_id"]: (r["text"], [(s["start"], s["end"], s["kind"]) for s in r["pii"]], r["n_chars"])
             for r in pii.find_pii(before).collect()}
    changed = 0
    for r in after.collect():
        text, found, n_chars = spans.pop(r["doc_id"])
        out, upto = "", 0
        for start, end, kind in found:
            if start >= upto:
                out += text[upto:start] + f"<{kind.upper()}>"
            upto = max(upto, end)
        out += (text or "")[upto:]
        changed += bool(found)
        assert r["text"] == (out if text is not None else None) and r["n_chars"] == (len(out) if found else n_chars)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r["text"] or "")
    assert not spans and changed


def test_byte_pairs(stages):
    before, after = stages["byte_pairs"]
    ranks = bpe.Vocabulary(open(public_tokenizers.path(corpus_pipeline.RANK_FILE), "rb").read()).ranks
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in before.collect()}
    for r in after.collect():
        encoded = plain.encode_ordinary(texts.pop(r["doc_id"]))
        assert r["n_tokens"] == len(encoded)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, encoded)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(plain.decode_bytes(encoded)).hexdigest()
    assert not texts


def test_run_is_the_chain(spark, stages):
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(stages["byte_pairs"][1])


ODD = [(1, None), (2, ""), (3, " \n"), (4, "same words here and there again"), (4, "same words here and there again"),
       (4, "another text under one id, quite different"), (5, "same words here and there again"), (None, "no id"), (None, None),
       (7, "x" * 60_000)]


def test_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, very long texts, and columns that stages use names of."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.createDataFrame(
        [(i, t, "en", "s", None, "c", "p", 1) for i, t in ODD],
        "doc_id long, text string, lang string, source string, n_chars long, clean string, pii string, __hash long")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "odd")
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in docs.collect()) == [
        (0, False), (0, True), (1, False), (2, False), (3, True), (4, True), (4, True), (7, True)]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.collect() == [] and empty.columns == docs.columns
