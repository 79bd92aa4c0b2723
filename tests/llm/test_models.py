"""Trained models against scalar forward passes and held-out rows; the order of shards."""

import collections
import math
import time
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lineforge.llm import pitman_yor
from lineforge.llm import hilbert, langid, tokens
from lineforge.llm import toxicity as toxic
from lineforge.llm.tables import table

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["The cat, and the dog 3 times.", "x", "", "der Hund und die Katze " * 9, "é🙂 ou la la"]


def test_softmax_by_hand():
    """The folded table gives the score that adding up every n-gram and a plain softmax give."""
    langs = ["en", "de", "fr", "de", "fr"]
    model = langid.train([t or "y" for t in TEXTS] * 6, langs * 6, langid.Training(epochs=2))
    names, scores, _ = model.predict(TEXTS)
    for text, name, score in zip(TEXTS, names, scores):
        points = [0, *langid.code_points(text).tolist(), 0]
        sums, count = [0.0] * len(model.names), 0
        for n in langid.GRAMS:
            for i in range(len(points) - n + 1):
                gram = points[i:i + n]
                # a mark stands at the ends at most, and one letter is needed
                if not all(gram[1:-1]) or not (gram[0] or gram[-1]):
                    continue
                h = n
                for p in gram:
                    h = (h * tokens.BASE + p) % (1 << 64)
                bucket = int(tokens.mix(np.array([h], dtype=np.uint64))[0]) % langid.BUCKETS
                sums, count = [a + float(b) for a, b in zip(sums, model.table[bucket])], count + 1
        logits = [(a / max(count, 1) + b) / model.temperature for a, b in zip(sums, model.bias)]
        powers = [math.exp(x - max(logits)) for x in logits]
        if any(langid.code_points(text)):
            assert score == pytest.approx(max(powers) / sum(powers), rel=1e-5)
            assert name == model.names[powers.index(max(powers))]
        else:
            assert (name, score) == ("und", 0)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def one_direction(net, steps, side):
    """States of a gated recurrent layer, number by number."""
    h = toxic.HIDDEN
    state, out, weight = [0.0] * h, [], net.p["state"][side]
    for x in steps:
        gate = [float(v) for v in (x @ net.p["input"] + net.p["bias"])[side * 3 * h:(side + 1) * 3 * h]]
        back = [sum(state[i] * float(weight[i, j]) for i in range(h)) for j in range(3 * h)]
        fresh = []
        for j in range(h):
            r, z = sigmoid(gate[j] + back[j]), sigmoid(gate[h + j] + back[h + j])
            n = math.tanh(gate[2 * h + j] + r * back[2 * h + j])
            fresh.append((1 - z) * n + z * state[j])
        state = fresh
        out.append(state)
    return out


def scalar_score(net, text):
    found = tokens.words(*tokens.column_bytes(pa.array([text])))
    which, word_ids, grams, cuts = toxic.word_features(found)
    inputs = net.inputs(word_ids, grams, cuts)
    best = -math.inf
    for start in toxic.window_starts(len(which)).tolist():
        steps = [inputs[w] for w in which[start:start + toxic.WINDOW]]
        ahead, behind = one_direction(net, steps, 0), one_direction(net, steps[::-1], 1)[::-1]
        both = [a + b for a, b in zip(ahead, behind)]
        pull = [sum(x * float(w) for x, w in zip(s, net.p["attend"])) for s in both]
        share = [math.exp(p - max(pull)) for p in pull] if pull else []
        pool = [sum(a * s[j] for a, s in zip(share, both)) / sum(share) for j in range(2 * toxic.HIDDEN)] if both else [0.0] * 2 * toxic.HIDDEN
        best = max(best, sum(x * float(w) for x, w in zip(pool, net.p["out"])) + float(net.p["shift"][0]))
    return sigmoid(net.a * best + net.b)


def test_recurrent_network_by_hand():
    net = toxic.Network.fresh(3)
    net.a, net.b = 1.7, -0.4
    texts = [t for t in TEXTS if t] + ["one two " * 40, ""]
    assert toxic._scores(net, pa.array(texts)).tolist() == pytest.approx([scalar_score(net, t) for t in texts], rel=1e-4)


def test_blocks_of_words_change_nothing(monkeypatch):
    found = tokens.words(*tokens.column_bytes(pa.array(TEXTS)))
    whole = toxic.word_features(found)
    monkeypatch.setattr(toxic, "BLOCK", 2)
    parts = toxic.word_features(found)
    assert all((a == b).all() for a, b in zip(whole, parts))
    net = toxic.Network.fresh(1)
    small = net.inputs(*parts[1:])
    monkeypatch.setattr(toxic, "BLOCK", 4096)
    assert np.allclose(small, net.inputs(*whole[1:]))


def test_toxicity_on_held_out_rows(spark):
    """Ranks held-out labelled rows: the area under the curve of a constant score is a half."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, folder, "labels").collect()}
    rows = toxic.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")).collect()
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) in (0, 1)]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows if r["held_out"])
    bad, good = ([s for s, label in held if label == x] for x in (1, 0))
    area = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    assert len(bad) >= 5 and area > 0.85


def test_shards_follow_the_curve(spark):
    docs = table(spark, FOLDER, "documents")
    rows = sorted(hilbert.shards(docs, 8).collect(), key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["curve_index"], r["text_crc32"], r["doc_id"]) for r in rows]
    assert keys == sorted(keys)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    of = collections.defaultdict(set)
    for r in rows:
        of[lang[r["doc_id"]]].add(r["shard"])
    # a reader of one language opens fewer shards than there are, for all languages but the largest
    largest = collections.Counter(lang.values()).most_common(1)[0][0]
    assert all(len(found) <= 5 for name, found in of.items() if name != largest)


def test_shard_ranges(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}", "en" if i < 30 else "de", "s", i) for i in range(50)] + [(99, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    placed = hilbert.shards(docs, 4)
    found = {r["shard"]: r.asDict() for r in hilbert.shard_ranges(docs, placed, ["n_chars", "lang"]).collect()}
    plain = collections.defaultdict(list)
    by_id = {r["doc_id"]: r for r in docs.collect()}
    for r in placed.collect():
        plain[r["shard"]].append(by_id[r["doc_id"]])
    for shard, rows in plain.items():
        chars = [r["n_chars"] for r in rows if r["n_chars"] is not None]
        langs = [r["lang"] for r in rows if r["lang"] is not None]
        assert found[shard] == {"shard": shard, "rows": len(rows), "min_n_chars": min(chars), "max_n_chars": max(chars),
                                "min_lang": min(langs), "max_lang": max(langs)}


def test_sweeps_reach_the_exact_number_of_tables():
    """Every customer moves in a sweep, so the mean comes out as summed over all seatings (weight**tables times their number)."""
    s, dishes = pitman_yor.Settings(), 800
    for count, weight in ((2, 0.3), (6, 1.0), (60, 20.0), (150, 40.0)):
        ways = np.zeros(count + 2)
        ways[1] = 1.0
        at = np.arange(count + 2)
        for n in range(1, count):
            ways = np.append(0, ways[:-1]) + np.maximum(n - s.discount * at, 0) * ways * (at <= n)
            ways /= ways.max()
        exact = ways * np.exp((at - count) * np.log(weight))
        exact = (exact * at).sum() / exact.sum()
        key = pitman_yor.mix(np.arange(dishes, dtype=np.uint64) + np.uint64(count))
        found = pitman_yor.seat(np.full(dishes, count), np.full(dishes, weight), key, s, s.samples)
        assert found.shape == (s.samples, dishes) and found.min() >= 1 and found.max() <= count
        assert np.abs(found.mean() - exact) < 0.05 * exact
    assert (pitman_yor.seat(np.ones(3, dtype=int), np.ones(3), key[:3], s, 2) == 1).all()


def test_stirling_numbers_of_large_dishes():
    """Series and integrals meet the table, on both sides of its end."""
    c = pitman_yor.TABULATED
    for d in (0.5, 0.75, 0.9):
        logs = pitman_yor._stirling(d)[c * (c - 1) // 2:]
        at = np.arange(1, c + 1)
        logs = logs + np.cumsum(np.log(at)) - np.log(at).sum()
        for first, last in ((1, 22), (1, 200), (400, 900), (1800, c), (c, c)):
            found = pitman_yor._large(np.zeros(last - first + 1, dtype=int), np.array([c]), at[first - 1:last], np.array([first]), d)
            assert np.abs(found - logs[first - 1:last]).max() < 1e-7
    s, many, key = pitman_yor.Settings(), np.full(3000, 1), pitman_yor.mix(np.arange(3000, dtype=np.uint64))
    for weight in (0.001, 5.0, 300.0, 1e5):
        one, two = (pitman_yor.seat(many * n, many * weight, key, s, 1) for n in (c, c + 1))
        assert two.mean() == pytest.approx(one.mean() * (1 + 1 / c) ** 0.5, rel=0.002)


def test_a_dish_costs_less_than_its_customers():
    """Customers are seated at once: a million dishes of two and a dish of a hundred million in seconds."""
    s, began = pitman_yor.Settings(), time.process_time()
    pitman_yor.seat(np.full(1_000_000, 2), np.full(1_000_000, 0.5), pitman_yor.mix(np.arange(1_000_000, dtype=np.uint64)), s, 3)
    found = pitman_yor.seat(np.array([100_000_000]), np.array([50.0]), np.array([7], dtype=np.uint64), s, 3)
    assert time.process_time() - began < 20 and 30 < found.mean() < 110


def test_requests_are_gathered_by_word(monkeypatch):
    """A word whose requests lie in several batches is one row; of words that none learns from no context is kept."""
    monkeypatch.setattr(pitman_yor, "GATHERED", 1)
    rows = [(-5, 1, [2, 9], [0, 3]), (-5, 2, [2, 7], [0, 1]), (-5, 3, [9], [4]), (0, 1, [4], [0]), (8, 1, [1], [2]), (8, 2, [1], [2])]
    names = ["word", "unit", "contexts", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    expected = [(-5, [7, 9], [1, 7], [1, 2, 3], [2, 2, 1], [2, 9, 2, 7, 9]), (0, [], [], [1], [1], [4]), (8, [1], [4], [1, 2], [1, 1], [1, 1])]
    for size in (1, 2, 4, 6):
        batches = [whole.slice(i, size) for i in range(0, len(rows), size)]
        found = [tuple(r.values()) for b in pitman_yor._gatherer(iter(batches)) for r in b.to_pylist()]
        assert found == expected


def test_requests_and_answers_travel_as_arrays(monkeypatch):
    """A unit's requests are a row for each range of hashes, not for each word; they are the words, contexts and counts of its texts, and answers go back alike."""
    monkeypatch.setattr(pitman_yor.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(pitman_yor, "UNIT_BYTES", 1)
    monkeypatch.setattr(pitman_yor, "SLICE_ROWS", 3)
    texts = [" ".join(f"w{i * j % 5000}" for j in range(3000)) for i in range(1, 6)] + [None, "", "x w0"]
    learn = [1, 0, 1, 1, 1, 1, 0, 1]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None, 5, 6, 7, 8]), pa.array(texts), pa.array(learn)], names=["row", "text", "learn"])
    expected = collections.Counter()
    for i, (text, known) in enumerate(zip(texts, learn)):
        context = 0
        for word in [*(text or "").split(), None]:
            data = np.frombuffer((word or "x").encode(), dtype=np.uint8)
            key = int(tokens.words(data, np.array([0, len(data)])).hash[0]) if word else int(pitman_yor.END)
            expected[i // 3, tokens.signed(key), context] += known
            context = (word or "").encode()[-1] | (word.encode()[-2] << 8 if len(word) > 1 else 0) if word else 0
    packed = list(pitman_yor._packer(16)(iter([batch])))
    requests = [b for b in packed if b["packed"].null_count]
    assert sum(b.num_rows for b in packed) <= 3 * (16 + 1) and max(b.num_rows for b in requests) <= 3
    rows = pa.Table.from_batches(requests).combine_chunks().sort_by("range").to_batches()[0]
    for gathered, size in ((1, 1), (1, 7), (1 << 14, 5)):
        monkeypatch.setattr(pitman_yor, "GATHERED", gathered)
        found = list(pitman_yor._opener(rows.slice(at, size) for at in range(0, rows.num_rows, size)))
        assert len(found) > 1 or gathered > 1
        found = pa.Table.from_batches(found).to_pylist()
        assert [r["word"] for r in found] == sorted(r["word"] for r in found)
        assert {(r["unit"], r["word"], c): n for r in found for c, n in zip(r["contexts"], r["counts"])} == dict(expected)
        assert sum(len(r["contexts"]) for r in found) == len(expected)
    answers = [pa.RecordBatch.from_arrays(
        [pa.array([u for u, *_ in part]), pa.array([w for _, w, *_ in part]), pa.array([n for _, _, n, _ in part]),
         pa.array([x for *_, x in part], pa.list_(pa.float32()))], names=["unit", "word", "n", "logs"])
        for part in ([(7, 1, 10, [0.5]), (2, 1, 10, [1.5, 2.5])], [(7, 4, 0, [3.5, 4.5, 5.5])], [(2, 9, 3, [6.5])])]
    expected = {2: ([1, 9], [10, 3], [2, 1], [1.5, 2.5, 6.5]), 7: ([1, 4], [10, 0], [1, 3], [0.5, 3.5, 4.5, 5.5])}
    whole, = pitman_yor._answerer(iter(answers))
    assert {r["unit"]: (r["words"], r["n"], r["widths"], r["logs"]) for r in whole.to_pylist()} == expected
    monkeypatch.setattr(pitman_yor, "ANSWERED", 2)
    assert [b.num_rows for b in pitman_yor._answerer(iter(answers))] == [2, 2]


def test_the_whole_word_before_counts(spark):
    """Two words with the same last two bytes are contexts of their own: what followed one is likelier after it than after the other."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 10]
    rows = [(i, "first_ab one" if i % 2 else "second_ab two") for i in ids[:100]]
    rows += list(zip(held, ["first_ab one", "first_ab two", "second_ab one", "second_ab two"]))
    found = {r["doc_id"]: r for r in pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = [found[i]["score"] for i in held[:4]]
    assert all(found[i]["held_out"] for i in held[:4])
    assert seen[0] > seen[1] + 1 and seen[3] > seen[2] + 1


def test_predictions_of_a_context_add_up():
    """Over all known words and the unknown one the chances after any context, seen or not, are one; a word seen there leads its class."""
    rng, s, plain = np.random.default_rng(4), pitman_yor.Settings(), lambda totals: types.SimpleNamespace(value=totals)
    words = np.sort(rng.integers(-(1 << 63), 1 << 63, 41, dtype=np.int64))
    contexts = np.array([k << 48 | i for k in (0, 7, 40_000) for i in range(5)], dtype=np.uint64).view(np.int64)
    counts = rng.poisson(0.6, (41, 15)).astype(np.int32) * rng.integers(1, 9, (41, 15), dtype=np.int32)
    counts[:, [3, 14]] = 0  # contexts that nothing follows
    counts[17] = 0  # the unknown word
    counts[5, 2] = 5000
    every = [pa.array([x] * 41, pa.list_(kind)) for x, kind in ((contexts.tolist(), pa.int64()), ([1], pa.int64()), ([15], pa.int32()), (list(range(15)), pa.int32()))]
    table = pa.table({"bucket": pa.array([3] * 41, pa.int32()), "word": words, "contexts": every[0], "counts": pa.array(counts.tolist(), pa.list_(pa.int32())),
                      "units": every[1], "widths": every[2], "places": every[3]})

    def split(sums, samples):
        slots = sums.filter(pc.is_null(sums["bucket"]))
        flat = np.zeros(samples * (2 * pitman_yor.CONTEXTS + 2) + 2, dtype=np.int64)
        flat[slots["context"].to_numpy()] = slots["customers"].to_numpy()
        by = flat[:-2].reshape(samples, -1)
        own = sums.filter(pc.is_valid(sums["bucket"]))
        return own, pitman_yor.Totals(by[:, pitman_yor.CONTEXTS:-2], by[:, :pitman_yor.CONTEXTS], by[:, -2], by[:, -1], int(flat[-2]), int(flat[-1]))

    sums, now = split(pitman_yor._summer(None, s, 1)(table), 1)
    assert (now.known, now.tokens) == (40, counts.sum())
    assert dict(zip(sums["context"].to_pylist(), sums["tables0"].to_pylist())) == dict(zip(contexts.tolist(), (counts > 0).sum(axis=0).tolist()))
    for samples in (1, s.samples):
        before, given = now, sums
        sums, now = split(pitman_yor._summer(plain(before), s, samples)(table, given), samples)
    assert dict(zip(sums["context"].to_pylist(), sums["customers"].to_pylist())) == dict(zip(contexts.tolist(), counts.sum(axis=0).tolist()))
    answer, = pitman_yor._scorer(plain(before), plain(now), s)(table, sums).to_pylist()
    p = 10 ** np.array(answer["logs"]).reshape(41, 15)
    assert answer["words"] == words.tolist() and answer["n"] == counts.sum(axis=1).tolist()
    assert p.sum(axis=0) == pytest.approx(np.ones(15), rel=1e-5)
    assert p[5, 2] > 0.9 > 10 * p[17, 2]
    assert not np.allclose(p[:, 0], p[:, 1])


def test_gathered_words_keep_what_none_learns():
    """Contexts that a held-out text alone asks for are there with a count of 0; places name them in the order of the asks."""
    names = ["word", "unit", "contexts", "counts"]
    rows = [(-5, 1, [-2, 9], [0, 3]), (-5, 2, [7, -2], [1, 0]), (6, 1, [4], [0])]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    found = [r for b in pitman_yor._dealt(10)(pitman_yor._gatherer(iter([whole]))) for r in b.to_pylist()]
    assert [(r["word"], r["contexts"], r["counts"], r["units"], r["widths"], r["places"]) for r in found] == [
        (-5, [-2, 7, 9], [0, 1, 3], [1, 2], [2, 2], [0, 2, 1, 0]), (6, [4], [0], [1], [1], [0])]
    assert [r["bucket"] for r in found] == [9, 0]
