"""Byte-level BPE by given ranks: pre-tokens are merged with segment trees, many at once.

A text is cut by the pattern; equal pre-tokens of a batch of texts are encoded once. Where the pattern allows it, texts are cut
before spaces first and each distinct word is cut by the pattern once. Ids are arrays, never lists of a text. For each pre-token a
segment tree over its byte positions holds at every node the smallest pair rank below it, and the leftmost
position where it stands. A merge takes the root's position, joins the pair there, and rewrites the
leaves of the merged position, its live left neighbour and the absorbed position: each rewrite walks
to the root, a logarithmic number of nodes. Trees of equal height are arrays and move in step; rank
and position are packed into one integer, so a node is the minimum of its children.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_PAIR = 1 << 62
CACHE = 200_000  # pre-tokens, and words, remembered by a Python worker
STEP = 4096  # trees of one height that move together
WORD = 64  # characters of the longest word that is remembered as a whole
# Patterns that cut a text the same if it is cut before every space that a word follows: no match goes from another character into a
# space, the last space before a word goes with the word, and the white space before that space is cut as at the end of a text.
BY_SPACE = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}
SPACE = re.compile(r"(?= \S)")


class Vocabulary:
    """Ranks of byte strings, and the rank of every pair of them whose join is ranked too."""

    def __init__(self, content: bytes) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.byte_pairs = self.pair(*np.meshgrid(self.byte_rank, self.byte_rank, indexing="ij"))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``NO_PAIR``; a negative side stands for no neighbour."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = (left >= 0) & (right >= 0) & (self.pair_keys[at] == keys)
        return np.where(known, self.pair_ranks[at], NO_PAIR)


def _update(tree: np.ndarray, start: np.ndarray, node: np.ndarray, values: np.ndarray, levels: int) -> None:
    """Sets leaves and the nodes above them, level by level. The trees stand one after the other; ``start`` is where a leaf's begins."""
    tree[start + node] = values
    for _ in range(levels):
        node = node >> 1
        child = start + 2 * node
        tree[start + node] = np.minimum(tree[child], tree[child + 1])


def _merge_trees(texts: list[bytes], width: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Encodes byte strings of at most ``width`` bytes, a power of two."""
    count, levels = len(texts), width.bit_length() - 1
    shift, columns = max(1, width.bit_length()), width + 1
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=count)
    ids = np.full((count, columns), -1, dtype=np.int64)
    raw, inside = np.zeros((count, width), dtype=np.uint8), np.arange(width) < lengths[:, None]
    raw[inside] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ids[:, :width][inside] = vocabulary.byte_rank[raw[inside]]
    after = np.tile(np.arange(1, columns + 1), count)  # live neighbours
    before = after - 2
    none = np.int64(NO_PAIR)

    tree = np.full((count, 2 * width), none, dtype=np.int64)
    rows, at = np.nonzero(inside[:, 1:])
    ranks = vocabulary.byte_pairs[raw[rows, at], raw[rows, at + 1]]
    tree[rows, width + at] = np.where(ranks < none, ranks << shift | at, none)
    for level in range(levels, 0, -1):
        lo = 1 << (level - 1)
        tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])
    tree, ids = tree.reshape(-1), ids.reshape(-1)
    live = np.arange(count)
    best = tree[2 * width * live + 1]
    while True:
        more = best < none
        live, best = live[more], best[more]
        if not len(live):
            break
        start, root = columns * live, 2 * width * live
        at = best & ((1 << shift) - 1)
        here = start + at
        gone = after[here]
        following = after[start + gone]
        joined = best >> shift
        ids[here], ids[start + gone] = joined, -1
        after[here] = following
        inner = following < width
        before[(start + following)[inner]] = at[inner]
        left = before[here]
        has = left >= 0
        # the pairs that the joined position makes with either neighbour
        pairs = vocabulary.pair(
            np.concatenate([joined, ids[start[has] + left[has]]]), np.concatenate([ids[start + np.minimum(following, width)], joined[has]]))
        place = np.concatenate([at, left[has]])
        leaves = np.where(pairs < none, pairs << shift | place, none)
        _update(tree, np.concatenate([root, root, root[has]]), width + np.concatenate([gone, place]),
                np.concatenate([np.full(len(live), none), leaves]), levels)
        best = tree[root + 1]
    ids = ids.reshape(count, columns)
    kept = ids >= 0
    return ids[kept], kept.sum(axis=1)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all byte strings, none of them empty, one after the other, and how many each has."""
    groups: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        groups.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(i)
    length, done = np.zeros(len(pieces), dtype=np.int64), []
    for width, members in groups.items():
        step = max(1, STEP * 16 // width)
        for at in range(0, len(members), step):
            part = members[at:at + step]
            ids, length[part] = _merge_trees([pieces[i] for i in part], width, vocabulary)
            done.append((part, ids))
    start, out = np.cumsum(length) - length, np.empty(length.sum(), dtype=np.int64)
    for part, ids in done:
        out[_ranges(start[part], length[part])] = ids
    return out, length


class Recent:
    """Ids by text, all forgotten when there are too many."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def ids_of(self, keys: list[str], encode: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct keys, one after the other, and how many each has; ``encode`` gives them for new keys."""
        if len(self.slots) + len(keys) > CACHE:
            self.clear()
        slots = self.slots
        fresh = [key for key in keys if key not in slots]
        if fresh:
            ids, length = encode(fresh)
            slots.update(zip(fresh, range(len(slots), len(slots) + len(fresh))))
            self.ids = np.concatenate([self.ids, ids])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(length)])
        slot = np.fromiter(map(slots.__getitem__, keys), dtype=np.int64, count=len(keys))
        start, length = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        return self.ids[_ranges(start, length)], length


def _spread(keys: list[str], ids_of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of keys that repeat, by ``ids_of`` their distinct ones."""
    coded = pa.array(keys, pa.string()).dictionary_encode()
    ids, length = ids_of(coded.dictionary.to_pylist())
    which, start = coded.indices.to_numpy(), np.cumsum(length) - length
    return ids[_ranges(start[which], length[which])], length[which]


class Codec:
    """Encoder and decoder of a Python worker; remembers pre-tokens, and words with the pre-tokens they are cut into."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.by_space = pattern in BY_SPACE
        self.pieces, self.words = Recent(), Recent()
        strings = [vocabulary.strings.get(i, b"") for i in range(max(vocabulary.strings) + 1)]
        self.strings = pa.array(strings, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(len(strings))], pa.large_binary())

    def _cut(self, text: str) -> list[str]:
        """Stretches that the pattern cuts the same alone as in the text; long ones are cut into pre-tokens."""
        if not self.by_space:
            return self.pattern.findall(text)
        found = SPACE.split(text)
        if max(map(len, found)) <= WORD:
            return found
        return [piece for word in found for piece in ([word] if len(word) <= WORD else self.pattern.findall(word))]

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return encode_pieces([p.encode() for p in pieces], self.vocabulary)

    def _encode_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self.pattern.findall(word) if len(word) <= WORD else [word] for word in found]
        ids, length = _spread([p for x in pieces for p in x], lambda new: self.pieces.ids_of(new, self._encode_pieces))
        ends = np.append(0, np.cumsum(length))[np.cumsum([len(x) for x in pieces])]
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin, the end of the last included."""
        cut = [self._cut(text) for text in texts]
        store, encode = (self.words, self._encode_words) if self.by_space else (self.pieces, self._encode_pieces)
        ids, length = _spread([x for found in cut for x in found], lambda new: store.ids_of(new, encode))
        return ids, np.append(0, np.cumsum(length))[np.cumsum([0, *map(len, cut)])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The bytes of each text."""
        return _joined(self.strings, ids, bounds)

    def listed(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The decimal ids of each text, joined by commas."""
        return [text[:-1] for text in _joined(self.decimals, ids, bounds)]


def _joined(strings: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    taken = strings.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[taken.offset:taken.offset + len(taken) + 1][bounds].tolist() if len(ids) else [0] * len(bounds)
    data = memoryview(data) if len(ids) else memoryview(b"")
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:])]


WORKERS: dict[tuple[str, str], Codec] = {}  # of this Python process


def _codec(path: str, content: bytes, pattern: str) -> Codec:
    if (path, pattern) not in WORKERS:
        WORKERS[path, pattern] = Codec(Vocabulary(content), pattern)
    return WORKERS[path, pattern]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, digests: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id``, ``ids`` and ``decoded`` bytes of the whole text.

    ``digests`` gives ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` in place of the ids and bytes. A null text is empty: no ids, no bytes. Ids, repeated
    rows and their order pass as they are; other columns are not read. No rows: no rows. The rank file is
    read once, by the driver, and sent to the tasks; its size is that of the vocabulary.
    """
    with open(rank_file, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(rank_file, content.value, pattern)
        for batch in batches:
            ids, bounds = codec.encode([text or "" for text in batch.column(1).to_pylist()])
            decoded = codec.decode(ids, bounds)
            if digests:
                columns = [
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.sha256(text).hexdigest() for text in codec.listed(ids, bounds)], pa.string()),
                    pa.array([hashlib.sha256(text).hexdigest() for text in decoded], pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists, pa.array([bytes(text) for text in decoded], pa.binary())], names=["doc_id", "ids", "decoded"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(encode, f"doc_id {id_type}, {rest}")
