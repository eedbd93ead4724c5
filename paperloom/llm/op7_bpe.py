"""Byte-level BPE encoding and decoding by a segment tree over byte positions.

Each match of the pattern is encoded alone. Leaf i of the tree holds the rank of the pair that starts at byte position
i; an inner node holds the least rank below it, and on equal ranks the left child wins, so the root names the leftmost
pair of least rank. A merge updates the leaf of the merged part, its left live neighbour and the vanished part: three
point updates of logarithmic cost, so a match of n bytes takes O(n log n), however long it is. Nearly all matches are
words of a few bytes: up to SHORT bytes the ranks are a plain list that is searched anew for its least at every merge,
with the same ids at about half the cost.

A null text is empty: no ids, and the digests of no bytes. A null doc_id stays null; repeated rows give a row each; only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, ship, spread, table, vocabulary

VOCABULARY = "byte_bpe_50k.tiktoken"
NONE = 1 << 30
#: Bytes up to which the list of ranks is searched; from about 100 on the tree is faster.
SHORT = 64
ONE = [bytes([i]) for i in range(256)]
#: Characters above which a text is taken apart bit by bit, so that the table of what is known is bounded within it too.
AT_ONCE = 1 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match of the pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return by_scan(piece, ranks) if len(piece) <= SHORT else by_tree(piece, ranks)


def by_scan(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by a list of the live parts and one of the ranks of their pairs: quadratic, for short pieces."""
    get = ranks.get
    parts = [ONE[b] for b in piece]
    ranked = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while ranked:
        low = min(ranked)
        if low == NONE:
            break
        i = ranked.index(low)  # the leftmost
        del ranked[i]
        own = parts[i] = parts[i] + parts.pop(i + 1)
        if i < len(ranked):
            ranked[i] = get(own + parts[i + 1], NONE)
        if i:
            ranked[i - 1] = get(parts[i - 1] + own, NONE)
    return [ranks[p] for p in parts]


def by_tree(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids by the segment tree, for pieces of any length."""
    n = len(piece)
    get = ranks.get
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the live part before

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while (low := tree[1]) != NONE:
        k = 1
        while k < size:  # the left child wins a tie
            k *= 2
            if tree[k] != low:
                k += 1
        i = k - size
        j = end[i]  # the part that vanishes
        e = end[i] = end[j]
        if e < n:
            before[e] = i
            put(i, get(piece[i : end[e]], NONE))
        else:
            put(i, NONE)
        if j < n - 1:
            put(j, NONE)
        if (p := before[i]) >= 0:
            put(p, get(piece[p:e], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Known(dict):
    """Ids of pieces as bytes; a piece that is looked up for the first time is encoded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks)
        found = self[piece] = pack(f"<{len(ids)}I", *ids)
        return found


class Codec:
    """Encoder and decoder with a bounded memory of pieces: it is emptied at ``most`` pieces, within a long text as well."""

    def __init__(self, path: str, pattern: str, most: int = 400_000):
        import regex

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        bytes_of = {v: k for k, v in self.ranks.items()}
        self.bytes_of = pa.array(map(bytes_of.get, range(max(bytes_of) + 1)), pa.large_binary())
        self.known = Known(self.ranks)
        self.most = most

    def ids_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) <= AT_ONCE:
            return self._encoded(self.pattern.findall(text))
        pieces = (m[0] for m in self.pattern.finditer(text))
        return b"".join(self._encoded(own) for own in iter(lambda: [*islice(pieces, AT_ONCE // 8)], []))

    def _encoded(self, pieces: list[str]) -> bytes:
        if len(self.known) > self.most:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        parts = self.bytes_of.take(pa.array(np.frombuffer(ids, "<u4")))
        assert not parts.null_count, "an id without bytes"
        _, offsets, data = parts.buffers()
        return data[: np.frombuffer(offsets, np.int64)[len(parts)]].to_pybytes() if len(parts) else b""


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Digests of the ids of each whole text and of the bytes they decode to; with ``keep_ids`` the ids as well."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    path = path or vocabulary(VOCABULARY)
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, ids_of, digest, decoded = [], [], [], []
            for t in as_bytes(b.column("text")):
                ids = c.ids_bytes(t.decode("utf-8", "replace"))
                n.append(len(ids) // 4)
                digest.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    ids_of.append(np.frombuffer(ids, "<u4").astype(np.int32))
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(docs).mapInArrow(run, SCHEMA + (", ids array<int>" if keep_ids else ""))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
