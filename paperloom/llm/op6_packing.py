"""Packing of token sequences by non-negative least squares over shallow length combinations.

One pass, no shuffle: each task tokenizes its rows and packs them in chunks of CHUNK tokens, so memory is bounded by a
chunk, not by a partition. In a chunk, documents give whole windows first. The histogram of what is left, in classes of
UNIT tokens, is matched by combinations of at most DEPTH classes that fill a window: non-negative least squares solves
how often each is used, the counts are rounded down and checked against the histogram. Residual pieces are packed
greedily: they are cut into the small gaps of planned windows, then into windows of their own; the last open window goes
on to the next chunk. At the end of a task that tail is cut at powers of two, which need no padding.

A null or empty text is its end token alone. A null doc_id stays null; repeated rows are packed each for themselves. Only
doc_id and text are read, so other columns cannot clash. sequence_id has the task's partition in its high bits, so a task
that runs again gives the same rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, ship, spread, table, vocabulary

VOCABULARY, END = "word_bpe_49k.json", 1
WINDOW, UNIT, DEPTH = 2048, 64, 4
CHUNK = 1 << 21
#: Bytes of text that are cut into words and looked up in one go; a longer text goes by itself.
AT_ONCE = 1 << 20
#: The vocabulary lowers case itself; lowered early, fewer distinct words are looked up. Its special tokens hold "<|" and are left alone.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ALNUM = np.array([bytes([i]).isalnum() for i in range(256)])  # of bytes: ASCII only
#: Lower-case letters of Latin-1 in UTF-8: the vocabulary leaves such a word as it is and in one part.
_LETTERS = re.compile(rb"[a-z]*(?:\xc3[\x9f-\xb6\xb8-\xbf][a-z]*)*").fullmatch
#: A special token of the vocabulary: text on its sides is tokenized apart.
_BETWEEN = b"<|startoftext|>"
#: What the last token of a word ends in.
_LAST = "</w>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Rows(dict):
    """Numbers words as they come, the empty one 0; ``new`` has those that came since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[bytes] = []
        self[b""] = 0

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


def _all_ids(tokenizer, parts: list[bytes]) -> np.ndarray:
    """Ids of the parts, one after the other."""
    found = tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)
    return np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])


def _offsets(a: pa.Array) -> np.ndarray:
    """Where the values of a large binary or string array begin and end."""
    return np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)


def _bytes(a: pa.Array) -> memoryview:
    return memoryview(a.buffers()[2] or b"")


def _binary(offsets: np.ndarray, data) -> pa.Array:
    """A large binary array over the buffers given."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)])


class Ids:
    """Token ids of whole texts.

    Words are cut at ASCII white space, which no token of this vocabulary spans, and only the distinct ones of AT_ONCE bytes
    are looked up in a table, emptied at ``most`` words. A word that ends in ASCII punctuation after an ASCII letter or
    digit is looked up as its two parts, which the vocabulary never merges.
    """

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # for words that need no normalizing and no cutting
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        known = self.tokenizer.get_vocab()
        self.last = np.zeros(max(known.values()) + 1, bool)
        self.last[[i for t, i in known.items() if t.endswith(_LAST)]] = True
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.row = _Rows()
        self.flat = np.empty(1 << 16, np.uint32)
        self.stop = np.zeros(1 << 16, np.int64)  # in bytes: row r is from stop[r] to stop[r + 1]

    def _learn(self) -> None:
        """Ids of the new words, in their order."""
        new = self.row.new
        first = len(self.row) - len(new)
        letters, others, odd = [], [], []
        for i, w in enumerate(new):
            (letters if _LETTERS(w) else odd if b"<|" in w else others).append(i)  # odd: may hold a special token
        kinds = ((self._merged, letters), (self._apart, others), (self._whole, odd))
        sizes, ids = map(np.concatenate, zip(*(encode([new[i] for i in own]) for encode, own in kinds)))
        order = np.argsort(np.array(letters + others + odd))
        found = _binary(np.concatenate([[0], 4 * np.cumsum(sizes)]), ids).take(pa.array(order))
        at = int(self.stop[first])
        stop = at + _offsets(found)
        while len(self.row) >= len(self.stop):
            self.stop = np.concatenate([self.stop, np.empty_like(self.stop)])
        while stop[-1] > 4 * len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.stop[first : first + len(stop)] = stop
        self.flat[at // 4 : stop[-1] // 4] = np.frombuffer(_bytes(found), np.uint32, len(ids))
        new.clear()

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of small letters: many to a call, each up to a token that ends a word."""
        ids = _all_ids(self.merges, [b" ".join(words[i : i + 128]) for i in range(0, len(words), 128)])
        return np.diff(np.flatnonzero(self.last[ids]), prepend=-1), ids

    def _apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words without special tokens: many to a call, with such a token between them."""
        ids = _all_ids(self.tokenizer, [_BETWEEN.join([*words[i : i + 128], b""]) for i in range(0, len(words), 128)])
        between = ids == self.tokenizer.token_to_id(_BETWEEN.decode())
        return np.diff(np.flatnonzero(between), prepend=-1) - 1, ids[~between]

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words that may hold special tokens."""
        found = [_all_ids(self.tokenizer, [w]) for w in words]
        return np.array([*map(len, found)], np.int64), np.concatenate([np.empty(0, np.uint32), *found])

    def _rows(self, words: pa.Array, special: bool) -> np.ndarray:
        """Two rows of the table for each word, the second 0 where it is not cut."""
        begin = _offsets(words)
        begin, end = begin[:-1], begin[1:]
        data = bytes(_bytes(words)) + b" "
        cut = begin + np.diff(_offsets(pc.ascii_rtrim(words, _PUNCTUATION)))
        joined = (cut > begin) & (cut < end) & _ALNUM[np.frombuffer(data, np.uint8)[cut - 1]]
        if special:
            joined &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        cut = np.where(joined, cut, end)
        look = self.row.__getitem__
        out = np.zeros((len(words), 2), np.int64)
        out[:, 0] = np.fromiter((look(data[i:j]) for i, j in zip(begin.tolist(), cut.tolist())), np.int64, len(words))
        out[joined, 1] = [look(data[i:j]) for i, j in zip(cut[joined].tolist(), end[joined].tolist())]
        if self.row.new:
            self._learn()
        return out

    def _texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        special = [b"<|" in t for t in texts]
        small = [t if s else t.translate(_LOWER) for t, s in zip(texts, special)]
        words = pc.ascii_split_whitespace(pa.array(small, pa.large_binary()).view(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary, any(special))
        halves = _binary(self.stop[: len(self.row) + 1], self.flat).take(pa.array(rows.ravel()))
        ids = _binary(_offsets(halves)[::2], _bytes(halves)).take(coded.indices)
        ends = _offsets(ids)[words.offsets.to_numpy()] // 4
        ids = np.frombuffer(_bytes(ids), np.uint32, int(ends[-1]))
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
            out = np.empty(j - i + 1, np.uint32)
            out[:-1] = ids[i:j]
            out[-1] = END
            yield out

    def batch(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, with the end token."""
        first = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t) > AT_ONCE:
                yield from self._bounded(texts[first:i])
                first, held = i, 0
            held += len(t)
        if first < len(texts):
            yield from self._bounded(texts[first:])

    def _bounded(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.row) > self.most:
            self.reset()
        return self._texts(texts)


@lru_cache(2)
def _ids(path: str) -> Ids:
    return Ids(path)


@lru_cache(1)
def combinations(classes: int = WINDOW // UNIT, depth: int = DEPTH) -> np.ndarray:
    """(classes, combinations): how often each class occurs in each multiset of at most ``depth`` that fills a window."""
    found: list[list[int]] = []

    def add(left: int, largest: int, chosen: list[int]) -> None:
        if not left:
            found.append(chosen)
        elif len(chosen) < depth:
            for k in range(min(left, largest), 0, -1):
                add(left - k, k, [*chosen, k])

    add(classes, classes, [])
    out = np.zeros((classes, len(found)))
    for j, c in enumerate(found):
        for k in c:
            out[k - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Lawson and Hanson's active-set method for min |ax - b|, x >= 0."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    scale = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= scale:
            break
        passive[j] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            low = passive & (s <= 1e-12)
            if not low.any():
                x = s
                break
            low_x = x[low]
            step = np.min(low_x / np.maximum(low_x - s[low], 1e-300))
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(combination, count) pairs that the histogram of classes can serve."""
    a = combinations()
    x = nnls(a, histogram.astype(float))
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1 - 1e-9:
            break
        need = a[:, j].astype(np.int64)
        some = need > 0
        k = min(int(x[j] + 1e-9), int((left[some] // need[some]).min()))
        if k > 0:
            left -= k * need
            out.append((need, k))
    return out


class Packer:
    """Packs pieces (document, start, ids, document's tokens) chunk by chunk."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.pieces: list[tuple] = []
        self.held = 0
        self.rows: list[tuple] = []

    def _emit(self, parts: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in parts:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % WINDOW
        for s in range(0, whole, WINDOW):
            self._emit([(doc, s, ids[s : s + WINDOW], n)])
        if n > whole:
            self.pieces.append((doc, whole, ids[whole:].copy(), n))
            self.held += n - whole
        if self.held >= CHUNK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        classes: list[list[tuple]] = [[] for _ in range(WINDOW // UNIT)]
        for p in self.pieces:
            classes[-(-len(p[2]) // UNIT) - 1].append(p)
        planned: list[list[tuple]] = []
        for need, k in plan(np.array([len(c) for c in classes])):
            kinds = [i for i in np.flatnonzero(need) for _ in range(need[i])]
            planned += [[classes[i].pop() for i in kinds] for _ in range(k)]
        rest = [p for c in reversed(classes) for p in c]
        gap = sum(WINDOW - sum(len(p[2]) for p in s) for s in planned)
        supply = sum(len(p[2]) for p in rest)
        while planned and supply < gap:  # too little to fill the gaps: the last windows are given up for it
            s = planned.pop()
            own = sum(len(p[2]) for p in s)
            supply += own
            gap -= WINDOW - own
            rest += s
        rest.reverse()

        def cut(size: int) -> list[tuple]:
            parts = []
            while size and rest:
                doc, start, ids, tokens = rest.pop()
                if len(ids) > size:
                    rest.append((doc, start + size, ids[size:], tokens))
                    ids = ids[:size]
                parts.append((doc, start, ids, tokens))
                size -= len(ids)
                supply_[0] -= len(ids)
            return parts

        supply_ = [supply]
        for s in planned:
            self._emit(s + cut(WINDOW - sum(len(p[2]) for p in s)))
        while supply_[0] >= WINDOW:
            self._emit(cut(WINDOW))
        if last:
            while supply_[0]:
                self._emit(cut(1 << (supply_[0].bit_length() - 1)))
        self.pieces = [(d, s, i.copy(), n) for d, s, i, n in reversed(rest)]
        self.held = supply_[0]

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 36)
        ids = _ids(path)
        for b in batches:
            for doc, own in zip(b.column("doc_id").to_pylist(), ids.batch(as_bytes(b.column("text")))):
                packer.add(doc, own)
            if packer.rows:
                yield packer.take()
        packer.flush(True)
        yield packer.take()

    return spread(docs).mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
