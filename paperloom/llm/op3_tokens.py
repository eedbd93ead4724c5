"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates every piece that ends at each position, longest first; dynamic programming keeps,
for each position, only the best score and its piece count. The tie rule is that of the tokenizer libraries: a later
candidate wins only with a strictly greater score, so among equals the piece that starts first stands. A character that
no piece covers costs the least score less 10, and counts as its UTF-8 bytes where the vocabulary has byte pieces (as one
unknown piece otherwise; a run of unknown characters is then one piece, as the libraries fuse them).

No piece of such a vocabulary spans the step from another character to the space sign, so a text is cut there and each
distinct unit is searched once per worker, in a table of bounded size. Pieces and scores come from the vocabulary file;
scores are summed in double precision, exactly for whole-numbered scores.

A null or empty text has no tokens. A null doc_id stays null; repeated rows give a row each. Only doc_id and text are
read, so other columns cannot clash. A single unit of any length takes linear time in its matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, ship, spread, table, vocabulary

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
#: Characters above which a text is taken apart bit by bit, so that the table of what is known is bounded within it too.
AT_ONCE = 1 << 20
SCHEMA = "doc_id long, n_tokens long, n_unknown long"
_UNIT = re.compile(r" *[^ ]+| +")
_FLOOR = -1e6


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of a vocabulary file's ordinary pieces, and whether it has byte pieces. Scores under a million below zero, which mark pieces for white space, are raised to just under the least of the others."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in own}
    least = min(s for s in scores.values() if s > _FLOOR)
    return [(p, s if s > _FLOOR else least - 1) for p, s in scores.items()], any(sp.is_byte(i) for i in range(sp.get_piece_size()))


class Counter:
    """Counts tokens; the table of units is emptied at ``most`` of them, within a long text as well."""

    def __init__(self, pieces: list[tuple[str, float]], has_bytes: bool, most: int = 400_000):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for p, s in pieces:
            self.find.add_word(p, (len(p), s))
        self.find.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.has_bytes = has_bytes
        self.spaces_only = all(SPACE not in p.lstrip(SPACE) for p, _ in pieces)
        self.known: dict[str, tuple[int, int]] = {}
        self.most = most

    def unit(self, text: str) -> tuple[int, int]:
        """Tokens and unknown characters on the best path of ``text``, spaces already written as the space sign."""
        n = len(text)
        low = float("-inf")
        best = [low] * (n + 1)
        count, odd, fused = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0  # positions up to here are final

        def step(end: int, length: int, score: float, unknown: bool) -> None:
            start = end - length
            total = best[start] + score
            if total > best[end]:
                best[end] = total
                odd[end] = odd[start] + unknown
                if not unknown:
                    count[end] = count[start] + 1
                elif self.has_bytes:
                    count[end] = count[start] + len(text[start:end].encode())
                else:
                    count[end] = count[start] + (not fused[start])
                fused[end] = unknown

        matches: list[tuple[int, float]] = []

        def settle(end: int) -> None:
            single = False
            for length, score in matches:
                single |= length == 1
                step(end, length, score, False)
            if not single:
                step(end, 1, self.unknown, True)
            matches.clear()

        for last, value in self.find.iter(text):
            while done < last:
                done += 1
                settle(done)
            matches.append(value)
        while done < n:
            done += 1
            settle(done)
        return count[n], odd[n]

    def __call__(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        text = " " + text.replace(SPACE, " ")  # one space sign goes before each text
        if not (self.spaces_only and self.has_bytes):
            return self._sum([text])
        if len(text) <= AT_ONCE:
            return self._sum(_UNIT.findall(text))
        units = (m[0] for m in _UNIT.finditer(text))
        parts = [self._sum(own) for own in iter(lambda: [*islice(units, AT_ONCE // 8)], [])]
        return sum(n for n, _ in parts), sum(k for _, k in parts)

    def _sum(self, units: list[str]) -> tuple[int, int]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for u in {*units}:
            if u not in known:
                known[u] = self.unit(u.replace(" ", SPACE))
        n = odd = 0
        for u in units:
            a, b = known[u]
            n += a
            odd += b
        return n, odd


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(*read_vocabulary(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and n_unknown (characters written as bytes) of each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)
    path = path or vocabulary(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            found = [c(t.decode("utf-8", "replace")) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())], names=["doc_id", "n_tokens", "n_unknown"])

    return spread(docs).mapInArrow(run, SCHEMA)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
