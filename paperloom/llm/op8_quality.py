"""Quality rules: characters inside repeated word n-grams and lines, by rolling hashes in numpy.

One pass over whole texts, no shuffle. A null or empty text has no words and fails the base rule; a null doc_id stays
null; repeated rows are judged alike, one row out for each row in. Only doc_id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import DOC_COLUMNS, as_bytes, ship, spread, table

#: n-gram length and the largest accepted share of word characters inside n-grams found twice or more (first included).
COVERAGE = {5: 0.55, 7: 0.50, 10: 0.45}
#: Largest accepted share of word characters inside lines equal to an earlier line.
LINE_COVERAGE = 0.30
MAX_SYMBOLS_PER_WORD = 0.10
_SPACE, _SYMBOLS, _CONTINUATION = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(0x80, 0xC0))
_P = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup5_chars long, dup7_chars long, dup10_chars long, base_failed boolean, kept boolean"


class Hasher:
    """64-bit word hashes; the table is emptied at ``most`` words, so memory is bounded and values never change."""

    def __init__(self, most: int = 200_000):
        self.seen: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in {*words}:
            if w not in seen:
                seen[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def covered(h: np.ndarray, n: int) -> np.ndarray | None:
    """Which of the words lie in a window (hashes ``h``, n words long) that occurs twice; None if no window does."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return None
    hit = np.isin(h, twice, kind="sort")
    ends = np.zeros(len(h) + n, np.int32)
    ends[: len(h)] += hit
    ends[n:] -= hit
    return np.cumsum(ends)[:-1] > 0


def measures(text: bytes, hasher: Hasher) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, dup5, dup7 and dup10 chars."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    dup_lines = dup_line_chars = 0
    lines = text.split(b"\n")
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                if bare := line.translate(None, _SPACE + _CONTINUATION):
                    dup_lines += 1
                    dup_line_chars += len(bare)
            else:
                seen.add(line)
    repeat = 0
    dup = {k: 0 for k in COVERAGE}
    if n > 3:
        one = hasher(words)
        h = one.copy()
        length, sizes = 1, None
        with np.errstate(over="ignore"):
            for k in (3, *COVERAGE):
                while length < min(k, n):
                    h = h[:-1] * _P + one[length:]
                    length += 1
                if n < k:
                    break
                inside = covered(h, k)
                if inside is None:  # then no longer window occurs twice either
                    break
                if k == 3:
                    repeat = int(inside.sum())
                else:
                    if sizes is None:
                        sizes = np.fromiter((len(w.translate(None, _CONTINUATION)) for w in words), np.int64, n)
                    dup[k] = int(sizes[inside].sum())
    return n, chars, symbols, dup_lines, repeat, dup_line_chars, *dup.values()


def verdict(m: tuple[int, ...]) -> tuple[bool, bool]:
    """base_failed and kept; all comparisons in whole numbers."""
    n, chars, symbols, _, repeat, line_chars, *dup = m
    base = n < 50 or 100 * repeat > 50 * n
    bad = 100 * line_chars > round(100 * LINE_COVERAGE) * chars or 100 * symbols > round(100 * MAX_SYMBOLS_PER_WORD) * n
    bad = bad or any(100 * d > round(100 * limit) * chars for d, limit in zip(dup, COVERAGE.values()))
    return base, not (base or bad)


def quality(docs: DataFrame) -> DataFrame:
    """One row of measures and verdict for each row of ``docs`` (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            rows = []
            for t in as_bytes(b.column("text")):
                m = measures(t, hasher)
                rows.append((*m, *verdict(m)))
            columns = list(zip(*rows)) or [()] * 11
            kinds = [pa.int64()] * 9 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return spread(docs).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of documents, in one pass."""
    ship(docs.sparkSession)
    docs = docs.select(*DOC_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            yield b.filter(pa.array([verdict(measures(t, hasher))[1] for t in as_bytes(b.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _dup_sql(n: int) -> str:
    return f"""g{n} as (select doc_id, i, count(*) over (partition by doc_id, array_to_string(list_slice(ws, i, i + {n - 1}), ' ')) k from (select doc_id, ws, unnest(range(1, len(ws) - {n - 2})) i from w where len(ws) >= {n})),
c{n} as (select doc_id, count(*) n, sum(length(ws[p])) c from (select distinct g.doc_id, g.i + o.o p from g{n} g, (select unnest(range(0, {n})) o) o where k > 1) join w using (doc_id) group by 1)"""


#: DuckDB SQL for the same rows. doc_id is the key of documents.
SQL = f"""with w as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
{', '.join(_dup_sql(n) for n in (3, 5, 7, 10))},
l as (select doc_id, count(*) n, sum(c) c from (select doc_id, row_number() over (partition by doc_id, x) k, length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g')) c
  from (select doc_id, unnest(string_split(t, chr(10))) x from w)) where k > 1 and c > 0 group by 1),
m as (select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(l.n, 0)::bigint n_dup_lines, coalesce(c3.n, 0)::bigint n_repeat_words,
  coalesce(l.c, 0)::bigint dup_line_chars, coalesce(c5.c, 0)::bigint dup5_chars, coalesce(c7.c, 0)::bigint dup7_chars, coalesce(c10.c, 0)::bigint dup10_chars
  from w left join l using (doc_id) left join c3 using (doc_id) left join c5 using (doc_id) left join c7 using (doc_id) left join c10 using (doc_id)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) base_failed from m)
select *, (not base_failed and 100 * dup_line_chars <= {round(100 * LINE_COVERAGE)} * word_chars and 100 * n_symbols <= {round(100 * MAX_SYMBOLS_PER_WORD)} * n_words
  and {' and '.join(f'100 * dup{n}_chars <= {round(100 * x)} * word_chars' for n, x in COVERAGE.items())}) kept from b"""
