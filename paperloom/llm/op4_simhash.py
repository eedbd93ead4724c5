"""SimHash near-duplicates through pivot distance tables.

Fingerprints: 4-word shingles, XXH64 with seed 42, one bit a position by majority. Equal fingerprints are merged first,
with map-side combining, so a group of copies however large is one row from there on.

Pivots: each fingerprint's Hamming distances to 64 reference fingerprints, the rows of a Hadamard code, are a table. By
the triangle inequality two fingerprints within 4 bits differ by at most 4 in every coordinate, so a pair is discarded by
its largest difference. The squares of the differences of a pair at d bits sum to 64 d: one of them is at least the root
of d, and every pair at more than 16 bits is discarded before its distance is taken. Survivors are verified exactly.

Candidates: a table alone would compare all rows with all, and cannot be an index either, as a coordinate has a standard
deviation of 4 and a window of 4 around it holds two thirds of all rows. So pairs are only formed inside files: two
fingerprints within 4 bits agree in full on at least two of six bit blocks, and each distinct fingerprint is filed under
its 15 pairs of blocks (20 to 22 bits). Within a file rows are sorted by the first coordinate and meet inside its window.
A file that holds more than HOT_ROWS distinct fingerprints is filed again under sub-blocks of the bits that are left (of
five, one must agree), and what is still too large is cut into cells of bounded size. No case is dropped.

Only a spanning forest of each file's links leaves the search; components come from star rounds written to the
shared folder.

Nulls and empty texts have the fingerprint zero and link like any other. A null doc_id keeps its fingerprint, gets the
component of its group and never names one (null where the group has no id). Repeated rows give a row each. Only doc_id
and text are read, so other columns cannot clash. An empty table gives no rows.

A component of very many fingerprints, or a fingerprint of very many rows, is one key of a join with a row per key; such
a join splits by the planner's skew join (spark.sql.adaptive.skewJoin, on by default), as its other side is never large.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, as_bytes, components, forest, grouped_batches, runs, ship, spread, table, tile_hot, written

SHINGLE, SEED, MOST_BITS = 4, 42, 4
HOT_ROWS = 4096
PAIRS_AT_ONCE = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks that cut ``bits`` into n blocks of nearly equal size."""
    cut = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cut, cut[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Any two fingerprints within 4 bits agree under one of these masks at least.
MASKS = [a | b for a, b in combinations(_blocks(list(range(64)), MOST_BITS + 2), 2)]
#: For each of them, five wider masks of which one must agree as well.
FINER = [[m | s for s in _blocks([b for b in range(64) if not m >> b & 1], MOST_BITS + 1)] for m in MASKS]
#: Reference fingerprints: rows of a Hadamard code, pairwise 32 bits apart, in an order in which any first few depend on all bits.
PIVOTS = np.array([sum((bin(i & j).count("1") & 1) << j for j in range(64)) for i in sorted(range(64), key=lambda i: i * 37 % 64)], np.uint64)


def fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of one whole text."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [h64(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - SHINGLE].tolist()]
        hashes = [h64(line[a:z], SEED) for a, z in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys`` (doc_id by default) and fp (the fingerprint's bits as a signed long) of each row."""
    ship(docs.sparkSession)
    own = docs.select(*keys, "text") if keys else spread(docs)
    keys = keys or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t) for t in as_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), pa.array(fp, pa.int64())], names=[*keys, "fp"])

    return own.mapInArrow(run, ", ".join([f"{k} {own.schema[k].dataType.simpleString()}" for k in keys] + ["fp long"]))


def coordinates(fp: np.ndarray) -> np.ndarray:
    """(pivots, rows) Hamming distances of fingerprints to the pivots."""
    return np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int8)


def links(group: np.ndarray, fp: np.ndarray, counts: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within 4 bits among rows of equal ``group``: pivot window, further pivots, exact distance.

    ``counts`` gets how many pairs the groups hold, how many each step leaves, and how many are links.
    """
    first = np.bitwise_count(fp ^ PIVOTS[0]).astype(np.int64)
    at = group.astype(np.int64) * 256 + first
    order = np.argsort(at, kind="stable")
    at, fp = at[order], fp[order]
    pivots = coordinates(fp)
    ends = np.searchsorted(at, at + MOST_BITS, "right")
    partners = ends - np.arange(len(at)) - 1
    total = np.concatenate([[0], np.cumsum(partners)])
    left, right = [], []
    i = survivors = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS_AT_ONCE, "right")) - 1)
        n = partners[i:j]
        a = np.repeat(np.arange(i, j), n)
        b = np.arange(len(a)) - np.repeat(total[i:j] - total[i], n) + a + 1
        for column in pivots[1:]:
            near = np.abs(column[a] - column[b]) <= MOST_BITS
            a, b = a[near], b[near]
        survivors += len(a)
        true = np.bitwise_count(fp[a] ^ fp[b]) <= MOST_BITS
        left.append(order[a[true]])
        right.append(order[b[true]])
        i = j
    a, b = (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))
    if counts is not None:
        size = np.unique(group, return_counts=True)[1]
        for k, n in (("filed", int((size * (size - 1) // 2).sum())), ("window", int(total[-1])), ("pivots", survivors), ("links", len(a))):
            counts[k] = counts.get(k, 0) + n
    return a, b


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = ["mask", "file", "cell_i", "cell_j"]
    for t in grouped_batches(batches, key):
        keys = np.column_stack([t.column(k).to_numpy() for k in key])
        fp = t.column("fp").to_numpy().view(np.uint64)
        group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])
        a, b = links(group, fp)
        if not len(a):
            continue
        # a spanning forest of each group's links is as good as all of them
        order = np.argsort(group[a], kind="stable")
        a, b = a[order], b[order]
        out_a, out_b = [], []
        for s, e in runs(group[a][:, None]):
            if e - s < 3:
                out_a.append(a[s:e])
                out_b.append(b[s:e])
                continue
            nodes, at = np.unique(np.concatenate([a[s:e], b[s:e]]), return_inverse=True)
            near = np.zeros((len(nodes), len(nodes)), bool)
            near[at[: e - s], at[e - s :]] = near[at[e - s :], at[: e - s]] = True
            edges = np.array(forest(near))
            out_a.append(nodes[edges[:, 0]])
            out_b.append(nodes[edges[:, 1]])
        a, b = fp[np.concatenate(out_a)].view(np.int64), fp[np.concatenate(out_b)].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def fingerprint_links(fps: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp``, enough of them to give every component."""
    masks = F.array(*(F.lit(_signed(m)) for m in MASKS))
    filed = fps.select("fp", F.posexplode(masks).alias("mask", "m")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("m")).alias("file"))
    size = filed.groupBy("mask", "file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("mask", "file", F.lit(True).alias("hot"))
    finer = F.array(*(F.array(*(F.struct((F.lit(len(MASKS) + 5 * i + j)).alias("mask"), F.lit(_signed(s)).alias("m")) for j, s in enumerate(row))) for i, row in enumerate(FINER)))
    filed = filed.join(size, ["mask", "file"], "left")
    cold = filed.where(F.col("hot").isNull()).select("fp", "mask", "file")
    hot = filed.where(F.col("hot")).select("fp", F.explode(F.element_at(finer, F.col("mask") + 1)).alias("x"))
    hot = hot.select("fp", F.col("x.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("x.m")).alias("file"))
    cells = cold.withColumns({"cell_i": F.lit(0), "cell_j": F.lit(0)}).unionByName(tile_hot(hot, ["mask", "file"], "fp", hot_rows).drop("tile"))
    key = ["mask", "file", "cell_i", "cell_j"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(_search, "a long, b long")


def _rooted(least: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``least`` (fp, first) that link with nothing, and the others with the root of their component."""
    roots = components(fingerprint_links(least.select("fp"), hot_rows))
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = named.join(roots.select(F.col("root").alias("_r")).distinct(), F.col("root") == F.col("_r"), "left")
    return linked.where(F.col("_r").isNull()).select("fp", "first"), linked.where(F.col("_r").isNotNull()).select("fp", "first", "root")


def components_of(fp_docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """fp, component_id for each distinct fp of ``fp_docs`` (doc_id, fp)."""
    least = written(fp_docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash")
    alone, groups = _rooted(least, hot_rows)
    ids = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    return alone.withColumnRenamed("first", "component_id").unionByName(groups.select("fp", "root").join(ids, "root").select("fp", "component_id"))


def simhash(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs`` (doc_id, text)."""
    fp = written(fingerprints(docs), "simhash")
    ids = components_of(fp, hot_rows)
    return fp.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row of each component of ``docs``, with the columns of documents.

    It is the row of smallest doc_id (rows without one come last), then of smallest text hash, then of smallest lang,
    source and n_chars. Each row is judged by its own text: an id that stands on several texts is in several components
    and may stay once in each.
    """
    docs = docs.select(*DOC_COLUMNS)
    marked = docs.withColumns({"_none": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id"), F.lit(0)).cast("long"), "_hash": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    key = ["_none", "_id", "_hash"]
    least = fingerprints(marked, key).groupBy("fp").agg(F.min(F.struct(*key)).alias("first"))
    alone, groups = _rooted(written(least, "simhash"), hot_rows)
    chosen = alone.select("first").unionByName(groups.groupBy("root").agg(F.min("first").alias("first")).select("first"))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("lang", "source", "n_chars"))
    once = marked.withColumn("_turn", turn).where("_turn = 1")
    return once.join(chosen.select("first.*"), key, "left_semi").select(*DOC_COLUMNS)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))
