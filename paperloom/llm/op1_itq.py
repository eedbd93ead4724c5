"""Embedding near-duplicates by iterative quantisation.

Rotations are learned in numpy on a bounded sample (SAMPLE vectors): each starts from a random orthogonal matrix over
the principal directions and alternates sign codes with a Procrustes step, which balances the variance over the bits.
Their codes are cut into 16-bit substrings, each one a Hamming table. There are as many rotations as give TABLES of them,
12, or more where the sample's spread around its mean is small: centring widens the angle of a pair there, and from that
angle follow the chance that a pair at the threshold shares a table, the number of tables for RECALL (MOST_TABLES at most,
as each costs a shuffle of codes; a common part above about 0.9 of the norm then costs recall) and the screen's radius.
Vectors that share a substring and a label meet in a bucket. Buckets first hold codes alone: rows with no other code
within RADIUS of their bits go, which chance meetings do and near vectors (whose bits differ by a sixteenth) don't. Only
what is left is joined with the original vectors and reranked by cosine in double precision, so no link below the
threshold is reported and vectors are not shuffled for every table. Every vector is indexed. Measured recall is in the
README and, for few dimensions and common means, in the tests.

Equal vectors of one label are merged first (map-side combining), so a group of copies is one row of the index, and
counts are multiplied back. Buckets of more than HOT_ROWS are cut into cells of bounded size. A pair that meets in
several tables counts in the first of them only, which its codes tell without a shuffle.

A vector that is null, empty, zero or holds a null or non-finite component, or whose label is null, links with nothing:
n_links 0, component its own id. Vectors of different lengths never link. Rows with a null vec_id keep their counts but
never name a component (null if no other row does). Repeated rows count as other vectors. Only vec_id, embedding and label
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, grouped_batches, runs, ship, table, tile_hot, written

THRESHOLD = 0.98
TABLES, MOST_TABLES, RECALL, BITS, ROUNDS = 12, 96, 0.99, 16, 30
SAMPLE = 20_000
HOT_ROWS = 2048
#: Share of differing bits up to which a pair is reranked, at least.
RADIUS = 0.25
SCHEMA = "a long, b long, n long"


def plan(x: np.ndarray, bits: int, threshold: float = THRESHOLD) -> tuple[int, float]:
    """Number of rotations and the radius for centred vectors ``x`` under codes of ``bits`` a rotation."""
    spread = float((x * x).sum(axis=1).mean()) if len(x) else 1.0
    flip = np.arccos(max(-1.0, 1 - (1 - threshold) / max(spread, 1e-9))) / np.pi
    share = max((1 - flip) ** BITS, 1e-9)
    tables = min(MOST_TABLES, max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-share)))))
    rotations = -(-tables // (bits // BITS))
    return rotations, max(RADIUS, flip + 4 * np.sqrt(flip * (1 - flip) / (rotations * bits)))


def learn(sample: np.ndarray, rounds: int = ROUNDS, seed: int = 7, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, (dims, bits) projection and radius learned from unit vectors; with no sample, random rotations."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    bits = min(64, max(BITS, d // BITS * BITS))
    mean = sample.mean(0) if len(sample) else np.zeros(d)
    x = sample - mean
    rotations, radius = plan(x, bits, threshold)
    parts = []
    for _ in range(rotations):
        if len(x) > d >= bits:
            w = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
            v = x @ w
            r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ vt).T
            parts.append(w @ r)
        else:  # too few vectors or dimensions to learn from
            parts.append(rng.standard_normal((d, bits)))
    return mean, np.concatenate(parts, axis=1), radius


def substrings(unit: np.ndarray, model: tuple) -> np.ndarray:
    """(rows, tables) 16-bit substrings of the codes."""
    bits = np.packbits((unit - model[0]) @ model[1] >= 0, axis=1)
    return np.ascontiguousarray(bits).view(">u2").astype(np.int32)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and v (double array) of the rows that can link."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _index(models: dict) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("dims").to_numpy()
            for d in np.unique(sizes):
                part = b.filter(pa.array(sizes == d))
                model = models.get(int(d)) or learn(np.empty((0, int(d))))
                sub = substrings(_unit(_matrix(part.column("v"))), model)
                n, t = sub.shape
                code = pa.array([x.tobytes() for x in sub.astype("<u2")], pa.binary())
                for i in range(t):
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), part.column("dims"), pa.array(np.full(n, i, np.int32)), pa.array(sub[:, i]), code], names=["id", "label", "dims", "tab", "bucket", "code"])

    return run


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """(rows, tables) 16-bit substrings."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<u2").reshape(len(values), -1)


_CELL = ["label", "dims", "tab", "bucket", "cell_i", "cell_j"]


def _keys(t: pa.Table) -> np.ndarray:
    label = np.unique(t.column("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
    return np.column_stack([label, *(t.column(k).to_numpy() for k in _CELL[1:])])


def _screen(radius: dict[int, float]) -> callable:
    """Rows of each cell that have another row within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, _CELL):
            keep = np.zeros(t.num_rows, bool)
            keys = _keys(t)
            for s, e in runs(keys):
                if e - s < 2:
                    continue
                c = _codes(t.column("code").slice(s, e - s))  # lengths follow dims, which a cell has one of
                limit = radius.get(int(keys[s, 1]), RADIUS) * BITS * c.shape[1]
                for i in range(0, e - s, 256):
                    far = np.zeros((len(c[i : i + 256]), e - s), np.int32)
                    for k in range(c.shape[1]):
                        far += np.bitwise_count(c[i : i + 256, k, None] ^ c[None, :, k])
                    keep[s + i : s + i + len(far)] = (far <= limit).sum(axis=1) > 1  # itself is one
            if keep.any():
                yield from t.filter(pa.array(keep)).to_batches()

    return run


def _search(threshold: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped_batches(batches, _CELL):
            keys = _keys(t)
            ids, copies, tile = (t.column(k).to_numpy() for k in ("id", "copies", "tile"))
            a, b, n = [], [], []
            for s, e in runs(keys):
                if e - s < 2:
                    continue
                x = _unit(_matrix(t.column("v").slice(s, e - s)))
                code, own = _codes(t.column("code").slice(s, e - s)), tile[s:e]
                across = keys[s, -2] != keys[s, -1]
                near = np.zeros((e - s, e - s), bool)
                for i in range(0, e - s, 512):
                    cos = x[i : i + 512] @ x.T
                    near[i : i + 512] = cos >= threshold - 1e-12
                    for p, q in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12)):  # on the edge: the plain sum decides
                        u, v = x[i + p], x[q]
                        near[i + p, q] = float((u * v).sum()) >= threshold
                near &= near.T
                np.fill_diagonal(near, False)
                if across:
                    near &= own[:, None] != own[None, :]
                for tab in range(int(keys[s, 2])):  # met in an earlier table: counted there
                    near &= code[:, tab][:, None] != code[:, tab][None, :]
                count = near @ copies[s:e]
                some = np.flatnonzero(count)
                a += ids[s:e][some].tolist()
                b += [None] * len(some)
                n += count[some].tolist()
                for i, j in forest(near):
                    a.append(int(ids[s + i]))
                    b.append(int(ids[s + j]))
                    n.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select("vec_id", "embedding", "label")
    rows = usable(vectors)
    # a class: equal vectors of one label. Its id is a row number free of vec_id, which may be null or repeated.
    classes = rows.groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "label", "v", F.size("v").alias("dims"), "copies", "least"), "itq")
    fit: dict[int, list] = {}
    for r in classes.select("v").orderBy(F.xxhash64("v")).limit(sample).toLocalIterator():
        fit.setdefault(len(r.v), []).append(r.v)
    models = {d: learn(_unit(np.array(x)), threshold=threshold) for d, x in fit.items()}
    filed = classes.select("id", "label", "dims", "v").mapInArrow(_index(models), "id long, label string, dims int, tab int, bucket int, code binary")
    cells = tile_hot(filed, _CELL[:4], "id", hot_rows)
    near = cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(_screen({d: m[2] for d, m in models.items()}), cells.schema)
    cells = near.join(classes.select("id", "copies", "v"), "id")
    found = written(cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(_search(threshold), SCHEMA), "itq")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = classes.select("id", "label", "v", "copies", "least").join(counts, F.col("id") == F.col("a"), "left").join(roots, F.col("id") == F.col("node"), "left")
    named = named.select("label", "v", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "id").alias("root"))
    low = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(low, "root").select("label", "v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(named, ["label", "v"]).select("vec_id", "n_links", "component_id")
    v = F.col("embedding").cast("array<double>")
    rest = vectors.where(~F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)))
    rest = rest.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
