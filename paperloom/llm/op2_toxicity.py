"""Toxicity by a convolutional text classifier, trained here in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first 4, 5 and 6 characters. Filters of widths
1, 2 and 3 run over the word sequence, each is max-pooled over the whole text, and a dense layer gives the logit. As the
pool is a maximum, a text of any length is scored in pieces: each window belongs to the piece in which it begins and
reads on into the next, so the size of the pieces changes no score. No window spans two texts.

Learning reads labels only from rows with crc32(doc_id as text) % 4 <> 2. Documented bounds of the sample (scoring has
none): at most POSITIVES and NEGATIVES rows, the first by hash of doc_id, and of each class at most SAMPLE_BYTES / 2 of
text, a row that would go beyond it being left out. At every size, updates of BATCH rows are made until STEPS of them or a
pass over the rows whose mean loss is under LEARNED. A fifth of the rows, fold 0, only calibrates: for each language,
guessed from the text's function words (never from ``lang``), the threshold of best F1 is moved to the score 0.3; a
language with under ENOUGH rows of a class takes the threshold of all rows, and without rows of both classes in the fold
that is the logit 0.

A null or empty text is scored from the bias alone. A null doc_id is held out. Repeated rows give a row each; where a
labelled id stands on several texts the least is learned from. Without labelled rows of both classes outside the fold
every score is 0.1. Only doc_id, text and the labels are read; other columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, as_bytes, held_out_column, ship, spread, table

POSITIVES, NEGATIVES, SAMPLE_BYTES, ENOUGH = 3000, 5000, 64 << 20, 8
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 12, 8, (1, 2, 3)
STEPS, BATCH, RATE, DECAY, LEARNED = 1200, 32, 0.02, 1e-4, 0.01
CUT = 0.3
PIECE_WORDS = 1 << 15
PREFIXES = (4, 5, 6)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
FUNCTION_WORDS = {
    "en": "the of and to in a is that it was for on with as by at from this are or be an",
    "de": "der die und den das von zu mit sich des auf für ist im dem nicht ein eine als auch in",
    "fr": "le la les et des du un une que qui dans pour par sur au avec pas est en de ce",
    "es": "el los las del se por con una su para no lo al como más que un y en de la",
}
_TONGUES = list(FUNCTION_WORDS)
_TONGUE_OF: dict[str, list[int]] = {}
for _i, _k in enumerate(_TONGUES):
    for _w in FUNCTION_WORDS[_k].split():
        _TONGUE_OF.setdefault(_w, []).append(_i)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class Words:
    """Feature buckets and function-word votes of raw words; the table is emptied at ``most`` words."""

    def __init__(self, most: int = 150_000):
        self.most = most
        self.reset()

    def reset(self) -> None:
        self.row: dict[bytes, int] = {b"": 0}
        self.flat = array("i", [0] * (1 + len(PREFIXES)))
        self.tongues = bytearray(1)

    def rows(self, words: list[bytes]) -> np.ndarray:
        row = self.row
        for w in {*words}:
            if w not in row:
                t = _EDGE.sub("", w.decode("utf-8", "replace").lower())
                keys = [t, *(f"{n}:{t[:n]}" if len(t) > n else "" for n in PREFIXES)]
                row[w] = len(self.tongues)
                self.flat.extend(zlib.crc32(k.encode()) % (BUCKETS - 1) + 1 if k else 0 for k in keys)
                self.tongues.append(sum(1 << i for i in _TONGUE_OF.get(t, ())))
        return np.fromiter(map(row.__getitem__, words), np.int32, len(words))

    def features(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(rows, features) buckets of words by row number, as a copy."""
        return np.array(np.frombuffer(self.flat, np.int32).reshape(-1, 1 + len(PREFIXES))[ids])

    def votes(self, ids: np.ndarray) -> np.ndarray:
        """(rows, languages) whether a word is a function word of a language."""
        return np.frombuffer(self.tongues, np.uint8)[ids][:, None] >> np.arange(len(_TONGUES)) & 1


@dataclass
class Model:
    """Weights of the classifier; ``shift`` has a logit threshold for each language and, last, for none."""

    e: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: float
    shift: np.ndarray

    def responses(self, x: np.ndarray) -> np.ndarray:
        """x: responses of single words (rows, all filter taps) -> responses of windows (rows, filters); rows past the end are empty."""
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        at = 0
        for k, width in enumerate(WIDTHS):
            o = out[:, k * FILTERS : (k + 1) * FILTERS]
            o[:] = x[:, at : at + FILTERS]
            for j in range(1, width):
                o[:-j] += x[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += width * FILTERS
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.b, 0) @ self.v + self.c

    def score(self, logit: np.ndarray, tongue: np.ndarray) -> np.ndarray:
        z = np.clip(logit.astype(float) - self.shift[tongue] + np.log(CUT / (1 - CUT)), -30, 30)
        return 1 / (1 + np.exp(-z))


def tongue_of(votes: np.ndarray) -> np.ndarray:
    """Language with most function words; the last index where there are none."""
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), len(_TONGUES))


def read(model: Model, texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Logit and language of each whole text."""
    pooled = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
    votes = np.zeros((len(texts), len(_TONGUES)))
    queue: list[tuple[int, list[bytes], int]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not queue:
            return
        flat: list[bytes] = []
        edges = []
        for _, part, own in queue:
            edges += (len(flat), len(flat) + own)
            flat += part
            flat += (b"", b"")  # windows end here
        ids = words.rows(flat)
        used, ids = np.unique(ids, return_inverse=True)
        x = model.e[words.features(used)].sum(axis=1) @ model.w
        # every other range: the windows that begin in a piece, and what lies between pieces
        top = np.maximum.reduceat(model.responses(x[ids]), edges)[::2]
        v = np.add.reduceat(words.votes(used)[ids], edges)[::2]
        for k, (doc, _, _) in enumerate(queue):
            pooled[doc] = np.maximum(pooled[doc], top[k])
            votes[doc] += v[k]
        queue.clear()
        held = 0
        if len(words.row) > words.most:
            words.reset()

    for doc, text in enumerate(texts):
        ws = text.split()
        pooled[doc] = -np.inf if ws else -model.b
        for i in range(0, len(ws), PIECE_WORDS):
            part = ws[i : i + PIECE_WORDS + max(WIDTHS) - 1]
            queue.append((doc, part, min(PIECE_WORDS, len(ws) - i)))
            held += len(part)
            if held >= PIECE_WORDS:
                flush()
    flush()
    return model.logits(pooled), tongue_of(votes)


def _thresholds(logit: np.ndarray, tongue: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Threshold of best F1 for each language (middle of the best range); that of all rows where a class has under ENOUGH."""

    def best(z: np.ndarray, t: np.ndarray) -> float:
        if not len(t) or t.min() == t.max():
            return 0.0
        order = np.argsort(-z)
        z, t = z[order], t[order]
        tp = np.cumsum(t)
        f1 = 2 * tp / (np.arange(1, len(t) + 1) + t.sum())
        k = int(np.argmax(f1))
        return float(z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 2)) / 2

    out = np.full(len(_TONGUES) + 1, best(logit, y))
    for i in range(len(_TONGUES)):
        own = tongue == i
        if min(y[own].sum(), (1 - y[own]).sum()) >= ENOUGH:
            out[i] = best(logit[own], y[own])
    return out


def train(rows: list[tuple[int, bytes, int]], seed: int = 11) -> Model | None:
    """Learn from (fold, text, label) rows: fold 0 of 5 calibrates. None unless both classes are there."""
    rng = np.random.default_rng(seed)
    words = Words(most=1 << 60)
    learn = [(words.rows(t.split()), y) for k, t, y in rows if k]
    y = np.array([y for _, y in learn], float)
    if not len(y) or y.min() == y.max():
        return None
    f = words.features()
    del words  # the largest thing here
    # how far each bucket's share of texts differs between the classes, as a z-score, starts the first dimension
    df = np.zeros((2, BUCKETS))
    for ids, label in learn:
        df[int(label)][np.unique(f[np.unique(ids)])] += 1
    share = (df + 0.5) / np.array([[len(y) - y.sum() + 1], [y.sum() + 1]])
    z = (np.log(share[1]) - np.log(share[0])) / np.sqrt((1 / (df + 0.5)).sum(axis=0))
    seen = df.sum(axis=0) > 0
    e = np.zeros((BUCKETS, DIMS), np.float32)
    e[seen] = rng.normal(0, 0.05, (int(seen.sum()), DIMS))
    e[seen, 0] = np.clip(z[seen] / 4, -1.5, 3)
    e[0] = 0
    taps = FILTERS * sum(WIDTHS)
    w = rng.normal(0, 0.15, (DIMS, taps)).astype(np.float32)
    w[0, : FILTERS // 2] += 1
    m = Model(e, w, np.full(FILTERS * len(WIDTHS), -0.5, np.float32), rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0, np.zeros(len(_TONGUES) + 1))
    m.v[: FILTERS // 2] += 0.5
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    tap = np.cumsum([0, *(FILTERS * k for k in WIDTHS)])
    dense = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in "wbv"}
    g2 = np.full(BUCKETS, 1e-3, np.float32)
    step, loss = 0, np.inf
    while step < STEPS and loss >= LEARNED:
        order, loss = rng.permutation(len(y)), 0.0
        for i in range(0, len(y), BATCH):
            step += 1
            docs = [d for d in order[i : i + BATCH] if len(learn[d][0])]
            if not docs:
                continue
            flat = np.concatenate([np.concatenate([learn[d][0], np.zeros(2, np.int32)]) for d in docs])
            starts = np.cumsum([0, *(len(learn[d][0]) + 2 for d in docs)])
            used, inverse = np.unique(flat, return_inverse=True)
            xe = m.e[f[used]].sum(axis=1)
            r = m.responses((xe @ m.w)[inverse])
            arg = np.array([r[s : t - 2].argmax(axis=0) + s for s, t in zip(starts[:-1], starts[1:])])
            pooled = np.take_along_axis(r, arg, axis=0) + m.b
            h = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-(h @ m.v + m.c)))
            loss -= float(np.log(np.maximum(np.where(y[docs] > 0, p, 1 - p), 1e-9)).sum()) / len(y)
            dz = ((p - y[docs]) * weight[docs] / len(docs)).astype(np.float32)
            dv = h.T @ dz + DECAY * m.v
            dh = dz[:, None] * m.v * (pooled > 0)
            dw = DECAY * m.w
            rows_, grads = [], []
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(width):
                    cols = tap[k] + j * FILTERS + np.arange(FILTERS)
                    at = inverse[arg[:, own] + j]
                    dw[:, cols] += np.einsum("dfe,df->ef", xe[at], dh[:, own])
                    rows_.append(at.ravel())
                    grads.append((dh[:, own][:, :, None] * m.w[:, cols].T[None]).reshape(-1, DIMS))
            ids, g = f[used[np.concatenate(rows_)]], np.concatenate(grads)
            live = np.abs(g).sum(axis=1) > 0
            ids, g = ids[live], g[live]
            for j in range(ids.shape[1]):
                touched, back = np.unique(ids[:, j], return_inverse=True)
                total = np.zeros((len(touched), DIMS), np.float32)
                np.add.at(total, back, g)
                total[touched == 0] = 0
                g2[touched] += (total**2).mean(axis=1)
                m.e[touched] -= RATE * total / np.sqrt(g2[touched])[:, None]
            for k, d in (("w", dw), ("b", dh.sum(axis=0)), ("v", dv)):
                a, q = dense[k]
                a += 0.1 * (d - a)
                q += 0.01 * (d * d - q)
                getattr(m, k)[...] -= RATE / 4 * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-6)
            m.c -= RATE * float(dz.sum())
    fit = [(t, y) for k, t, y in rows if not k]
    logit, tongue = read(m, [t for t, _ in fit], Words())
    m.shift = _thresholds(logit, tongue, np.array([y for _, y in fit]))
    return m


def _within(sizes: list[tuple[int, int, int]]) -> dict[int, int]:
    """Label by doc_id of (doc_id, label, bytes) rows in order, as far as their class's half of SAMPLE_BYTES goes."""
    out, left = {}, [SAMPLE_BYTES // 2] * 2
    for doc, label, size in sizes:
        if size <= left[label]:
            left[label] -= size
            out[doc] = label
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learn from the labelled rows that are not held out; the sample's bounds are POSITIVES, NEGATIVES and SAMPLE_BYTES."""
    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    own = own.where(~held_out_column(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    turn = F.xxhash64(F.col("doc_id"), F.lit(2))
    chosen = own.where("toxic = 1").orderBy(turn, "doc_id").limit(POSITIVES).unionByName(own.where("toxic = 0").orderBy(turn, "doc_id").limit(NEGATIVES))
    # at most POSITIVES + NEGATIVES ids, so they may be broadcast, and their sizes collected
    sizes = spread(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("size"))
    label = _within([(r.doc_id, r.toxic, r.size or 0) for r in sizes.orderBy(turn, "doc_id").collect()])
    ids = spark.createDataFrame([(i,) for i in label], "doc_id long")
    found = spread(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    fold = (F.crc32(F.col("doc_id").cast("string")) / 4).cast("long") % 5
    rows = found.select("doc_id", fold.cast("int").alias("fold"), "text").toArrow().sort_by("doc_id")
    return train(list(zip(rows.column("fold").to_pylist(), as_bytes(rows.column("text")), (label[i] for i in rows.column("doc_id").to_pylist()))))


def _scores(model: Model | None, texts: list[bytes], words: Words) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.1)
    return model.score(*read(model, texts, words)) if texts else np.empty(0)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x DIMS floats, 6 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            s = _scores(sent.value, as_bytes(b.column("text")), words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held"), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return spread(docs).select("doc_id", "text", held_out_column(F.col("doc_id")).alias("held")).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that score under the cut, with the columns of documents."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.select(*DOC_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            yield b.filter(pa.array(_scores(sent.value, as_bytes(b.column("text")), words) < CUT, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
