"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

The terms of a text are its byte trigrams, its four-grams of character classes, words that repeat the word before them, and the
scale of its length, each hashed to a fixed number of columns; their counts over the whole text are damped, weighted by
rarity, and projected on the leading singular vectors of the labelled sample. A document's score is the weighted
share of label 1 among its ``NEIGHBOURS`` nearest labelled vectors, by exact cosines with all of them, computed in blocks. Weights are the
similarity to a power, times the number of labelled rows that a sampled row stands for.

The labelled sample is bounded: at most ``PER_CLASS`` rows of each label (those with the least hash of the id), outside the
held-out fold. What is broadcast, their vectors (256 bytes each) and the projection, is therefore below 4 MB at any
size of the corpus.

Defined results: null and empty texts have only the length term; they are scored like others, by short labelled texts.
Labels with a null id or quality are ignored; of several labels of one id the least counts. Without labels every score is 0.5.
Rows with a null id are scored too, as held out. Cosines are compared to six digits; ties between neighbours go to the labelled row first in id order. Of rows that
repeat a labelled id one text is learned from, that with the least hash; all are scored.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import U64, text_blocks, word_hashes
from ._store import arrow_map, bucket_of, load

PER_CLASS, RANK, NEIGHBOURS, POWER = 2000, 64, 25, 8
TRIGRAMS, SHAPES, OTHER = 4096, 1024, 32
COLUMNS = TRIGRAMS + SHAPES + OTHER
THRESHOLD = 0.3
F32 = np.float32
# Character classes: lower, upper, digit, space, line end, each of the common marks, the rest of ASCII, bytes of longer characters.
CLASSES = np.full(256, 14, np.uint32)
CLASSES[128:] = 15
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[32], CLASSES[10] = 0, 1, 2, 3, 4
for _i, _marks in enumerate((b".", b",", b"!", b"?", b"|", b"#*$%&", b"<>", b"-_=", b"@:/")):
    CLASSES[list(_marks)] = 5 + _i


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, COLUMNS): damped counts of the terms of each text of a block."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, COLUMNS), F32)
    for width, columns, start in ((3, TRIGRAMS, 0), (4, SHAPES, TRIGRAMS)):
        if len(data) < width:
            continue
        x = (data if width == 3 else CLASSES[data]).astype(np.uint32)
        code = x[: len(x) - width + 1].copy()
        for j in range(1, width):
            code *= np.uint32(256 if width == 3 else 16)
            code += x[j : len(x) - width + 1 + j]
        code *= np.uint32(2654435761)
        code >>= np.uint32(32 - columns.bit_length() + 1)
        inside = rows[: len(code)] == rows[width - 1 :]
        flat = np.bincount((rows[: len(code)] * columns + code)[inside], minlength=n * columns)
        out[:, start : start + columns] = flat.reshape(n, columns)
    words, bounds = word_hashes(data, offsets)
    if len(words):
        again = np.zeros(len(words) + 1, np.int64)
        same = words[1:] == words[:-1]
        inner = np.ones(len(words), bool)
        inner[bounds[:-1][bounds[:-1] < len(words)]] = False
        np.cumsum(np.append(False, same) & inner, out=again[1:])
        out[:, TRIGRAMS + SHAPES] = again[bounds[1:]] - again[bounds[:-1]]
    n_words = np.diff(bounds)
    np.log1p(out, out=out)
    # The share of repeats, and the scale of the length, as terms of their own.
    out[:, TRIGRAMS + SHAPES] *= 10
    scale = np.minimum(np.log2(1 + n_words), 19)
    low = scale.astype(np.int64)
    out[np.arange(n), TRIGRAMS + SHAPES + 1 + low] = 4 * (1 - (scale - low))
    out[np.arange(n), TRIGRAMS + SHAPES + 2 + low] = 4 * (scale - low)
    return out


@dataclass
class Model:
    rarity: np.ndarray  # (COLUMNS,)
    basis: np.ndarray  # (COLUMNS, RANK)
    vectors: np.ndarray  # (labelled, RANK), unit length
    labels: np.ndarray
    weights: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        v = x @ (self.basis * self.rarity[:, None])
        v /= np.linalg.norm(v, axis=1, keepdims=True) + F32(1e-9)
        return v

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 0.5)
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return out
        v = self.project(x)
        for a in range(0, len(v), 256):
            near, similar = nearest(v[a : a + 256] @ self.vectors.T, k)
            weight = np.maximum(similar, 1e-6).astype(float) ** POWER * self.weights[near]
            out[a : a + 256] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def nearest(similar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``k`` largest of each row, compared to six digits; of equal ones the first columns."""
    similar = np.round(similar, 6)
    least = np.partition(similar, similar.shape[1] - k, axis=1)[:, similar.shape[1] - k, None]
    above, tied = similar > least, similar == least
    chosen = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    near = np.nonzero(chosen)[1].reshape(len(similar), k)
    return near, np.take_along_axis(similar, near, axis=1)


def _parts(x: np.ndarray, rows: int = 256) -> Iterator[np.ndarray]:
    return (x[i : i + rows].astype(F32) for i in range(0, len(x), rows))


def fit(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, seed: int = 3) -> Model:
    """Leading singular vectors of the weighted sample by subspace iteration."""
    if not len(x):
        return Model(np.ones(COLUMNS, F32), np.zeros((COLUMNS, RANK), F32), np.zeros((0, RANK), F32), labels, weights)
    found = np.zeros(COLUMNS)
    for part in _parts(x):
        found += (part > 0).sum(axis=0)
    rarity = np.log((1 + len(x)) / (1 + found)).astype(F32) + F32(0.1)

    def weighted(part: np.ndarray) -> np.ndarray:
        y = part * rarity
        y /= np.linalg.norm(y, axis=1, keepdims=True) + F32(1e-9)
        return y

    # The weighted rows are made again for each block and step: only half-precision counts stay in memory.
    basis = np.random.default_rng(seed).standard_normal((COLUMNS, RANK + 8)).astype(F32)
    for _ in range(4):
        turned = np.zeros_like(basis)
        for part in _parts(x):
            y = weighted(part)
            turned += y.T @ (y @ basis)
        basis, _ = np.linalg.qr(turned)
    _, values, turned = np.linalg.svd(np.concatenate([weighted(part) @ basis for part in _parts(x)]), full_matrices=False)
    values = values[:RANK]
    # Equal parts of every direction would raise noise, the raw ones hear only the common: the root lies between.
    basis = (basis @ turned.T[:, :RANK]) / np.sqrt(values + 1e-6)
    model = Model(rarity, basis.astype(F32), np.zeros((0, RANK), F32), labels, weights)
    model.vectors = np.concatenate([model.project(part) for part in _parts(x)])
    return model


def _features_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column(1)):
            rows = features(data, offsets).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "x"])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (bucket_of("doc_id", 5) != 0))
    single = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).cast("int").alias("quality"))
    of_class = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = single.withColumn("nth", F.row_number().over(of_class)).where(F.col("nth") <= per_class).select("doc_id", "quality").collect()
    totals = dict(single.groupBy("quality").count().collect())
    known = {r.doc_id: r.quality for r in chosen}
    if not known:
        return np.zeros((0, COLUMNS), F32), np.zeros(0), np.zeros(0)
    picked = docs.sparkSession.createDataFrame([(i,) for i in known], "doc_id long")
    # Of rows that repeat a sampled id the text with the least hash stands for it.
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id", "left_semi")
    single_texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text")
    rows = arrow_map(single_texts, _features_task, "doc_id long, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.empty((len(rows), COLUMNS), np.float16)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r.x, np.float16)
    y = np.array([known[r.doc_id] for r in rows], float)
    counts = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    return x, y, np.array([totals[int(c)] / counts[int(c)] for c in y])


def block_scores(model: Model, texts: pa.Array) -> np.ndarray:
    """A score for each text, in blocks of at most a megabyte (or one text) and 512 texts."""
    parts = [np.zeros(0)]
    for a, b, data, offsets in text_blocks(texts, 1 << 20):
        for i in range(0, b - a, 512):
            j = min(i + 512, b - a)
            parts.append(model.scores(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
    return np.concatenate(parts)


def _score_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = block_scores(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").cast("string"))
    return arrow_map(rows, _score_task(model), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score(docs, fit(*labelled_sample(docs, load(spark, sf_dir, "labels"))))


def _keep_task(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(block_scores(model, batch.column(text_at)) >= THRESHOLD))

    return run


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are predicted to have label 1, with all their columns; nothing is shuffled."""
    return arrow_map(docs, _keep_task(model, docs.columns.index("text")), docs.schema)
