"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed words and of hashed trigrams of character classes (which see
shouting, tables and junk signs in any language), damped, weighted and projected on the leading
singular directions of a sample of labelled texts. The labelled vectors of that sample are broadcast;
every document meets all of them in blocked products of unit vectors, and its nearest ones
vote with their similarity as weight.

The fit reads at most ``sample`` labelled rows (a documented bound, chosen by text hash); partial
products of the power iteration are added up from tasks. Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cutline.llm.text import BLANK_WORD, chunks, flat, words_of
from cutline.session import written

SHAPES, WORDS = 512, 1536
SAMPLE, DIMENSIONS, NEIGHBOURS, SHARPNESS = 8192, 64, 25, 8

#: character classes: lower and upper letters, digits, beyond ASCII, and each other byte for itself
_CLASS = np.zeros(256, np.int64)
_CLASS[range(97, 123)], _CLASS[range(65, 91)], _CLASS[range(48, 58)], _CLASS[range(128, 256)] = 1, 2, 3, 4
_OTHER = np.flatnonzero(_CLASS == 0)
_CLASS[_OTHER] = 5 + np.arange(len(_OTHER)) % 59


def features(column: pa.Array) -> np.ndarray:
    """Damped counts (rows x (SHAPES + WORDS)), each of the two blocks of unit length."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    out = np.zeros((n, SHAPES + WORDS), np.float32)
    # a start and an end mark around each text, so that even an empty one has a trigram
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes + 3)
    kind = np.full(len(row), 63, np.int64)
    inside = np.arange(len(data)) + np.repeat(3 * np.arange(n) + 1, sizes)
    kind[inside] = _CLASS[data]
    code = (kind[:-2] << 12) | (kind[1:-1] << 6) | kind[2:]
    same = row[:-2] == row[2:]
    bucket = ((code * 0x9E3779B1 & 0xFFFFFFFF) * SHAPES) >> 32
    out[:, :SHAPES] = np.bincount((row[:-2] * SHAPES + bucket)[same], minlength=n * SHAPES).reshape(n, SHAPES)
    words = words_of(column, BLANK_WORD)
    bucket = (words.hash % np.uint64(WORDS)).astype(np.int64)
    out[:, SHAPES:] = np.bincount(words.doc * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    return np.log1p(out)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    for part in (x[:, :SHAPES], x[:, SHAPES:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-6)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Neighbours:
    """Projection and labelled unit vectors; everything a task needs to score texts."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def score(self, column: pa.Array, neighbours: int, sharpness: float, block: int = 256) -> np.ndarray:
        x = _unit(weighted(features(column), self.idf) @ self.basis)
        k, prior = min(neighbours, len(self.labels)), float(self.labels.mean())
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            cosine = x[a: a + block] @ self.vectors.T
            near = np.argpartition(cosine, len(self.labels) - k, axis=1)[:, len(self.labels) - k:]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** sharpness
            out[a: a + block] = ((weight * self.labels[near]).sum(axis=1) + 1e-6 * prior) / (weight.sum(axis=1) + 1e-6)
        return np.clip(out, 0, 1)


def _summed(table: DataFrame, task: object, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over tasks of one array each; the array has a fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float64)
        for batch in batches:
            data = batch.column("counts").cast(pa.large_binary())
            if len(data):
                total += task(np.frombuffer(b"".join(data.to_pylist()), np.float16).reshape(-1, SHAPES + WORDS).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = table.select("counts").mapInArrow(run, "part binary").toLocalIterator()
    return sum((np.frombuffer(bytes(r[0]), np.float64) for r in parts), np.zeros(int(np.prod(shape)))).reshape(shape)


def fit(source: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, id_column: str = "doc_id",
        text_column: str = "text") -> Neighbours | None:
    """Fit on the rows of ``source`` (id, text) that ``labels`` (id, label) names; None without any.

    The ``sample`` different texts with the smallest hashes are taken, so the choice depends on nothing but
    texts. Only ids and hashes are joined with the labels; the few chosen ids meet the texts by broadcast.
    """
    own = labels.where("label is not null").groupBy(F.col(id_column).alias("id")).agg(F.avg("label").alias("label"))
    hashed = source.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(text_column, F.lit(""))).alias("h"))
    rows = hashed.join(own, "id").groupBy("h").agg(F.min("id").alias("id"), F.avg("label").alias("label"))
    chosen = written(rows.orderBy("h").limit(sample).select("id", "label"), "chosen")
    if chosen.isEmpty():
        return None
    texts = source.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            rows = features(chunk.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), chunk.column("label")], ["counts", "label"])

    table = written(texts.select("text", "label").mapInArrow(count, "counts binary, label double"), "sample")
    n, width = table.count(), SHAPES + WORDS
    idf = np.log((1 + n) / (1 + _summed(table, lambda x: (x > 0).sum(axis=0), (width,)))).astype(np.float32) + np.float32(0.1)
    basis = np.random.default_rng(0).standard_normal((width, dimensions + 16)).astype(np.float32)
    for _ in range(3):
        basis, _ = np.linalg.qr(basis)
        turn = basis.astype(np.float32)
        basis = _summed(table, lambda x: weighted(x, idf).T @ (weighted(x, idf) @ turn), basis.shape)
    # the last product, seen in the orthonormal frame it came from, is a small symmetric matrix
    values, inner = np.linalg.eigh(turn.T @ basis)
    top = (turn @ inner[:, np.argsort(-values)[:dimensions]]).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.float16).reshape(-1, width).astype(np.float32)
            rows = _unit(weighted(x, idf) @ top).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column("label")], ["vector", "label"])

    placed = table.mapInArrow(place, "vector binary, label double").toArrow()
    vectors = np.frombuffer(b"".join(placed.column("vector").to_pylist()), np.float32).reshape(-1, top.shape[1])
    return Neighbours(idf, top, vectors, np.array(placed.column("label").to_pylist()))


def quality_scores(docs: DataFrame, source: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS,
                   neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS, id_column: str = "doc_id", text_column: str = "text",
                   name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score``: 0 to 1, higher where label 1 is likelier.

    The model learns from ``source`` (id, text) and ``labels`` (id, ``label`` 0 or 1; null labels do not count,
    several labels of one text are averaged). The score depends on the text alone. Null texts score as
    empty ones; an empty text has a vector of its own and is scored like any other; equal texts score alike;
    without labelled rows every score is 0.5. A column of ``docs`` named as the score is replaced. An empty table
    gives an empty table.
    """
    model = fit(source, labels, sample, dimensions, id_column, text_column)
    kept = [c for c in docs.columns if c != name]
    if model is None:
        return docs.select(*kept, F.lit(0.5).alias(name))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size=1 << 19):
            scores = shared.value.score(chunk.column("text"), neighbours, sharpness)
            yield pa.RecordBatch.from_arrays([chunk.column("row"), pa.array(scores, pa.float64())], ["row", "score"])

    rows = docs.select(F.struct(*(F.col(c) for c in kept)).alias("row"), F.col(text_column).alias("text"))
    schema = rows.select("row", F.lit(0.5).alias("score")).schema
    return rows.mapInArrow(score, schema).select("row.*", F.col("score").alias(name))
