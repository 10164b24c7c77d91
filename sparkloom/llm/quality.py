"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a few statistics (shares of character classes, repetition, word and line shapes). Standardised
by the labelled rows, they pass through random Fourier features, whose inner products approximate a Gaussian
kernel. Ridge weights solve the normal equations, which partitions sum up: a partition sends one matrix of
fixed size, and matrices are summed in a tree. The labelled rows are cut in three folds; scores of each fold
under the weights of the others are calibrated by isotonic regression over at most ``BINS`` score bins.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2, all of them. Labels, lang, source and
doc_id never enter a score.

Defined cases: null and empty texts have all statistics 0 and are scored like any other; a document that is
labelled more than once counts once for each label; null labels and labels without a document are ignored; a null
doc_id is scored and not held out; without any labels of both kinds the score is the share of label 1 (0.5
without labels) and ``keep_good`` keeps everything; an empty table gives no rows; extra columns of any name pass
through ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, free_name, partitions, table, trimmed, with_text
from .words import NONSPACE, chunks, hashes, spans, utf8

FEATURES = 256
RIDGE = 1e-3
SEED = 20240501
BINS = 1000
CUTOFF = 0.7
#: Partial matrices that one task sums.
TREE = 64

_CLASS = np.zeros(256, np.int8)
for _k, _range in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:'\"()-", b"!?", bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-!?")), 1):
    for _c in _range:
        _CLASS[_c] = _k
_CLASS[128:] = 9
STATISTICS = ("lower", "upper", "digit", "space", "line", "stop", "bang", "symbol", "wide", "log_words", "word_length", "same_neighbour", "distinct", "same_second", "upper_start", "mixed_words", "line_length", "symbol_words")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    data, offsets = utf8(texts)
    rows = [_statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
    return np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[first])


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    kind = _CLASS[data]
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    share = np.bincount(text_of * 10 + kind, minlength=n * 10).reshape(n, 10)[:, 1:] / np.maximum(1, np.diff(offsets))[:, None]
    starts, ends, first = spans(data, offsets, NONSPACE)
    words = np.diff(first)
    some = np.maximum(1, words)
    h = hashes(data, starts, ends)
    word_of = np.repeat(np.arange(n), words)
    length = ends - starts

    def same(step: int) -> np.ndarray:
        if len(h) <= step:
            return np.zeros(len(h))
        return np.append((h[step:] == h[:-step]) & (word_of[step:] == word_of[:-step]), np.zeros(step))

    order = np.lexsort((h, word_of))
    new = np.ones(len(h))
    new[1:] = (h[order][1:] != h[order][:-1]) | (word_of[order][1:] != word_of[order][:-1])
    symbol = np.concatenate([[0], np.cumsum(kind == 8)])
    with_symbol = symbol[ends] > symbol[starts]
    head_upper, last_symbol = kind[starts] == 2, np.isin(kind[np.maximum(ends - 1, 0)], (7, 8)) if len(ends) else np.zeros(0)
    lines = 1 + _by_text(kind == 5, offsets)
    out = [
        *share.T,
        np.log1p(words) / 10,
        np.minimum(1, _by_text(length, first) / some / 20),
        _by_text(same(1), first) / some,
        _by_text(new, first) / some,
        _by_text(same(2), first) / some,
        _by_text(head_upper, first) / some,
        _by_text(last_symbol, first) / some,
        np.log1p(words / lines) / 10,
        _by_text(with_symbol, first) / some,
    ]
    return np.where(words[:, None] > 0, np.stack(out, 1), 0.0)


@dataclass
class Model:
    """What scores a text: centre, scale, frequencies, phases, weights and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    value: np.ndarray
    trained: bool = True

    def features(self, stats: np.ndarray) -> np.ndarray:
        return fourier((stats - self.centre) / self.scale, self.frequency, self.phase)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(stats), self.value[0])
        return np.interp(self.features(stats) @ self.weight, self.at, self.value)


def fourier(x: np.ndarray, frequency: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Random Fourier features with a constant column."""
    z = np.cos(np.clip(x, -8, 8) @ frequency + phase) * math.sqrt(2 / len(phase))
    return np.concatenate([z, np.ones((len(z), 1))], 1)


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4: 2 is held out, the others are the folds; a null doc_id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(0)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """fold, y and statistics of the labelled rows to learn from; texts are not shuffled, their statistics are."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("double").alias("y")).withColumn("fold", fold(F.col("doc_id"))).where("fold <> 2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(1))
            offsets = pa.array(np.arange(len(stats) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(stats.ravel()))], names=["doc_id", "stats"])

    mine = with_text(docs).where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    return mine.mapInArrow(trimmed(run), "doc_id long, stats array<double>").join(marks, "doc_id").select("fold", "y", "stats")


def _summed(rows: DataFrame, one, spark: SparkSession) -> np.ndarray | None:
    """Sum over partitions of ``one(batch)``, an array of fixed shape, first by partition and then in a tree."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = one(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["x"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), "<f8")
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["x"])

    parts = rows.mapInArrow(trimmed(part), "x binary")
    n = partitions(spark)
    while n > TREE:
        n = -(-n // TREE)
        parts = parts.repartition(n).mapInArrow(trimmed(merge), "x binary")
    found = [np.frombuffer(r["x"], "<f8") for r in parts.repartition(1).mapInArrow(trimmed(merge), "x binary").collect()]
    return found[0] if found else None


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stats = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), stats


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rising values nearest to good / n in squares weighted by n (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for g, k in zip(good.tolist(), n.tolist(), strict=True):
        blocks.append([g, k, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, k2, m2 = blocks.pop()
            blocks[-1][0] += g2
            blocks[-1][1] += k2
            blocks[-1][2] += m2
    return np.repeat([g / k for g, k, _ in blocks], [m for _, _, m in blocks])


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    spark = docs.sparkSession
    rows = cut(labelled(docs, labels))
    d = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        _, y, x = _columns(batch)
        return np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])

    sums = _summed(rows, moments, spark)
    none = np.zeros(0)
    if sums is None or sums[1] in (0, sums[0]):
        share = 0.5 if sums is None else sums[1] / sums[0]
        return Model(none, none, none, none, none, none, np.array([share]), trained=False)
    n = sums[0]
    centre = sums[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(1e-6, sums[2 + d :] / n - centre**2))
    rng = np.random.default_rng(seed)
    # a bandwidth of twice the root of the dimension: smooth enough that far rows still resemble their nearest kind
    frequency, phase = rng.normal(size=(d, features)) / (2 * math.sqrt(d)), rng.uniform(0, 2 * math.pi, features)
    size = features + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        folds, y, x = _columns(batch)
        z = fourier((x - centre) / scale, frequency, phase)
        out = np.zeros((3, size, size + 1))
        for k, f in enumerate((0, 1, 3)):
            zk = z[folds == f]
            out[k, :, :size], out[k, :, size] = zk.T @ zk, zk.T @ y[folds == f]
        return out.ravel()

    by_fold = _summed(rows, normal, spark).reshape(3, size, size + 1)

    def solve(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[:, :size] + ridge * np.eye(size), total[:, size])

    weight = solve(by_fold.sum(0))
    others = [solve(by_fold.sum(0) - by_fold[k]) for k in range(3)]

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        folds, y, x = _columns(batch)
        z = fourier((x - centre) / scale, frequency, phase)
        out = np.zeros((2, BINS))
        for k, f in enumerate((0, 1, 3)):
            at = np.clip(((z[folds == f] @ others[k] + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)
            np.add.at(out[0], at, y[folds == f])
            np.add.at(out[1], at, 1)
        return out.ravel()

    good, count = _summed(rows, binned, spark).reshape(2, BINS)
    used = np.flatnonzero(count)
    at = (used + 0.5) / BINS * 2 - 0.5
    value = isotonic(at, good[used], count[used])
    return Model(centre, scale, frequency, phase, weight, at, value)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spread.value.score(statistics(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    found = with_text(docs).mapInArrow(trimmed(run), "doc_id long, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, all columns as they are."""
    model = fit(docs, labels)
    if not model.trained:
        return docs
    spread = docs.sparkSession.sparkContext.broadcast(model)
    text = free_name(docs.columns, "scored_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = spread.value.score(statistics(batch.column(batch.num_columns - 1))) >= CUTOFF
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(good))

    bounded(docs.sparkSession)
    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(trimmed(run), T.StructType(docs.schema.fields))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
