"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics are those of the whole text alone. Labelled rows are a bounded sample (``most_rows``, by a hash of text
and label); the normal equations are summed in each partition and added up, the scores are calibrated on the rows that
a hash keeps apart. Everything else covers all rows.

Null text: the empty text, which is scored like any other. Null or other labels than 0 and 1: left out. Null doc_id:
joins no label, not held out. Repeated rows: each is scored, and learned from. No labelled rows: every score is 1, since
nothing speaks against any text; with one class only, the scores are that class. Very long texts: whole, like any other. Ties: equal texts score alike. No documents: no rows. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.cut import written
from webloom.llm.words import by_size, utf8

_CLASS = np.full(256, 9)
_CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0
_CLASS[range(0x41, 0x5B)] = 1
_CLASS[range(0x30, 0x3A)] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 5
_CLASS[[ord(c) for c in "#$%&*@^~"]] = 6
_CLASS[[ord(c) for c in "!?"]] = 7
_CLASS[[ord(c) for c in "|<>{}[]()\\/=_+"]] = 8
N_FEATURES = 19
THRESHOLD = 0.7


def statistics(data: bytes) -> np.ndarray:
    """The statistics of one text."""
    n = len(data)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=10)
    words, lines = data.split(), data.split(b"\n")
    distinct = len(set(words))
    p = counts[counts > 0] / max(n, 1)
    letters = kinds[0] + kinds[1]
    return np.array(
        [
            np.log1p(n),
            *(kinds[:10] / max(n, 1)),
            kinds[1] / max(letters, 1),
            np.log1p(letters / max(len(words), 1)),
            np.log1p(n / max(len(words), 1)),
            distinct / max(len(words), 1),
            len(set(lines)) / len(lines),
            np.log1p(len(words) / max(distinct, 1)),
            -(p * np.log(p)).sum(),
            np.log1p(len(words) / len(lines)),
        ]
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the text as an array, for every row of docs (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            x = np.concatenate([statistics(utf8(t)) for t in batch.column(1).to_pylist()])
            rows = pa.ListArray.from_arrays(np.arange(0, len(x) + 1, N_FEATURES, dtype=np.int32), x)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Model:
    """Random Fourier features of standardised statistics, ridge weights, and the calibrating steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, width: float, features: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.directions = draw.normal(0, 1 / width, (len(mean), features))
        self.phase = draw.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps: tuple[np.ndarray, np.ndarray] = np.zeros(1), np.ones(1)

    def spectrum(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.spread, -8, 8) @ self.directions + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.spectrum(x[a : a + 4096]) @ self.weights for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the rising steps with the least squared error (pool adjacent violators)."""
    places, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []
    for p, total, n in zip(places, np.bincount(at, weights=y), np.bincount(at), strict=True):
        pools.append([total, float(n), p * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p / n for _, n, p in pools]), np.array([t / n for t, n, _ in pools])


def _matrix(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    return np.asarray(pc.list_flatten(batch.column(column)), dtype=np.float64).reshape(-1, N_FEATURES)


def fit(labelled: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-3, most_rows: int = 40_000, seed: int = 7, tasks: int = 8) -> Model | None:
    """A model of (x, label) rows; None without any. Each task sends one matrix of features x features to the driver."""
    rows = labelled.where("label in (0, 1)").select("x", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64(F.lit(seed), "x"), F.lit(1 << 30)).alias("u"))
    rows = written(rows, "quality-rows")
    n = rows.count()
    if not n:
        return None
    rows = rows.where(F.col("u") < int((1 << 30) * min(1.0, most_rows / n))).withColumn("apart", F.pmod("u", F.lit(5)) == 0).coalesce(tasks)
    if not rows.where("not apart").limit(1).count():
        rows = rows.withColumn("apart", F.lit(False))
    moments = rows.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(N_FEATURES)]).collect()[0]
    if moments[0] is None:
        return None
    spread = np.array([v if v > 1e-9 else 1.0 for v in moments[N_FEATURES:]])
    model = Model(np.array(moments[:N_FEATURES]), spread, width, features, seed)
    size = features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z = model.spectrum(_matrix(batch, "x"))
            gram += z.T @ z
            right += z.T @ np.asarray(batch.column("label"))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gram.ravel(), right]).tobytes()], pa.binary())], ["sums"])

    total = sum((np.frombuffer(r[0]) for r in rows.where("not apart").select("x", "label").mapInArrow(sums, "sums binary").collect()), np.zeros(size * size + size))
    gram, right = total[: size * size].reshape(size, size), total[size * size :]
    model.weights = np.linalg.solve(gram + ridge * max(1.0, gram[-1, -1]) * np.diag([*np.ones(features) / features, 1e-9]), right)
    held = rows.where("apart").select("x", "label").toArrow()
    if not held.num_rows:
        held = rows.select("x", "label").toArrow()
    model.steps = isotonic(model.raw(_matrix(held.combine_chunks(), "x")), np.asarray(held["label"]))
    return model


def scored(statistics_rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score for every row of (doc_id, x)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x) if model else np.ones(len(x)))], ["doc_id", "score"])

    return statistics_rows.select("doc_id", "x").mapInArrow(work, f"doc_id {statistics_rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def learned(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model | None]:
    """The statistics of docs (doc_id, text), written, and the model of those that labels (doc_id, label) label and no fold holds out."""
    rows = written(with_statistics(docs), "quality-statistics")
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("of"), "label")
    return rows, fit(rows.join(known, F.col("doc_id") == F.col("of")).select("x", "label"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text); labels: (doc_id, label)."""
    rows, model = learned(docs, labels)
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text is predicted 1. Only texts go to Python; no row is shuffled."""
    _, model = learned(docs.select("doc_id", "text"), labels)

    def work(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.ones(len(texts)))
        return pa.array(model.score(np.array([statistics(utf8(t.as_py())) for t in texts]).reshape(-1, N_FEATURES)))

    return docs.where(F.arrow_udf(work, "double")(docs["text"]) >= threshold)
