"""Quality scores from document statistics.

Random Fourier features approximate a Gaussian kernel over the standardised statistics; each
partition of the labelled sample sums its part of the normal equations, and their total gives ridge
weights. An isotonic fit on rows the ridge hasn't seen turns its scores into rates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.training import byte_counts, isotonic, per_text, sample
from assay.llm.words import NOT_SPACE, Words, inside, slices, window_hashes

#: random features, kernel width in units of the root of the number of statistics, ridge penalty
FEATURES, WIDTH, RIDGE, SEED, PARTS = 256, 1.0, 1e-3, 7, 8

_letters = [*range(65, 91), *range(97, 123), *range(128, 256)]
_classes = {
    "letters": _letters, "upper": list(range(65, 91)), "digits": list(range(48, 58)), "blank": [32, 9],
    "ends": list(b".?"), "bang": list(b"!"), "commas": list(b",;:"), "symbols": list(b"#$%&*+/<=>@\\^_`{|}~"), "brackets": list(b"()[]\"'-"),
}
_table = np.zeros((256, len(_classes)))
for _i, _b in enumerate(_classes.values()):
    _table[_b, _i] = 1


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row for each text; zeros for null and empty texts."""
    n = len(texts)
    w = Words(texts, NOT_SPACE, lower=True)
    size = (np.diff(w.at) - 1).astype(float)
    n_words = np.diff(w.first).astype(float)
    some, chars = np.maximum(n_words, 1), np.maximum(size, 1)
    shares = byte_counts(w, n) @ _table / chars[:, None]
    wh = w.hashes()
    doc = np.repeat(np.arange(n), np.diff(w.first))
    length = (w.end - w.start).astype(float)

    def distinct(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        order = np.lexsort((hashes, docs))
        d, h = docs[order], hashes[order]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
        return np.bincount(d[new], minlength=n).astype(float)

    runs = []
    for k in (1, 5):
        h = wh if k == 1 else window_hashes(wh, k)
        ok = inside(w.first, k, len(h))
        d = doc[:len(h)][ok]
        runs.append(np.where(np.bincount(d, minlength=n) > 0, distinct(d, h[ok]) / np.maximum(np.bincount(d, minlength=n), 1), 1.0))
    same = np.zeros(len(wh))
    same[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
    first_byte = w.buf[w.start] if len(w.start) else np.zeros(0, dtype=np.uint8)
    last_byte = w.buf[w.end - 1] if len(w.end) else first_byte
    odd_end = (last_byte < 128) & ~((last_byte >= 97) & (last_byte <= 122)) & ~np.isin(last_byte, list(b".,"))
    odd_start = (first_byte < 128) & ~((first_byte >= 97) & (first_byte <= 122))
    lines = per_text(w.buf == 10, w.at) + 1
    mean = per_text(length, w.first) / some
    spread = np.sqrt(np.maximum(per_text(length ** 2, w.first) / some - mean ** 2, 0))
    rows = [np.log1p(size), np.log1p(n_words), mean, spread, runs[0], runs[1], per_text(same, w.first) / some,
            per_text(odd_end, w.first) / some, per_text(odd_start, w.first) / some, per_text(length <= 1, w.first) / some,
            per_text(length <= 3, w.first) / some, np.log1p(n_words / lines), *shares.T]
    out = np.stack(rows, axis=1)
    out[size == 0] = 0
    return out


@dataclass
class QualityModel:
    """``base`` alone, if nothing could be learned."""

    base: float
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        d = stats.shape[1]
        freq = rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, FEATURES // 2))
        at = np.clip((stats - self.centre) / self.scale, -8, 8) @ freq
        z = np.sqrt(2 / FEATURES) * np.concatenate([np.cos(at), np.sin(at)], axis=1)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.base)
        out = self.ridge(stats)
        return np.interp(out, *self.steps).clip(0, 1) if self.steps else out.clip(0, 1)


def _stats_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(0)).fill_null(0).to_pylist()):
                x = statistics(batch.column(0)[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)[lo:hi], batch.column(2)[lo:hi]], ["x", "label", "part"])

    return rows.select("_t", "label", "part").mapInArrow(run, "x array<double>, label double, part long")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> QualityModel:
    """Fit on at most ``training.SAMPLE_ROWS`` labelled rows: parts 0-6 the ridge, 7-9 the calibration.
    With fewer than 20 rows or one class, the model is the mean label (0.5 without any)."""
    rows = _stats_of(sample(docs, labels, label, text, doc_id)).repartition(PARTS).cache()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, y = _matrix(batch)
            if len(x):
                one = np.concatenate([[len(x), y.sum()], x.sum(axis=0), (x ** 2).sum(axis=0)])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = [np.frombuffer(r.m) for r in rows.mapInArrow(moments, "m binary").collect()]  # PARTS rows
    n, ones = (sum(p[0] for p in parts), sum(p[1] for p in parts)) if parts else (0, 0)
    if n < 20 or ones in (0, n):
        return QualityModel(float(ones / n) if n else 0.5)
    d = (len(parts[0]) - 2) // 2
    mean = sum(p[2:2 + d] for p in parts) / n
    sd = np.sqrt(np.maximum(sum(p[2 + d:] for p in parts) / n - mean ** 2, 0))
    model = QualityModel(float(ones / n), mean, np.where(sd > 1e-9, sd, 1.0))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x, y = _matrix(batch)
            if len(x):
                z = model.features(x)
                total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    got = rows.where("part < 7").mapInArrow(normal, "m binary").collect()  # PARTS matrices of fixed size
    total = sum(np.frombuffer(r.m).reshape(FEATURES + 1, FEATURES + 2) for r in got)
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, total[:, -1])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch)
            yield pa.RecordBatch.from_arrays([pa.array(model.ridge(x) if len(x) else np.zeros(0)), pa.array(y)], ["s", "label"])

    held = rows.where("part >= 7").mapInArrow(apply, "s double, label double")
    if not held.isEmpty():
        model.steps = isotonic(held, "s")
    rows.unpersist()
    return model


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(batch.column(0).to_pylist(), dtype=float)
    return x, batch.column(1).to_numpy(zero_copy_only=False)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Every row with its score: ``row`` (a struct of its columns), ``score`` from 0 to 1.

    Null and empty texts have statistics of zero and are scored like others; rows are independent, so
    repeated rows and rows without an id are scored too. An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                s = sent.value.score(statistics(batch.column(1)[lo:hi].to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(s)], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").cast("binary").alias("_t"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
