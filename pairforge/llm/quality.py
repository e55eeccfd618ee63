"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each text gives a fixed row of statistics. Random Fourier features of the
standardised rows approximate a Gaussian kernel; every partition sums its normal
equations, Spark adds these up entry by entry, and the driver solves one system
of fixed size. The ridge scores are calibrated by isotonic regression over score
bins, again of a fixed number. Nothing that reaches the driver grows with the
data, so all labelled rows are learnt from.

Defined cases: a null text is the empty text, whose statistics are zeros;
repeated rows score alike; without any labelled row every score is 0.5; an empty
table gives an empty result; other columns are ignored by :func:`score` and kept by
:func:`keep_good`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.labels import held_out, training_labels
from pairforge.llm.storage import BROADCAST_ROWS, working, written

FEATURES, WIDTH, RIDGE, BINS, SEED = 160, 3.0, 1e-3, 400, 7
#: Partitions that send sums, each of some 26,000 numbers; a partition of any size is streamed.
SUMS = 256
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 10))
for _byte in range(256):
    _c = chr(_byte)
    for _k, _has in enumerate(("a" <= _c <= "z", "A" <= _c <= "Z", "0" <= _c <= "9", _c in " \t\n\r\x0b\x0c", _c in ".,;:'\"-()", _c == "!", _c in "?", _c in "|", _c in "#$%&*+/<=>@[\\]^_`{}~", _byte >= 128)):
        _CLASSES[_byte, _k] = _has
STATISTICS = 24


def statistics(text: str | None) -> np.ndarray:
    """The row of statistics of one whole text."""
    out = np.zeros(STATISTICS)
    raw = (text or "").encode()
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    out[:10] = share @ _CLASSES
    present = share[share > 0]
    out[10] = -(present * np.log(present)).sum()
    words = raw.split()
    n = max(len(words), 1)
    out[11] = np.log1p(len(raw))
    out[12] = np.log1p(len(words))
    out[13] = np.log1p(sum(map(len, words)) / n)
    often = Counter(words)
    out[14] = len(often) / n
    out[15] = max(often.values(), default=0) / n
    out[16] = np.log1p(max(map(len, often), default=0))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out[17] = np.log1p(len(lines))
    out[18] = 1 - len(set(lines)) / max(len(lines), 1)
    out[19] = np.log1p(n / max(len(lines), 1))
    out[20] = (counts[46] + counts[33] + counts[63]) / n
    out[21] = sum(w.isupper() for w in words) / n
    out[22] = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n
    out[23] = sum(w.isdigit() for w in words) / n
    return out


@dataclass
class Quality:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(rows), *self.knots), 0, 1)


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, STATISTICS)


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``stats`` of every whole text."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            stats = [statistics(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col(text)).mapInArrow(mapped, f"doc_id {kind}, stats array<double>")


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; returns interpolation knots."""
    blocks: list[list[float]] = []
    for xi, yi, wi in sorted(zip(x, y, weight, strict=True)):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    knots = [(at, b[0]) for b in blocks for at in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def fit(stats: DataFrame, labels: DataFrame) -> Quality | None:
    """Fit on all labelled rows that are not held out; ``labels`` has (doc_id, label)."""
    rows = written(stats.join(labels, "doc_id").select("stats", "label"), "quality_rows")
    moments = rows.select(F.count(F.lit(1)), *[f(F.col("stats")[i]) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    spread = np.array(moments[2::2], float)
    rng = np.random.default_rng(SEED)
    model = Quality(np.array(moments[1::2], float), np.where(spread > 1e-9, spread, 1.0), rng.normal(0, 1 / WIDTH, (STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5])))
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z, y = model.features(_rows(batch.column(0))), np.asarray(batch.column(1), float)
            left += z.T @ z
            right += z.T @ y
        flat = np.concatenate([left.ravel(), right])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    total = np.zeros(size * size + size)
    for r in rows.coalesce(SUMS).mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        total[r.i] = r.v
    left, right = total[: size * size].reshape(size, size), total[size * size :]
    model.weights = np.linalg.solve(left + RIDGE * moments[0] * np.eye(size), right)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_rows(batch.column(0)))
            bins = np.floor(np.clip(raw, -0.5, 1.4999) * BINS / 2)
            yield pa.RecordBatch.from_arrays([pa.array(bins.astype(np.int64)), pa.array(raw), batch.column(1).cast(pa.float64())], names=["bin", "raw", "y"])

    binned = rows.mapInArrow(scored, "bin long, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("w")).collect()
    model.knots = isotonic(*(np.array([r[k] for r in binned], float) for k in ("x", "y", "w")))
    return model


def score(df: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every text."""
    stats = written(measured(df), "quality_stats")
    model = fit(stats, training_labels(labels, column))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(_rows(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "score"])

    kind = df.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(mapped, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, column: str = "quality", text: str = "text") -> DataFrame:
    """The rows whose text is not rejected, with all of their columns."""
    known = written(training_labels(labels, column), "training_labels")
    some = df
    if known.count() <= BROADCAST_ROWS:  # few labels pick their texts before these are measured; many meet the narrow statistics
        some = df.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    model = fit(measured(some, text), known)
    if model is None:
        return df
    at = df.columns.index(text)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            if batch.num_rows:
                rows = np.stack([statistics(t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(rows) >= THRESHOLD))

    return df.mapInArrow(mapped, df.schema)
