"""Language identification from character trigrams of labelled texts.

Texts are small letters in runs: ASCII letters and all bytes of other scripts count,
everything else is a gap. Trigrams of these classes are hashed to a fixed number of
buckets. Every partition counts the buckets of each language, Spark adds the counts
up, and the driver gets one row of counts for each language, of a fixed length. A text's
score for a language is its mean log-likelihood for a trigram, with one added to each
count; where the best language leads the second by less than a margin, or a text
has too few trigrams, the language is unknown (null).

A null text is empty; rows without a text or a language teach nothing; ties go to the
language that is first by name; without labelled rows every language is unknown.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Buckets; least lead in nats for a trigram; least trigrams of a text that is judged.
BUCKETS, MARGIN, LEAST = 1 << 16, 0.05, 3

#: Classes of bytes: 0 is a gap, then the letters, then the bytes of other scripts.
_CLASS = np.zeros(256, np.uint32)
for _b in range(26):
    _CLASS[65 + _b] = _CLASS[97 + _b] = 1 + _b
_CLASS[128:] = 27 + np.arange(128)


def trigrams(raw: bytes) -> np.ndarray:
    """The buckets of all trigrams, without those that are mostly gap."""
    kinds = _CLASS[np.frombuffer(b" " + raw + b" ", np.uint8)]
    kinds = kinds[np.append(True, (kinds[1:] != 0) | (kinds[:-1] != 0))]  # one gap for a run of them
    if len(kinds) < 3:
        return np.zeros(0, np.int64)
    mixed = (kinds[:-2] * np.uint32(155 * 155) + kinds[1:-1] * np.uint32(155) + kinds[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(16)).astype(np.int64)


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray
    """(languages, buckets) log-likelihoods."""

    def scores(self, raw: bytes) -> np.ndarray:
        """Mean log-likelihoods for a trigram, in the order of the names."""
        found = trigrams(raw)
        return self.logs[:, found].mean(1) if len(found) else np.zeros(len(self.names))

    def detect(self, raw: bytes, margin: float = MARGIN) -> tuple[str | None, float]:
        """The language (or None) and by how much it leads."""
        if not self.names or len(trigrams(raw)) < LEAST:
            return None, 0.0
        scores = self.scores(raw)
        best = int(scores.argmax())
        lead = float(scores[best] - np.delete(scores, best).max(initial=-np.inf))
        return (self.names[best] if lead >= margin else None), (lead if np.isfinite(lead) else 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Counts of all labelled rows, summed by partition and then by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))
        for batch in batches:
            for t, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[name] += np.bincount(trigrams(t.encode()), minlength=BUCKETS)
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["name", "bucket", "n"])

    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")).dropna()
    summed = rows.mapInArrow(counted, "name string, bucket long, n long").groupBy("name", "bucket").agg(F.sum("n").alias("n"))
    by_name = summed.groupBy("name").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("name").collect()
    logs = np.zeros((len(by_name), BUCKETS))
    for i, r in enumerate(by_name):
        logs[i, r.bucket] = r.n
        logs[i] = np.log((logs[i] + 1) / (logs[i].sum() + BUCKETS))
    return Languages([r.name for r in by_name], logs.astype(np.float32))


def detected(df: DataFrame, model: Languages, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add ``language`` and ``lead``."""
    shared = df.sparkSession.sparkContext.broadcast((model.names, model.logs))
    kept = df.drop("language", "lead")
    at = kept.columns.index(text)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Languages(*shared.value)
        for batch in batches:
            found = [own.detect((t or "").encode(), margin) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*batch.schema.names, "language", "lead"])

    return kept.mapInArrow(mapped, StructType([*kept.schema.fields, StructField("language", StringType()), StructField("lead", DoubleType())]))


def language_match(expected: str, text: str = "text", language: str = "language") -> F.Column:
    """False for texts below three characters, true where the language is unknown; informative only."""
    short = F.coalesce(F.length(F.trim(F.col(f"`{text}`"))), F.lit(0)) < 3
    return F.when(short, F.lit(False)).otherwise(F.coalesce(F.col(language) == F.col(f"`{expected}`"), F.lit(True)))
