"""Toxicity: a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings that go with the label
in the training rows. Besides the logistic loss the fit penalises how much the
score changes when an identity term of a labelled sentence is swapped for
another, or stands in a sentence at all: for a linear score that is a quadratic
form in the differences of the two feature rows. Group mentions thereby carry no
weight of their own, which keeps neutral sentences about groups from being marked.

The fit uses a bounded sample of the labelled rows (``SAMPLE`` documents, chosen by
a hash of their id), so what reaches the driver has a fixed bound; every whole
text is scored.

Defined cases: a null text is the empty text and gets the model's base score;
repeated rows score alike; without labelled rows of both classes every score is
0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.labels import held_out, training_labels
from pairforge.llm.storage import working, written

#: Labelled documents that the fit uses at most, at about; features; documents a feature is in at least.
SAMPLE, TERMS, LEAST = 20_000, 3000, 4
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)
L2, COUNTERFACTUAL, STEPS = 0.3, 1.0, 400

#: Fixed value: identity terms that are swapped for one another.
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews hindus buddhists atheists gay lesbian straight bisexual transgender black white asian latino arab "
    "african european american chinese mexican immigrants refugees natives disabled blind deaf elderly young poor rich"
).split()

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def terms_of(word: str) -> list[str]:
    """A word's features: itself, and its beginnings marked with a star."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


def terms(text: str | None) -> set[str]:
    return {t for w in words_of(text) for t in terms_of(w)}


@dataclass
class Toxicity:
    weights: dict[str, float]
    bias: float
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        known, weights = self._known, self.weights
        if len(known) > 200_000:
            known.clear()
        found: set[str] = set()
        for word in words_of(text):
            got = known.get(word)
            if got is None:
                got = known[word] = tuple(t for t in terms_of(word) if t in weights)
            if got:
                found.update(got)
        total = self.bias + sum(weights[t] for t in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "_known": {}}


def _sample(df: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    """(text, label) of about ``SAMPLE`` labelled rows at most, by a hash of the id."""
    count = labels.count()
    share = min(1.0, SAMPLE / max(count, 1))
    some = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return df.select("doc_id", F.col(text).alias("text")).join(some, "doc_id").select("text", "label")


def _associated(sample: DataFrame, n_terms: int) -> list[str]:
    """The terms whose log odds of the label stand out most, by their z score."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def rows() -> pa.RecordBatch:
            keys = list(got[0].keys() | got[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([got[0][k] for k in keys], pa.int64()), pa.array([got[1][k] for k in keys], pa.int64())], names=["term", "no", "yes"])
            got[0].clear()
            got[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got[label].update(terms(text))
                if len(got[0]) + len(got[1]) > 500_000:
                    yield rows()
        yield rows()

    sums = sample.mapInArrow(counted, "term string, no long, yes long").groupBy("term").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).filter(F.col("no") + F.col("yes") >= LEAST)
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    no, yes, n0, n1 = F.col("no") + 0.5, F.col("yes") + 0.5, F.lit(n.get(0, 0) + 1.0), F.lit(n.get(1, 0) + 1.0)
    odds = F.log(yes / (n1 - yes + 0.5)) - F.log(no / (n0 - no + 0.5))
    z = odds / F.sqrt(1 / yes + 1 / no)
    return [r.term for r in sums.orderBy(F.desc(F.abs(z)), "term").limit(n_terms).select("term").collect()]


def _swapped(text: str, identity: Sequence[str]) -> list[set[str]]:
    """Term sets of the sentences with an identity term, each with one swapped for another."""
    out = []
    place = {t: i for i, t in enumerate(identity)}
    for sentence in re.split(r"[.!?\n]+", text):
        words = words_of(sentence)
        for term in sorted(words & place.keys()):
            other = identity[(place[term] + 1) % len(identity)]
            before = {t for w in words for t in terms_of(w)}
            after = {t for w in words - {term} | {other} for t in terms_of(w)}
            out.append((before, after))
    return out


def fit(df: DataFrame, labels: DataFrame, text: str = "text", identity: Sequence[str] = IDENTITY_TERMS) -> Toxicity | None:
    """Fit on a bounded sample of (doc_id, label) rows."""
    sample = written(_sample(df, labels, text), "toxicity_sample")
    if sample.select("label").distinct().count() < 2:
        return None
    vocabulary = _associated(sample, TERMS)
    index = {t: i for i, t in enumerate(vocabulary)}

    def signed(before: set[str], after: set[str]) -> list[int]:
        """Gained terms as they are, lost ones as -1 - number."""
        return sorted([index[t] for t in after - before if t in index] + [-1 - index[t] for t in before - after if t in index])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(index[t] for t in terms(value) if t in index) for value in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(1).cast(pa.int32())], names=["x", "y"])

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All swapped sentences as what they change; those of one document weigh one together."""
        weights: Counter[tuple[int, ...]] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found = [tuple(signed(a, b)) for a, b in _swapped(value or "", identity)]
                for change, n in Counter(found).items():
                    weights[change] += n / len(found)
        weights.pop((), None)
        yield pa.RecordBatch.from_arrays([pa.array(map(list, weights), pa.list_(pa.int32())), pa.array(list(weights.values()), pa.float64())], names=["change", "weight"])

    got = sample.mapInArrow(featured, "x array<int>, y int").toArrow().to_pydict()
    # a change is a few terms of two identity terms, so that equal ones are added up and few are left
    swaps = sample.mapInArrow(changes, "change array<int>, weight double").groupBy("change").agg(F.sum("weight").alias("weight")).orderBy("change").collect()
    # every identity term by itself, against a sentence without it
    alone = [p for p in ([index[t] for t in terms_of(term) if t in index] for term in identity) if p]
    pairs, weight = [r.change for r in swaps] + alone, np.array([r.weight for r in swaps] + [1.0] * len(alone))
    weights, bias = _solve(got["x"], np.array(got["y"], float), pairs, len(vocabulary), weight)
    return Toxicity({t: float(w) for t, w in zip(vocabulary, weights, strict=True) if abs(w) > 1e-6}, bias)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows)), sizes), np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))


def _solve(rows: list[list[int]], y: np.ndarray, pairs: list[list[int]], n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Minimise the mean logistic loss + L2 + the counterfactual penalty, by Adam on the whole sample."""
    weight = np.ones(len(pairs)) if weight is None else weight
    at, which = _flat(rows)
    pair_at, signed = _flat(pairs)
    sign = np.where(signed >= 0, 1.0, -1.0)
    changed = np.where(signed >= 0, signed, -1 - signed)
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(at, w[which], len(y)), -40, 40)))
        g = np.bincount(which, (p - y)[at], n) / len(y) + L2 * w / len(y)
        if len(pairs):
            change = np.bincount(pair_at, sign * w[changed], len(pairs))
            g += COUNTERFACTUAL * np.bincount(changed, sign * (weight * change)[pair_at], n) / weight.sum()
        gb = float((p - y).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - step / (STEPS + 1))
        w -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate * mb / (1 - 0.9**step) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, b


def score(df: DataFrame, labels: DataFrame, column: str = "toxic", text: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every whole text."""
    model = fit(df, training_labels(labels, column), text)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity")
        for batch in batches:
            got = [model.score(t) if model else 0.0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])

    kind = df.schema["doc_id"].dataType.simpleString()
    scored = df.select("doc_id", F.col(text)).mapInArrow(mapped, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
