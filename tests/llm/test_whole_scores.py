"""Scores of the classifiers from texts and labels alone, by plain programs that share no function with them."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pairforge.llm import quality, toxicity
from pairforge.llm import queries as q
from tests.llm.conftest import prose


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(r.doc_id, r.text) for r in q.documents(spark, data).select("doc_id", "text").collect()]
    rows += [(10_001, prose(60_000, 3)), (10_002, ""), (10_003, None), (10_004, "Ünï 12 !!! ??? | $$$ A"), (None, "no id")]
    labels = {r.doc_id: (r.quality, r.toxic) for r in q.labels(spark, data).collect()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return rows, labels, docs, q.labels(spark, data)


def statistics(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 24
    n = len(raw)
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"-()", b"!", b"?", b"|", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256))]
    out = [sum(b in k for b in raw) / n for k in kinds]
    out.append(-sum(c / n * math.log(c / n) for c in Counter(raw).values()))
    words = raw.split()
    m = max(len(words), 1)
    often = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    out += [math.log1p(n), math.log1p(len(words)), math.log1p(sum(map(len, words)) / m), len(often) / m, max(often.values(), default=0) / m, math.log1p(max(map(len, words), default=0))]
    out += [math.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), math.log1p(m / max(len(lines), 1)), sum(b in b".!?" for b in raw) / m]
    ends = [w[-1] for w in words]
    out += [sum(w.isupper() for w in words) / m, sum(e < 128 and not bytes([e]).isalnum() for e in ends) / m, sum(w.isdigit() for w in words) / m]
    return out


def brute_quality(rows, labels):
    stats = {i: statistics(t) for i, t in rows}
    train = [(stats[i], y) for i, (y, _) in labels.items() if i in stats and y is not None and not held_out(i)]
    x, y = np.array([s for s, _ in train]), np.array([y for _, y in train], float)
    mean, spread = x.mean(0), x.std(0)
    spread[spread <= 1e-9] = 1
    rng = np.random.default_rng(7)
    directions, phases = rng.normal(0, 1 / 3.0, (24, 160)), rng.uniform(0, 2 * np.pi, 160)

    def features(row):
        z = np.minimum(np.maximum((np.array(row) - mean) / spread, -6), 6)
        return np.append([math.cos(sum(a * b for a, b in zip(z, directions[:, k])) + phases[k]) * math.sqrt(2 / 160) for k in range(160)], 1.0)

    z = np.array([features(s) for s, _ in train])
    w = np.linalg.solve(z.T @ z + 1e-3 * len(y) * np.eye(161), z.T @ y)
    bins = {}
    for row, label in zip(z, y):
        raw = float(row @ w)
        bins.setdefault(math.floor(min(max(raw, -0.5), 1.4999) * 200), []).append((raw, label))
    points = sorted((sum(r for r, _ in b) / len(b), sum(v for _, v in b) / len(b), len(b)) for b in bins.values())
    # isotonic: for each point the largest of the least means of what ends, and begins, there
    fitted = [max(min(sum(p[1] * p[2] for p in points[a : b + 1]) / sum(p[2] for p in points[a : b + 1]) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
    return {i: min(max(float(np.interp(float(features(s) @ w), [p[0] for p in points], fitted)), 0), 1) for i, s in stats.items()}


def test_quality(table):
    rows, labels, docs, label_rows = table
    want = brute_quality(rows, labels)
    got = {r.doc_id: r for r in quality.score(docs, label_rows).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].score == pytest.approx(want[i], abs=1e-6), i
        assert got[i].held_out == held_out(i) and got[i].predicted == int(got[i].score >= 0.3)


def brute_toxicity(rows, labels):
    identity = toxicity.IDENTITY_TERMS

    def features(text):
        words = set(re.findall(r"\w+", (text or "").lower()))
        return words | {w[:n] + "*" for w in words for n in (4, 5, 6, 7) if len(w) > n}

    texts = dict(rows)
    train = [(texts[i], y) for i, (_, y) in labels.items() if i in texts and y is not None and not held_out(i)]
    counts = [Counter(), Counter()]
    for t, y in train:
        counts[y].update(features(t))
    n = [sum(y == k for _, y in train) + 1.0 for k in (0, 1)]
    z = {}
    for term in counts[0] | counts[1]:
        a, b = (c[term] for c in counts)
        if a + b >= 4:
            a, b = a + 0.5, b + 0.5
            z[term] = abs((math.log(b / (n[1] - b + 0.5)) - math.log(a / (n[0] - a + 0.5))) / math.sqrt(1 / b + 1 / a))
    vocabulary = [t for t, _ in sorted(z.items(), key=lambda x: (-x[1], x[0]))[:3000]]
    at = {t: i for i, t in enumerate(vocabulary)}
    x = np.zeros((len(train), len(vocabulary)))
    for k, (t, _) in enumerate(train):
        x[k, [at[f] for f in features(t) if f in at]] = 1
    y = np.array([y for _, y in train], float)
    changes, weight = [], []
    for t, _ in train:
        found = []
        for sentence in re.split(r"[.!?\n]+", t or ""):
            words = set(re.findall(r"\w+", sentence.lower()))
            for term in words & set(identity):
                other = identity[(identity.index(term) + 1) % len(identity)]
                row = np.zeros(len(vocabulary))
                after, before = features(" ".join(words - {term} | {other})), features(" ".join(words))
                row[[at[f] for f in after - before if f in at]] = 1
                row[[at[f] for f in before - after if f in at]] = -1
                found.append(row)
        changes += [r for r in found if r.any()]
        weight += [1 / len(found) for r in found if r.any()]
    for term in identity:
        row = np.zeros(len(vocabulary))
        row[[at[f] for f in features(term) if f in at]] = 1
        if row.any():
            changes.append(row)
            weight.append(1.0)
    d, weight = np.array(changes), np.array(weight)
    w, b = np.zeros(len(vocabulary)), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    theta = np.append(w, b)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 401):  # Adam
        w, b = theta[:-1], theta[-1]
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40)))
        g = x.T @ (p - y) / len(y) + 0.3 * w / len(y)
        if len(d):
            g = g + d.T @ (weight * (d @ w)) / weight.sum()
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        theta = theta - 0.1 * (1 - step / 401) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    known = dict(zip(vocabulary, theta[:-1]))
    return {i: 1 / (1 + math.exp(-min(max(theta[-1] + sum(known.get(f, 0.0) for f in features(t)), -40), 40))) for i, t in rows}


def test_toxicity(table):
    rows, labels, docs, label_rows = table
    want = brute_toxicity(rows, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, label_rows).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].score == pytest.approx(want[i], abs=2e-3), i
        assert got[i].held_out == held_out(i) and got[i].predicted == int(got[i].score >= 0.5)
