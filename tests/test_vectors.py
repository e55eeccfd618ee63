"""Word vectors against numpy on small tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from pairforge.operators import vectors

TEXTS = ["The cat sat on the mat.", "The dog sat on the log", "a cat and a dog", "the mat and the log", None, "", "cat dog cat dog é ünï", "one", "the cat, the dog; the mat on the log and a cat"]


def brute_ppmi(texts, window, least):
    listed = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    known = sorted(w for w, c in Counter(w for ws in listed for w in ws).items() if c >= least)
    at = {w: i for i, w in enumerate(known)}
    n = np.zeros((len(known), len(known)))
    for ws in listed:
        for i, a in enumerate(ws):
            for b in ws[i + 1 : i + 1 + window]:
                if a in at and b in at:
                    n[at[a], at[b]] += 1
                    n[at[b], at[a]] += 1
    m = n.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.log(n * n.sum() / np.outer(m, m))
    return known, np.where(np.isfinite(v) & (v > 0), v, 0.0)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "id int, text string, word string").repartition(3)


@pytest.mark.parametrize("window,least", [(1, 1), (2, 2), (4, 1)])
def test_ppmi(corpus, window, least):
    known, want = brute_ppmi(TEXTS, window, least)
    got = np.zeros_like(want)
    for r in vectors.ppmi(vectors.cooccurrences(corpus, window=window, least=least)).collect():
        got[known.index(r.a), known.index(r.b)] = r.v
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("width,extra,powers", [(20, 0, 0), (3, 6, 6)])
def test_factored(spark, corpus, width, extra, powers):
    """Products of vectors are those of the matrix's strongest directions."""
    known, m = brute_ppmi(TEXTS, 4, 1)
    matrix = vectors.ppmi(vectors.cooccurrences(corpus, window=4, least=1))
    got = {r.word: np.array(r.vector) for r in vectors.factored(matrix, width, extra, powers).collect()}
    values, directions = np.linalg.eigh(m @ m)
    best = np.argsort(-values)[: min(width, len(known))]
    want = directions[:, best] * np.sqrt(np.sqrt(np.maximum(values[best], 0)))
    have = np.array([got.get(w, np.zeros(len(next(iter(got.values()))))) for w in known])
    assert np.allclose(have @ have.T, want @ want.T, atol=1e-4)


def test_mentions(spark, corpus):
    found = vectors.word_vectors(corpus, width=6, least=1)
    of = {r.word: np.array(r.vector) for r in found.collect()}
    rows = [(1, "The cat sat", "Dog"), (2, "The cat sat", "CAT"), (3, "nothing known", "cat"), (4, "a cat", "unknown"), (5, "the dog sat on the log", "the mat"), (6, None, "cat"), (7, "cat", None), (8, "cat cat dog", "cat dog cat")]
    got = {r.id: r.similarity for r in vectors.mentions(spark.createDataFrame(rows, "id int, text string, entity string"), found, ["id"]).collect()}

    def cos(a, b):
        return float(a @ b / np.sqrt((a @ a) * (b @ b)))

    for i, text, entity in rows:
        t, e = ([of[w] for w in re.findall(r"[^\W_]+", (x or "").lower()) if w in of] for x in (text, entity))
        want = 0.0 if not t or not e else max(cos(x, e[0]) for x in t) if len((entity or "").split()) == 1 else cos(sum(t), sum(e))
        assert got[i] == pytest.approx(want, abs=1e-9), i
    assert got[2] == pytest.approx(1) and got[8] == pytest.approx(1)


def test_without_pairs(spark):
    assert vectors.word_vectors(spark.createDataFrame([("one",), (None,)], "text string")).collect() == []


def test_blocks(spark, monkeypatch):
    """Vectors do not depend on chunks, pieces, blocks and columns, and are those of the pairs as rows; scratch is small."""
    import random

    rng = random.Random(1)
    texts = [" ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["w1 w2 " * 50] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    pairs = vectors.factored(vectors.ppmi(vectors.cooccurrences(df)), 8, powers=1)
    want = {r.word: np.array(r.vector) for r in pairs.collect()}
    for name, value in {"CHUNK": 700, "PIECE": 64, "BLOCK": 900, "TOGETHER": 3}.items():
        monkeypatch.setattr(vectors, name, value)
    got = {r.word: np.array(r.vector) for r in vectors.word_vectors(df, width=8, powers=1).collect()}
    known, m = brute_ppmi(texts, vectors.WINDOW, vectors.LEAST)
    assert got.keys() == want.keys() == {w for w, row in zip(known, m, strict=True) if row.any()}
    a, b = (np.array([x[w] for w in sorted(got)]) for x in (got, want))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-8)
    rows = spark.createDataFrame([(i, t, "w1") for i, t in enumerate(texts)], "id int, text string, entity string")
    found = {r.id: r.similarity for r in vectors.mentions(rows, vectors.word_vectors(df, width=8, powers=1), ["id"]).collect()}
    assert len(found) == len(texts) and all(s == pytest.approx(1) for i, s in found.items() if "w1" in texts[i].split())


def test_pairs_before_the_shuffle(spark):
    """Equal pairs of a task travel once, under two numbers and one way round."""
    df = spark.createDataFrame([(i, "alpha beta gamma delta " * 50) for i in range(20)], "id int, text string").repartition(1)
    known, counted, _ = vectors._pair_counts(df, "text", 4, 2)
    assert known.count() == 4 and sum(len(r.a) for r in counted.collect()) == 10


def test_pairs_are_dealt_to_their_blocks_once(spark):
    """A product reads each block's pairs where they are; they travelled again for every few columns of each product."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(f"a{i % 7} b{i % 5} c{i % 3}",) for i in range(60)], "text string")
    known, counted, side = vectors._pair_counts(df, "text", 2, 2)
    thin = known.select("id", F.lit(10).cast("bigint").alias("m"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    plan = vectors._block_product(counted, thin, range(2), side, 100)._jdf.queryExecution().executedPlan().toString()
    pairs = plan[: plan.index("Bucketed: true")].rsplit("FlatMapCoGroupsInArrow", 1)[1]
    assert "Exchange" not in pairs, plan
    table = counted._written_as
    assert spark.catalog.tableExists(table)
    vectors.removed(counted)
    assert not spark.catalog.tableExists(table)
