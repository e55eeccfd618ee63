"""Vector codes against plain Lloyd rounds in Python's whole numbers."""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from pairforge.llm import codes
from pairforge.llm import queries as q

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=16, entries=64, rounds=2, factor=256):
    kept = [(i, [floor(Fraction(x) * factor) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    out, digests = [], {}
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        at = codes.cuts(dim, parts)
        cut = [[v[at[p] : at[p + 1]] for p in range(parts)] for _, v, _ in own]
        books = [[c[p] for c in cut[:entries]] for p in range(parts)]

        def nearest(p, x, books=books):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

        for _ in range(rounds):
            for p in range(parts):
                groups = {}
                for c in cut:
                    groups.setdefault(nearest(p, c[p])[1], []).append(c[p])
                for k, xs in groups.items():
                    books[p][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
        digests[dim] = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
        for (i, _, lab), c in zip(own, cut, strict=True):
            found = [nearest(p, c[p]) for p in range(parts)]
            out.append((i, lab, dim, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), 2**63 - 1)))
    sums = {}
    for _, lab, _, _, e in out:
        sums[lab] = sums.get(lab, 0) + e
    return sorted(((i, code, e, min(sums[lab], 2**63 - 1), digests[dim]) for i, lab, dim, code, e in out), key=str)


def edge(dim, n, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in v], int(i) % 3 if i % 5 else None) for i, v in enumerate(rng.normal(0, scale, (n, dim)))]
    rows += [(7, [0.5] * dim, 1)] * 40  # a very common vector, with an id that another row has
    rows += [(None, [0.25] * dim, None), (n + 1, None, 1), (n + 2, [float("nan")] + [0.0] * (dim - 1), 1), (n + 3, [None] * dim, 2), (n + 4, [float("-inf")] * dim, 2)]
    return rows


@pytest.mark.parametrize("dim,n,scale,shard", [(32, 300, 1.0, 50), (16, 120, 1e12, 8192), (20, 150, 0.01, 64), (3, 90, 5.0, 17), (16, 30, 1.0, 8192), (8, 60, 1e200, 16)])
def test_brute(spark, dim, n, scale, shard):
    rows = edge(dim, n, dim + n, scale)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as code", "1 as q", "2 as error", "3 as _label").repartition(3)
    got = codes.report(*codes.compress(df, shard=shard))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_lengths_and_text_ids(spark):
    rows = edge(16, 40, 1) + edge(5, 70, 2) + [(1000, [], 4), (1001, [], 4)]
    got = codes.report(*codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(2), shard=32))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    named = spark.createDataFrame([(f"v{i:03d}", v, None) for i, v, _ in edge(16, 40, 1) if i is not None], "vec_id string, embedding array<float>, label string")
    assert {r.vec_id[0] for r in codes.compress(named)[0].collect()} == {"v"}
    assert codes.report(*codes.compress(spark.createDataFrame([], SCHEMA))).collect() == []


def test_decode_and_rounds(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    errors = []
    for rounds in (0, 1, 4):
        coded, books = codes.compress(df, rounds=rounds)
        found = coded.collect()
        errors.append(sum(r.error for r in found))
        vectors = {r.vec_id: r.embedding for r in df.collect()}
        for r in found[:50]:
            x = [floor(256 * v) for v in vectors[r.vec_id]]
            assert sum((a - b) ** 2 for a, b in zip(x, books.decode(r.dim, r.code), strict=True)) == r.error
    assert errors[0] > errors[1] > errors[2]
    with pytest.raises(ValueError):
        codes.compress(df, entries=257)


def test_subtrees_are_assigned_at_once():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 2, (256, 2)) for c in ((0, 0), (1000, 0), (0, 1000), (1000, 1000))]).round().astype(np.int64)[None]
    order = codes.tree_order(points, 64)
    trees = codes.Forest(np.take_along_axis(points, order[:, :, None], 1), np.ones((1, 1024), bool), 64)
    met = []
    trees._leaves = lambda *a: met.append(a)
    _, sums, counts = trees.assign(np.array([[[0, 0], [1000, 0], [0, 1000], [1000, 1000]]]))
    assert not met and counts.tolist() == [[256] * 4] and sums.sum() == points.sum()


def test_query(spark, data):
    import duckdb

    df = q.op13_vector_codes(spark, data)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(f"SELECT {','.join(df.columns)} FROM ({q.ORACLE_SQL['op13_vector_codes']})").fetchall())
