"""Language-model scores against plain Python, and the levels of the trie."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairforge.llm import ngrams as m
from pairforge.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def quantised(x):
    return 2 ** (-min(65534, round(-m.STEPS * math.log2(x))) / m.STEPS)


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, N, base_score, score) of each (doc_id, text)."""
    texts = [(i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, tokens(t)) for i, t in rows]
    one = Counter(w for _, held, ws in texts if not held for w in ws)
    total, kinds = sum(one.values()), len(one)

    def contexts(ws):
        ws = [w if w in one else None for w in ws]
        padded = ["", "", *ws]
        return [(padded[k + 1], (padded[k], padded[k + 1]), w) for k, w in enumerate(ws)]

    after = [defaultdict(Counter), defaultdict(Counter)]
    for _, held, ws in texts:
        if not held:
            for v, uv, w in contexts(ws):
                after[0][v][w] += 1
                after[1][uv][w] += 1
    out = []
    for i, held, ws in texts:
        base = score = 0.0
        for raw, (v, uv, w) in zip(ws, contexts(ws), strict=True):
            p = (one[raw] + 0.1) / (total + 0.1 * (kinds + 1))
            base += math.log10(p)
            for seen in (after[0].get(v), after[1].get(uv)):
                if seen:
                    c = sum(seen.values())
                    p = (quantised((seen[w] - m.DISCOUNT) / c) if seen[w] else 0.0) + quantised(m.DISCOUNT * len(seen) / c) * p
            score += math.log10(p)
        out.append((i, held, len(ws), sum(one[w] > 0 for w in ws), total, base, score))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert [r[k] for r in got] == pytest.approx([r[k] for r in want], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("block,shard", [(m.BLOCK, m.SHARD), (300, 1000), (1, 1 << 40)])
def test_brute(spark, docs, rows, block, shard):
    same(m.score(docs, block=block, shard=shard).collect(), brute([(r[0], r[1]) for r in rows]))


def test_edges(spark, empty):
    assert m.score(empty).collect() == []
    same(m.score(spark.createDataFrame([(10, "a b"), (10, "A  b\n")], "doc_id long, text string")).collect(), brute([(10, "a b"), (10, "A  b\n")]))
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    unknown = [(held[0], "never seen words words"), (held[1], None)]
    got = m.score(spark.createDataFrame(unknown, "doc_id long, text string")).collect()
    assert [r.train_tokens for r in got] == [0, 0] and all(r.score == r.base_score == 0.0 for r in got)
    same(m.score(spark.createDataFrame([*unknown, (1, "seen words here")], "doc_id long, text string")).collect(), brute([*unknown, (1, "seen words here")]))
    named = m.score(spark.createDataFrame([("x", "a a a"), ("y", "a \u0085b É é")], "doc_id string, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in named} == {"x": 4, "y": 5}


def test_probabilities_add_up(spark):
    """Over all known words and one unknown one, up to the quantisation."""
    text = "a b a c a b b d"
    words = [*"abcd", "\n", "zz"]
    held = [i for i in range(5000) if zlib.crc32(str(i).encode()) % 10 == 0]
    # scores of 'a b w' differ by the share of w alone, as the text goes on with a word without successors
    rows = [(1, text), *((held[k], f"a b {w}") for k, w in enumerate(words) if w != "\n")]
    got = {r.doc_id: r for r in m.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert all(got[i].score == pytest.approx(want[i][6]) for i in want)
    one = Counter(tokens(text))
    n = sum(one.values())

    def share(seen, w, lower):
        c = sum(seen.values())
        return (max(seen[w] - 0.75, 0) + 0.75 * len(seen) * lower) / c

    uni = {w: (one[w] + 0.1) / (n + 0.1 * (len(one) + 1)) for w in words}
    assert sum(uni.values()) == pytest.approx(1)
    assert sum(share(Counter("abd"), w, uni[w]) for w in words) == pytest.approx(1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), min_size=1, max_size=300, unique=True), st.integers(1, 3))
def test_level(values, times):
    values = np.array(sorted(values)[::times], np.uint64)
    raw = m.level(values)
    held = m.Level(memoryview(raw))
    assert held.at(np.arange(len(values))[::-1]).tolist() == values.tolist()[::-1]
    asked = np.concatenate([values, values + np.uint64(1)])
    place = {int(v): i for i, v in enumerate(values)}
    assert held.find(asked).tolist() == [place.get(int(v), -1) for v in asked]


def test_level_is_compact():
    rng = np.random.default_rng(3)
    values = np.sort(rng.choice(1 << 27, 100_000, replace=False)).astype(np.uint64)
    raw = m.level(values)
    held = m.Level(memoryview(raw))
    assert held.at(np.arange(len(values))).tolist() == values.tolist()
    # low bits of the gap and two more: log2(2^27 / 10^5) + 2 is 12.4
    assert 8 * len(raw) / len(values) < 13


def test_trie():
    rng = np.random.default_rng(5)
    grams = sorted({tuple(int(x) for x in g) for g in (rng.zipf(1.3, (20_000, 3)) % 900)})
    many = rng.integers(1, 50, len(grams))
    root, middle, last = (np.array(c, np.uint32) for c in zip(*grams, strict=True))
    held = m.Trie(m.trie(root, middle, last, many))
    asked = np.concatenate([np.array(grams, np.uint32), rng.integers(0, 1000, (5000, 3)).astype(np.uint32)])
    share, left = held.ask(*asked.T)
    count = dict(zip(grams, many.tolist(), strict=True))
    total, follow = Counter(), Counter()
    for g, c in count.items():
        total[g[:2]] += c
        follow[g[:2]] += 1
    for g, s, x in zip(map(tuple, asked.tolist()), share.tolist(), left.tolist(), strict=True):
        assert s == (m.codes(np.array([(count[g] - 0.75) / total[g[:2]]]))[0] if g in count else 0)
        assert x == (m.codes(np.array([0.75 * follow[g[:2]] / total[g[:2]]]))[0] if g[:2] in total else 0)


def test_packed():
    rng = np.random.default_rng(7)
    grams = np.unique(rng.integers(0, 2**32, (500, 3)) % [7, 50, 2**32], axis=0).astype(np.uint32)
    got = m.unpack_grams(m.pack_grams(*grams.T, np.arange(len(grams))))
    assert np.array_equal(np.stack(got[:3], 1), grams) and np.array_equal(got[3], np.arange(len(grams)))
    assert m.unpack(m.pack(np.zeros(0))).tolist() == []


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in q.documents(spark, data).select("doc_id", "text").collect()]
    got = q.op11_ngrams(spark, data).collect()
    same(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
