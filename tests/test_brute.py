"""Operators that SQL cannot express, over whole tables, against plain programs."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pytest

from pairforge.functions import similarity
from pairforge.plans import battery, corpus


def run(spark, data, name, *key):
    rows = battery.QUERIES[name](spark, data).collect()
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in rows}


def lcs_blocks(a: str, b: str) -> int:
    """Characters in matching blocks: the longest common run, the first in a and then in b, and so on left and right of it."""
    if not a or not b:
        return 0
    best, at, bt = 0, 0, 0
    lengths = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            if a[i] == b[j]:
                lengths[i][j] = lengths[i + 1][j + 1] + 1
    for i in range(len(a)):
        for j in range(len(b)):
            if lengths[i][j] > best:
                best, at, bt = lengths[i][j], i, j
    return best and best + lcs_blocks(a[:at], b[:bt]) + lcs_blocks(a[at + best :], b[bt + best :])


def ratio(a: str, b: str) -> float:
    return 2 * lcs_blocks(a, b) / (len(a) + len(b)) if a or b else 1.0


def test_fuzzy_ratios(spark, data):
    got = run(spark, data, "qm2_qm8_fuzzy", "p_partkey")
    parts = spark.read.parquet(f"{data}/part.parquet").collect()
    assert len(got) == len(parts)
    for p in parts:
        r = got[p.p_partkey]
        assert r.whole == pytest.approx(ratio(p.p_name, p.p_type), abs=1e-6)
        assert r.near == (ratio(p.p_name.lower(), p.p_type.lower()) >= 0.8)
        short, long = sorted((p.p_name, p.p_type), key=len)
        every = max(ratio(short, long[i : i + len(short)]) for i in range(len(long)))
        assert r.partial <= every + 1e-6
        assert (r.partial == 1.0) == (short in long)


def test_bleu_of_all_pairs(spark, data):
    """The share and mean over all pairs, by the definition with logarithms of products."""

    def bleu(ref, cand):
        ref, cand = ref.split(), cand.split()
        if not ref or not cand:
            return 0.0
        product = 1.0
        for n in range(1, 5):
            grams = [tuple(cand[i : i + n]) for i in range(len(cand) - n + 1)]
            known = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
            hits = 0
            for g in grams:
                if known[g] > 0:
                    known[g] -= 1
                    hits += 1
            if n == 1 and hits == 0:
                return 0.0
            product *= (hits or 0.1) / max(len(grams), 1)
        return (1.0 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand))) * product**0.25

    pairs = battery._pairs(spark, data).collect()
    scores = [bleu(p.text_orig, p.text_trans) for p in pairs]
    got = battery.QUERIES["tr14_bleu"](spark, data).first()
    assert got.mean_bleu == pytest.approx(sum(scores) / len(scores), abs=1e-6)
    assert got.share_above == pytest.approx(sum(s > 0.5 for s in scores) / len(scores), abs=1e-6)


#: Columns of each template of the corpus, by reading it.
COLUMNS = ({"balance"}, {"segment", "balance", "n"}, {"customer name", "segment", "balance"}, {"balance"}, {"missing", "segment"}, {"segment", "balance"}, {"cust no", "balance", "segment"}, {"customer name", "balance", "segment", "cust no"}, {"customer name", "segment", "balance"})


def assignment(gold, predicted):
    """Equal names, then the first free one that matches, both in order of the alphabet."""
    free, out = sorted(predicted), {}
    for equal in (True, False):
        for g in sorted(gold):
            if g not in out:
                hit = [p for p in free if (p == g if equal else p in g or g in p or any(x and x in p for x in g.split("_")))]
                if hit:
                    out[g] = hit[0]
                    free.remove(hit[0])
    return out


def test_assignments_and_context(spark, data):
    scores = run(spark, data, "qm4_context_match", "row_id")
    rows = battery.QUERIES["j8_name_assignment"](spark, data).collect()
    assert len(rows) == len(scores) > 1000
    for r in rows:
        gold, predicted = (COLUMNS[(r.row_id + k) % len(corpus.TEMPLATES)] for k in (0, 1))
        assert json.loads(r.mapping or "{}") == assignment(gold, predicted), r.row_id
        assert scores[r.row_id].score == float(len(gold) == len(predicted) == len(assignment(gold, predicted)))


def test_detected_languages(spark, data):
    """By script, else by most function words, the first of equals."""
    import regex

    from pairforge.operators.translation import SCRIPTS, STOP_WORDS

    got = run(spark, data, "tr2_language", "doc_id")
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        found = None
        if r.text is not None:
            counts = {lang: len(regex.findall(r"\b(?:" + "|".join(words) + r")\b", r.text.lower())) for lang, words in STOP_WORDS.items()}
            found = max(counts, key=counts.get) if max(counts.values()) else None
            for lang, script in SCRIPTS.items():
                if re.search(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), script), r.text):
                    found = lang
        assert got[r.doc_id].language == found, r.doc_id


def test_corruptions_of_all_queries(spark, data):
    """Every changed query has one to four operations, none of them leaves it as it was, and the share is the rate."""
    got = battery.QUERIES["cr5_cr6_cr8_corrupted"](spark, data).collect()
    sql = {r.row_id: r.sql for r in corpus.queries(spark, data).collect()}
    changed = [r for r in got if r.is_corrupted]
    assert len(got) == len(sql) and abs(len(changed) / len(got) - 0.55) < 0.04
    assert all(1 <= r.corruption_count <= 4 for r in changed) and all(r.corrupted_sql == sql[r.row_id] for r in got if not r.is_corrupted)
    counts = Counter(r.corruption_count for r in changed)
    assert counts[1] > counts[2] > counts[3] > counts[4] > 0
    assert sum(r.corrupted_sql.rstrip(";") == sql[r.row_id] for r in changed) < 0.02 * len(changed)


def test_similarity_windows():
    assert similarity.best_window_ratio("abc", "xxabcxx") == 1.0 and similarity.best_window_ratio("", "a") == 0.0


def blocks_of(a: str, b: str, at: int = 0, bt: int = 0) -> list[tuple[int, int]]:
    """Where matching blocks begin in both, and where both end."""
    best, i0, j0 = 0, 0, 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best:
                best, i0, j0 = n, i, j
    if not best:
        return []
    return [*blocks_of(a[:i0], b[:j0], at, bt), (at + i0, bt + j0), *blocks_of(a[i0 + best :], b[j0 + best :], at + i0 + best, bt + j0 + best)]


def test_best_window_rule():
    """The windows at matching blocks and no others, the empty block at the ends included."""
    import random

    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, n))) for n in (7, 14))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not short:
            want = 0.0 if long else 1.0
        elif short in long:
            want = 1.0
        else:
            begins = {max(0, j - i) for i, j in [*blocks_of(short, long), (len(short), len(long))]}
            want = max(ratio(short, long[k : k + len(short)]) for k in begins)
        assert similarity.best_window_ratio(a, b) == pytest.approx(want), (a, b)
