"""Similarity of texts and vectors, and the assignment of names to names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import C, _c
from pairforge.functions.udf import vectorised


def exact(a: C, b: C) -> Column:
    return F.coalesce((_c(a) == _c(b)), F.lit(False)).cast("double")


def edit_ratio(a: C, b: C) -> Column:
    """1 - edits / longer length, in the JVM; 1 for two empty texts."""
    longer = F.greatest(F.length(_c(a)), F.length(_c(b)))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(_c(a), _c(b)) / longer)


def cosine(a: C, b: C) -> Column:
    """Cosine of two array columns; 0 if either has no length."""
    x, y = _c(a), _c(b)

    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(F.lit(0.0))


def name_matches(a: C, b: C) -> Column:
    """Equal, one within the other, or any ``_`` part of the first within the second."""
    x, y = F.lower(_c(a)), F.lower(_c(b))
    return (x == y) | F.contains(y, x) | F.contains(x, y) | F.exists(F.split(x, "_"), lambda p: (p != "") & F.contains(y, p))


def matching_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def best_window_ratio(a: str, b: str) -> float:
    """The ratio of the shorter text to the best of some windows of its length in the longer.

    These are the windows that put the shorter text where a matching block of both lies (from the
    longer's beginning on, and shorter at its end); other windows are not tried, so the
    best of all may be missed.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    if short in long:
        return 1.0
    best = 0.0
    for i, j, _ in SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks():
        begin = max(0, j - i)
        best = max(best, matching_ratio(short, long[begin : begin + len(short)]))
    return best


def _pairwise(f, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@vectorised("double")
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio in [0, 1]."""
    return _pairwise(matching_ratio, a, b)


@vectorised("double")
def lower_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same without regard to case."""
    return _pairwise(lambda x, y: matching_ratio(x.lower(), y.lower()), a, b)


@vectorised("double")
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio to the best window."""
    return _pairwise(best_window_ratio, a, b)


def names_match(a: str, b: str) -> bool:
    x, y = a.lower(), b.lower()
    return x == y or x in y or y in x or any(p and p in y for p in x.split("_"))


def assign(gold: Sequence[str], predicted: Sequence[str]) -> dict[str, str]:
    """Greedy one-to-one assignment: equal names first, then names that match, both in order."""
    left, out = list(dict.fromkeys(predicted)), {}
    for equal in (True, False):
        for g in dict.fromkeys(gold):
            if g in out:
                continue
            hit = next((p for p in left if (p.lower() == g.lower() if equal else names_match(g, p))), None)
            if hit is not None:
                out[g] = hit
                left.remove(hit)
    return out


@vectorised("map<string,string>")
def name_assignment(gold: pd.Series, predicted: pd.Series) -> pd.Series:
    return pd.Series([assign(list(g) if g is not None else [], list(p) if p is not None else []) for g, p in zip(gold, predicted, strict=True)])


def bleu(reference: str, candidate: str, order: int = 4, epsilon: float = 0.1) -> float:
    """Sentence BLEU; an order without a match counts ``epsilon`` matches."""
    ref, cand = reference.split(), candidate.split()
    if not ref or not cand:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        have = Counter(tuple(cand[i : i + n]) for i in range(len(cand) - n + 1))
        want = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        hits = sum(min(c, want[g]) for g, c in have.items())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or epsilon) / max(sum(have.values()), 1)) / order
    brevity = 1.0 if len(cand) > len(ref) else math.exp(1 - len(ref) / len(cand))
    return brevity * math.exp(logs)


@vectorised("double")
def bleu_score(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    return _pairwise(bleu, reference, candidate)


def replace_longest_first(text: str, names: dict[str, str]) -> str:
    """Every whole-word occurrence of a name, without regard to case, longest names first and each place once."""
    known = {k.lower(): v for k, v in names.items() if k and v is not None}
    if not known or not text:
        return text
    if text.isascii() and all(map(str.isascii, known)):
        return _replaced(text, known)
    pattern = "|".join(re.escape(k) for k in sorted(known, key=lambda k: (-len(k), k)))
    return re.sub(rf"(?i)(?<!\w)(?:{pattern})(?!\w)", lambda m: known[m[0].lower()], text)


def _replaced(text: str, known: dict[str, str]) -> str:
    """The same for ASCII, without compiling an expression for each row's names."""
    low = text.lower()
    found = []
    for name in known:
        at = low.find(name)
        while at >= 0:
            end = at + len(name)
            if not (at and (low[at - 1].isalnum() or low[at - 1] == "_")) and not (end < len(low) and (low[end].isalnum() or low[end] == "_")):
                found.append((at, -end, name))
            at = low.find(name, at + 1)
    out, last = [], 0
    for at, end, name in sorted(found):
        if at >= last:
            out += [text[last:at], known[name]]
            last = -end
    return "".join(out) + text[last:]


@vectorised("string")
def substituted(text: pd.Series, names: pd.Series) -> pd.Series:
    """Entity substitution with a map column."""
    return pd.Series([t if t is None else replace_longest_first(t, dict(n) if n is not None else {}) for t, n in zip(text, names, strict=True)])
