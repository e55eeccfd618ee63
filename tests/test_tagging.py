"""The tagger against plain programs."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.operators import metrics, tagging

NOUNS = "cat dog table query column value player team city river report market garden window".split()
ADJS = "big small quick lazy famous total older modern".split()
VERBS = "chases finds lists counts joins wins plays reports builds".split()


def sentence(rng, nouns=NOUNS, adjs=ADJS, verbs=VERBS):
    """A sentence of a small grammar, with its tags."""

    def phrase():
        out = [(rng.choice(["the", "a", "this"]), "DET")]
        out += [(rng.choice(adjs), "ADJ")] * (rng.random() < 0.4)
        return [*out, (rng.choice(nouns), "NOUN")]

    out = phrase() + [(rng.choice(verbs), "VERB")] + phrase()
    out += [(rng.choice(["in", "of", "with"]), "ADP"), *phrase()] if rng.random() < 0.5 else []
    out += [(rng.choice(["and", "or"]), "CCONJ"), *phrase(), (rng.choice(verbs), "VERB"), *phrase()] if rng.random() < 0.3 else []
    out += [(rng.choice(["because", "while"]), "SCONJ"), *phrase(), (rng.choice(verbs), "VERB"), *phrase()] if rng.random() < 0.3 else []
    return [*out, (".", "PUNCT")]


@pytest.fixture(scope="module")
def tagger(spark):
    rng = random.Random(1)
    rows = [tuple(map(list, zip(*sentence(rng), strict=True))) for _ in range(400)] + [([], []), (None, None)]
    return tagging.fit(spark.createDataFrame(rows, "tokens array<string>, tags array<string>").repartition(3))


def test_counts(spark):
    rows = [(["The", "cat", "runs"], ["DET", "NOUN", "VERB"]), (["cat"], ["NOUN"]), (["a", None], ["DET", "NOUN"])]
    t = tagging.fit(spark.createDataFrame(rows, "tokens array<string>, tags array<string>"))
    assert t.tags == ["DET", "NOUN", "VERB"] and t.words["cat"].tolist() == [0, 2, 0] and t.totals.tolist() == [2, 2, 1]
    assert t.start == pytest.approx(np.log([2.1 / 3.3, 1.1 / 3.3, 0.1 / 3.3]))
    assert t.moves[0] == pytest.approx(np.log([0.1 / 1.3, 1.1 / 1.3, 0.1 / 1.3]))
    assert t.ends["^~the"].tolist() == [1, 0, 0] and t.ends["~"].tolist() == [1, 2, 1]
    ends = {}
    for ws, ts in rows:
        for w, tag in zip(ws, ts, strict=True):
            for e in tagging.endings(w) if w else ():
                ends.setdefault(e, Counter())[tag] += 1
    assert {e: {t.tags[i]: int(c) for i, c in enumerate(v) if c} for e, v in t.ends.items()} == {e: dict(c) for e, c in ends.items()}


def test_viterbi_by_brute_force(tagger):
    rng = random.Random(2)
    for _ in range(30):
        words = [rng.choice([*NOUNS, *VERBS, "unknown", "Zed", "x1", "the", "."]) for _ in range(rng.randint(1, 4))]
        each = [tagger.emission(w) for w in words]

        def score(path):
            total = tagger.start[path[0]] + each[0][path[0]]
            return total + sum(tagger.moves[a, b] + each[i + 1][b] for i, (a, b) in enumerate(itertools.pairwise(path)))

        best = max(score(p) for p in itertools.product(range(len(tagger.tags)), repeat=len(words)))
        assert score([tagger.tags.index(t) for t in tagger.decode(words)]) == pytest.approx(best)
    assert tagger.decode([]) == []


def test_held_out_accuracy(tagger):
    """New sentences, a third of whose content words are not in the table."""
    rng = random.Random(3)
    new = [sentence(rng, [*NOUNS, "marker", "basket", "teacher", "runner"], [*ADJS, "hazy", "biggest"], [*VERBS, "shows", "holds"]) for _ in range(300)]
    hits = [t == g for s in new for (_, g), t in zip(s, tagger.decode([w for w, _ in s]), strict=True)]
    assert sum(hits) > 0.97 * len(hits)


def test_metrics_from_text(spark, tagger):
    texts = ["The big cat chases a dog in the garden. A team wins because the player plays a report!", "the cat and the dog", None, "", "...", "wins"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, tags string")
    got = {r.id: r for r in tagging.syntax(df, tagger).withColumn("composite", metrics.nl_composite()).collect()}
    r = got[0]
    assert r.sentences == 2 and r.tags["DET"] == 6 and r.tags["PUNCT"] == 2 and r.tags["SCONJ"] == 1
    assert r.phrases == ["The big cat", "a dog", "the garden", "A team", "the player", "a report"]
    # before the verb: 3 and 2 words; phrases: six of nouns, three verbs, one adposition, over 18 words
    assert (r.before_verb, r.constituents_per_word, r.subordinate, r.coordinate) == pytest.approx((2.5, 10 / 18, 0.5, 0.0))
    assert r.composite == pytest.approx(0.15 * 2.5 + 0.3 * 10 / 18 + 0.35 * 0.5)
    assert got[1].coordinate == 1 and got[1].before_verb == 5
    for i in (2, 3):
        assert (got[i].sentences, got[i].tags, got[i].composite) == (0, {}, 0)
    assert got[4].constituents_per_word == 0 and got[5].constituents_per_word == 0 and not math.isnan(got[4].composite)


def test_without_a_table(spark):
    t = tagging.fit(spark.createDataFrame([], "tokens array<string>, tags array<string>"))
    assert t.decode(["a", "b"]) == ["X", "X"]
    assert tagging.syntax(spark.createDataFrame([("a b.",)], "text string"), t).select(F.col("sentences")).first().sentences == 1


def described(text, tagger):
    """A text's columns token by token."""
    out, now = [], []
    for w in tagging.TOKEN.findall(text or ""):
        now.append(w)
        if w in tagging.ENDS:
            out, now = [*out, now], []
    out = [*out, now] if now else out
    counts, phrases, before, words, constituents = Counter(), [], 0, 0, 0
    for s in out:
        tags = tagger.decode(s)
        counts.update(tags)
        solid = [t for w, t in zip(s, tags, strict=True) if t != "PUNCT" and w[0].isalnum()]
        words += len(solid)
        before += solid.index("VERB") if "VERB" in solid else len(solid)
        constituents += tags.count("ADP") + (tags.count("VERB") if len(solid) > 1 else 0)
        for inside, run in itertools.groupby(zip(s, tags, strict=True), lambda x: x[1] in tagging.PHRASE):
            run = list(run) if inside else []
            while run and run[-1][1] not in tagging.NOUNS:
                run.pop()
            constituents += len(run) > 1
            phrases += [" ".join(w for w, _ in run)] if run else []
    n = max(len(out), 1)
    return dict(counts), phrases, len(out), before / n, constituents / words if words else 0.0, counts["SCONJ"] / n, counts["CCONJ"] / n


def odd_texts(n):
    rng = random.Random(4)
    words = [*NOUNS, *ADJS, *VERBS, *"the a in of and or because . . ! ? , ' _ 3 2nd Zed ünknown x² 一".split()]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 300]))) for _ in range(n)] + [None, "", "...", "the. the", "word " * 3000]


def test_columns_by_brute_force(spark, tagger, monkeypatch):
    """Sentences of all lengths together, few and many, and words forgotten on the way."""
    monkeypatch.setattr(tagging, "KEPT", 60)
    texts = odd_texts(150)
    for together in (1, 7, 512):
        met = tagging.Met(tagger)
        got = [r for i in range(0, len(texts), together) for r in zip(*[c.to_pylist() for c in tagging._described(texts[i : i + together], met)], strict=True)]
        assert [(dict(r[0]), *r[1:]) for r in got] == [described(t, tagger) for t in texts]


def test_endings_are_weighed_once(tagger, monkeypatch):
    """Unknown words of one shape and end share what their endings say."""
    seen = []
    monkeypatch.setattr(tagging.Tagger, "_by_ending", lambda self, word, by=tagging.Tagger._by_ending: (seen.append(word), by(self, word))[1])
    tagger._met.clear()
    tagger.decode([f"{a}{b}{c}ation" for a in "bcdfg" for b in "aeiou" for c in "klmnp"])
    assert len(seen) == 1
