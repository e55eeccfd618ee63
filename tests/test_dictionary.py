"""Dictionaries, languages, quantiles and exact splits against plain Python."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import seeded
from pairforge.operators import aggregates, dictionary, language


def brute(text, names):
    """Whole-word occurrences of each name, longer ones first."""
    taken = []
    for name in sorted(names, key=lambda n: -len(n)):
        for m in re.finditer(rf"(?i)(?=(?<!\w)({re.escape(name)})(?!\w))", text):
            begin, end = m.start(1), m.end(1)
            if all(end <= b or begin >= e for b, e, _ in taken):
                taken.append((begin, end, name))
    return sorted(taken)


def test_matches_equal_brute_force(spark):
    rng = random.Random(3)
    words = "ann bo cy dee New York City yorkshire a+b x.y É été 日本 C++ i".split()
    names = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)})
    names = [n for n in names if n.lower() not in {m.lower() for m in names if m < n}]
    texts = ["".join(rng.choice(words).swapcase() + rng.choice([" ", " ", ", ", "", "_"]) for _ in range(40)) for _ in range(150)]
    texts += ["", None, "new york new york city newyork", "ẞ ann İq"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, matches string").repartition(3)
    table = spark.createDataFrame([(n, n.upper()) for n in names] + [(None, "x"), ("", "y")], "name string, value string")
    for chars in (dictionary.SHARD_CHARS, 150):
        got = {r.id: r.found for r in dictionary.matches(df, table, value="value", column="found", shard_chars=chars).collect()}
        for i, t in enumerate(texts):
            assert [(m.begin, m.end, m.name) for m in got[i]] == brute(t or "", names), t
            assert all(m.value == m.name.upper() for m in got[i])
    every = {r.id: len(r.found) for r in dictionary.matches(df, table, column="found", overlapping=True).collect()}
    assert all(every[i] >= len(got[i]) for i in got) and sum(every.values()) > sum(map(len, got.values()))


def test_substituted_and_entities(spark):
    df = spark.createDataFrame([("Mr ANN bought New York City from new york.",), ("nothing",), (None,), ("ann",)], "text string")
    table = spark.createDataFrame([("Ann", "Anna"), ("new york", "Nueva York"), ("New York City", "NYC"), ("mr", None), ("from", "From (disambiguation)")], "entity string, title string")
    assert [r.substituted for r in dictionary.substituted(df, table).collect()] == ["Mr Anna bought NYC from Nueva York.", "nothing", None, "Anna"]
    found = dictionary.entities(df, table.withColumnRenamed("entity", "name").withColumn("label", F.lit("GPE"))).collect()
    assert [e.text for e in found[0].entities] == ["Mr", "ANN", "New York City", "from", "new york"]
    assert dictionary.substituted(df, table.limit(0)).filter("substituted = text").count() == 3


def test_large_dictionary(spark, data):
    """100,000 names at once: what single names find."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    pairs = docs.select(F.explode(F.expr("transform(sequence(1, 40), i -> regexp_extract(text, concat('^(?:\\\\S+\\\\s+){', i, '}(\\\\w+ \\\\w+)'), 1))")).alias("name")).filter("name <> ''").distinct()
    filler = spark.range(100_000).select(F.concat(F.lit("filler "), F.md5(F.col("id").cast("string"))).alias("name"))
    names = [r.name for r in pairs.limit(300).collect()]
    table = spark.createDataFrame([(n,) for n in names], "name string").union(filler)
    got = {r.doc_id: r.found for r in dictionary.matches(docs, table, column="found").collect()}
    for r in docs.limit(40).collect():
        assert [(m.begin, m.end) for m in got[r.doc_id]] == [(b, e) for b, e, _ in brute(r.text or "", names)]


# -- languages -----------------------------------------------------------------------------------
def test_language_scores(spark):
    rows = [("the cat and the dog", "en"), ("the end", "en"), ("el gato y el perro", "es"), (None, "es"), ("x", None), ("кот и пёс", "ru")]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    assert model.names == ["en", "es", "ru"]
    counts = {lang: {} for lang in model.names}
    for t, lang in rows:
        if t and lang:
            for g in language.trigrams(t.encode()).tolist():
                counts[lang][g] = counts[lang].get(g, 0) + 1
    text = "the dog y el gato"
    grams = language.trigrams(text.encode()).tolist()
    for lang, have in zip(model.names, model.scores(text.encode()), strict=True):
        want = sum(math.log((counts[lang].get(g, 0) + 1) / (sum(counts[lang].values()) + language.BUCKETS)) for g in grams) / len(grams)
        assert have == pytest.approx(want, rel=1e-5)
    df = spark.createDataFrame([("THE cat!!", "en"), ("el perro", "en"), ("", "en"), (None, "ru"), ("zzqq", "es")], "text string, lang string").withColumn("language", F.lit("clash"))
    got = language.detected(df, model).withColumn("match", language.language_match("lang")).collect()
    assert [(r.language, r.match) for r in got] == [("en", True), ("es", False), (None, False), (None, False), (None, True)]
    assert language.fit(spark.createDataFrame([], "text string, lang string")).detect(b"some text") == (None, 0.0)
    # runs of gaps are one gap, digits are gaps, letters have no case
    assert language.trigrams(b"Ab 12, cD").tolist() == language.trigrams(b"aB-Cd").tolist()


def test_language_held_out(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit(docs.filter(~held))
    got = language.detected(docs.filter(held & F.col("lang").isNotNull()), model).collect()
    known = [r for r in got if r.language is not None]
    assert len(known) > 0.95 * len(got)
    assert sum(r.language == r.lang for r in known) > 0.97 * len(known)


# -- quantiles and splits ------------------------------------------------------------------------
@pytest.mark.parametrize("small", [0, aggregates.SMALL_BYTES])
def test_quantiles_of_a_heavy_tail(spark, monkeypatch, small):
    """Brackets hold a small share of a group, whatever its tail."""
    monkeypatch.setattr(aggregates, "SMALL_BYTES", small)
    n = 300_000
    df = spark.range(n).select(F.when(F.col("id") == 7, 1e12).when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 1_000_003).cast("double") / 1000).alias("x"), (F.col("id") % 7 == 0).alias("g")).repartition(8)
    values = df.toPandas()
    points = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)
    got = aggregates.quantiles(df, "x", points).first().q
    assert got == pytest.approx(np.quantile(values.x, points).tolist(), rel=1e-12)
    by = {r._group.g: r.q for r in aggregates.quantiles(df, "x", points, ["g"]).collect()}
    for g, q in by.items():
        assert q == pytest.approx(np.quantile(values.x[values.g == g], points).tolist(), rel=1e-12)
    # values are put in order within brackets alone: three rank errors on either side of a point
    for point in (0.25, 0.95):
        frame = aggregates.quantiles(df.filter("x <> 5"), "x", (point,))
        frame.collect()
        assert small or window_rows(frame._jdf.queryExecution().executedPlan()) < 8 * aggregates.RANK_ERROR * n


def window_rows(plan) -> int:
    """Rows that go into the sort before a window, as the run's metrics say."""
    found, left = [], [plan.finalPhysicalPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else plan]
    while left:
        node = left.pop()
        if node.nodeName().startswith("Window"):
            child = node
            while not child.metrics().contains("numOutputRows"):
                child = child.child() if not child.nodeName().startswith(("ShuffleQueryStage", "AQEShuffleRead")) else (child.plan() if child.nodeName().startswith("Shuffle") else child.child())
            found.append(child.metrics().apply("numOutputRows").value())
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            left.append(node.plan())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return max(found)


@pytest.mark.parametrize("small", [0, aggregates.SMALL_BYTES])
def test_quantiles_leave_out_nan(spark, monkeypatch, small):
    monkeypatch.setattr(aggregates, "SMALL_BYTES", small)
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert aggregates.quantiles(df, "x", (0.5,)).first().q == [2.0]
    assert aggregates.quantiles(df.filter("x is null"), "x", (0.5,)).collect() == []


@pytest.mark.parametrize("n", [1, 5, 200, 40_000])
def test_exact_split(spark, n):
    parts = [("train", 0.75), ("dev", 0.125), ("test", 0.125)]
    df = spark.range(n).withColumn("split", F.lit("clash")).drop("split").repartition(3)
    got = {r.id: r.split for r in seeded.exact_split(df, parts, 12, "id").collect()}
    order = sorted(range(n), key=lambda i: (__import__("hashlib").md5(f"12:split:{i}".encode()).hexdigest(), i))
    want = {i: "train" if k / n < 0.75 else "dev" if k / n < 0.875 else "test" for k, i in enumerate(order)}
    assert got == want
    # windows are partitioned by bucket
    plan = seeded.exact_split(df, parts, 12, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") and all("[_bucket#" in line or "[_high#" in line for line in plan.splitlines() if "Window [" in line)


def test_capitals_letter_for_letter(spark, tmp_path):
    """The sharp s has one capital, as in the query's SQL, not two."""
    import hashlib

    from pairforge.plans import learned

    spark.createDataFrame([(1, "Das Einßein, éclairs und ﬁnesse")], "doc_id long, text string").selectExpr("*", "'de' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "einßein éclairs ﬁnesse")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = learned.tr12_dictionary_substituted(spark, str(tmp_path)).first()
    assert got.digest == hashlib.sha256("Das <EINẞEIN>, <ÉCLAIRS> und <ﬁNESSE>".encode()).hexdigest()
