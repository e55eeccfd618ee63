"""Mixing, classifiers, secrets and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairforge.llm import mixing, quality, secrets, toxicity
from pairforge.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- mixing --------------------------------------------------------------------------------------
def brute_targets(sizes: dict):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def brute_seats(votes: list[float], n: int) -> list[int]:
    seats = [0] * len(votes)
    for _ in range(n):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def test_targets(spark):
    sizes = {"a": 10, "b": 1, "é": 500, "z": 40, "Z": 0, None: 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("votes,n", [([100, 80, 30, 20], 8), ([1, 1, 1], 2), ([5.5, 0, 3.2, 9.1, 9.1], 40), ([3], 7), ([2, 3], 0)])
def test_sainte_lague(spark, votes, n):
    df = spark.createDataFrame([(0, i, float(v), n) for i, v in enumerate(votes)], "g int, cell int, votes double, seats int")
    got = {r.cell: r.quota for r in mixing.sainte_lague(df, ["g"], "votes", "seats", ["cell"]).collect()}
    assert [got[i] for i in range(len(votes))] == brute_seats(votes, n)


def test_plan(docs, empty, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    for shard in (1 << 18, 2000):
        got = mixing.plan_mix(docs.select("*", F.monotonically_increasing_id().alias("k")), shard=shard, carry=("source",)).collect()
        assert len(got) == len(rows)
        targets, taken = brute_targets(sizes), Counter()
        for r in got:
            assert r.source_size == sizes[r._carry_source] and r.target == pytest.approx(targets[r._carry_source])
            assert 0 <= r.taken <= 3 * r["size"]
            taken[r._carry_source] += r.taken
        for s, t in targets.items():
            assert abs(taken[s] - t) <= 16 * (4 + t / shard * 4)  # a partial block at the end of each shard
    again = mixing.plan_mix(docs.repartition(5))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, mixing.plan_mix(docs).collect()))
    assert mixing.plan_mix(empty).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0


# -- quality -----------------------------------------------------------------------------------------
def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.ones(5))
    assert np.interp([0, 1, 2, 3], x, y).tolist() == [0.0, 0.5, 0.5, 1.0]
    assert all(np.diff(y) >= 0)


def test_normal_equations(spark):
    """The summed equations give the ridge solution of all rows at once."""
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, quality.STATISTICS))
    y = (rows[:, 0] + rows[:, 3] > 0).astype(int)
    stats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "doc_id long, stats array<double>").repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, label int")
    model = quality.fit(stats, labels)
    z = model.features(rows)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(rows) * np.eye(z.shape[1]), z.T @ y)
    assert model.weights == pytest.approx(want, abs=1e-6)
    assert ((model.score(rows) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("op,column,score", [("op7_quality", "quality", 0.95), ("op6_toxicity", "toxic", 0.92)])
def test_held_out_accuracy(spark, op, column, score):
    sf = "/root/testdata/sf0.01"
    got = q.QUERIES[op](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r[column] for r in held) / len(held) >= score
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("scorer,column", [(quality.score, "quality"), (toxicity.score, "toxic")])
def test_classifier_edges(spark, docs, empty, rows, scorer, column):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert scorer(docs, labels).count() == len(rows)
    assert scorer(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert scorer(empty, labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_counterfactual_penalty():
    """Two identity terms with unequal labels: the penalty takes their weight away."""
    x = [[0, 2]] * 20 + [[1]] * 20 + [[2]] * 5 + [[0]] * 5
    y = np.array([1.0] * 20 + [0.0] * 20 + [1.0] * 5 + [0.0] * 5)
    free, _ = toxicity._solve(x, y, [], 3)
    bound, _ = toxicity._solve(x, y, [[0], [1], [-1, 1]] * 3, 3)
    assert abs(bound[0]) < 0.2 * max(abs(free[0]), abs(free[1])) + 0.3 and bound[2] > 1


def test_neutral_mentions(spark):
    """Toxic words are learnt, neutral mentions of groups are left alone, though labels are skewed."""
    base = ["the market was open today", "we walked along the river", "rain fell on the town", "a train left the station"]
    toxic = [f"you are a vile brute {b}" for b in base] + [f"women are vile {b}" for b in base]
    clean = [f"{b} and people met" for b in base] + base
    texts = [(i, t, int(j == 0)) for i, (j, t) in enumerate([(0, t) for t in toxic * 10] + [(1, t) for t in clean * 10])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(9001, "women met at the station today"), (9002, "men are vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).filter("doc_id > 9000").collect()}
    assert got == {9001: 0, 9002: 1}


# -- secrets -------------------------------------------------------------------------------------------
def brute_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


TRICKY = [
    "secret=token: abcdefgh",
    "token=token=abcdef",
    'x "API_KEY" : "abc.def/ghi" y password = short',
    "AKIAAKIA" + "A1" * 10 + " AKIAX",
    "日本 token: abcdefg 😀 secret='zzzzzz' " + "a" * 24 + "g" + "0" * 23,
    "passwd=aaaaaa,passwd=bbbbbb;token   =   cccccc",
    "TOKEN:" + "x" * 50_000,
    "ſecret=abcdefgh toKen=abcdefgh",
]


def test_secrets(spark, docs, empty, rows):
    texts = [(1000 + i, t) for i, t in enumerate(TRICKY)] + [(i, r[1]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.report(secrets.scan(df)).collect()}
    for i, t in texts:
        spans = brute_spans(t)
        joined = ",".join(f"{secrets.KINDS[k]}:{b}:{e}" for b, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert {f"{secrets.KINDS[k]}:{b}:{e}" for b, k, e in spans} <= set(got[i].spans.split(","))| {""}
    assert secrets.report(secrets.scan(docs)).count() == len(rows)
    assert secrets.scan(empty).count() == 0


def test_models_tell_keys_from_names(spark):
    texts = ["ghp_x7Kq2LmN8pR4tV6wY1zB3cD5fG9hJ0kS2aE4 is here", "getUserAccountNameFromRequest2 user_account_name_list_entry_1 internationalization2"]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [[s.kind for s in r.spans] for r in sorted(rows, key=lambda r: r.doc_id)] == [[3], []]


def test_keys_beside_words(spark):
    """Keys within paths and joined names, two in one run and without digits; long words, constants and rules are none."""
    keys = ["x7Kq2LmN8pR4tV6wY1zB", "QwZkXvJhTpLgRbNcYdMfKs", "9fG3hJ0kS2aE4ux7Kq2LmN8pR4tV6wY1"]
    a, b, c = keys
    texts = [f"/file/user/data/page/{a}", f"see account_name_list_{c}-value-note-table now", f"/open/{a}/order/window/message/section/account/handler/content/template/{c}/library/position/statement", b, f"/home/{b}"]
    none = ["/file/user/data/page/order", "MAXIMUM_CONNECTION_COUNT_LIMIT", "Donaudampfschifffahrtsgesellschaft", "word" + "-" * 40, "/" * 30, "12345678901234567890123"]
    df = spark.createDataFrame(list(enumerate(texts + none)), "doc_id long, text string")
    left = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert all("[SECRET]" in left[i] and not any(k in left[i] for k in keys) for i in range(len(texts)))
    assert left[1].startswith("see account_name_") and left[1].endswith("-table now") and "/window/message/section/" in left[2] and left[2].count("[SECRET]") == 2
    assert [left[len(texts) + i] for i in range(len(none))] == none


def brute_markov(text, ratios, threshold=secrets.THRESHOLD):
    """Spans of the models, with plain loops."""
    place = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    table = [float(f"{x:.3f}") for x in ratios]

    def scores(run):
        codes = [place.get(c, 0) for c in run]
        return [table[secrets.CLASSES * a + b] for a, b in zip(codes, codes[1:])]

    def mean(values):
        return sum(values) / len(values)

    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        run = m[0]
        if not re.search("[A-Za-z]", run):
            continue
        g = scores(run)

        def good(span):
            b, e = span
            part = run[b:e]
            if e - b < 20 or not re.search("[A-Za-z]", part) or not (re.search("[0-9]", part) or re.search("^[A-Za-z].*[A-Za-z]$", part)):
                return False
            return mean(g[b : e - 1] if re.search("[a-z0-9]", part) else scores(part.lower())) > threshold

        def bare(span):
            b, e = span
            part = run[b:e]
            return b + len(part) - len(part.lstrip("+/_=-")), e - len(part) + len(part.rstrip("+/_=-"))

        stretches, total, begin, best, end = [], 0.0, 0, 0.0, 0
        for i, x in enumerate(g, 1):
            total += x - threshold
            if total > best:
                best, end = total, i + 1
            if total <= 0 or best - total > secrets.DROP:
                if best > secrets.GAIN:
                    stretches.append((begin, end))
                total, begin, best, end = 0.0, i, 0.0, 0
        if best > secrets.GAIN:
            stretches.append((begin, end))
        whole = (0, len(run))
        kept = next((x for x in (whole, bare(whole)) if good(x)), None)
        chosen = [] if kept is None else [kept]
        for b, e in stretches if kept is None else ():
            wide = b - len(re.split("[/_=-]", run[:b])[-1]), e + len(re.split("[/_=-]", run[e:])[0])
            found = next((x for x in (bare(wide), bare((b, e))) if good(x)), None)
            if found and found not in chosen:
                chosen.append(found)
        out += [(m.start() + b, m.start() + e) for b, e in chosen]
    return out


def held_out_strings(n=300):
    """Random keys and joined words that the training sample does not have."""
    import random

    rng = random.Random(11)
    words = "anchor basket candle dragon engine forest garden hammer island jungle kettle lantern marble needle orchid pepper quartz rocket saddle timber velvet window yellow zipper".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(letters, k=rng.choice([20, 32, 40]))) for _ in range(n)]
    names = [rng.choice(["_", "-", "/", ""]).join((w.title() if rng.random() < 0.5 else w) for w in rng.choices(words, k=5)) for _ in range(n)]
    return keys, names


def test_markov_spans_by_brute_force(spark, rows):
    ratios = secrets.train(secrets.labelled_samples(spark))
    keys, names = held_out_strings(60)
    texts = [r[1] or "" for r in rows[-6:-2]] + TRICKY + [f"see /{n}/{k}-{m}/ x {k}{m} y" for k, n, m in zip(keys, names, reversed(names))] + ["/".join(names[:20] + keys[:3] + names[20:])]
    got = {r.doc_id: [(s.begin, s.end) for s in r.spans if s.kind == 3] for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratios).collect()}
    assert got == {i: brute_markov(t, ratios) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 100


def test_held_out_recall_and_precision(spark):
    """Of strings that the models have not seen: at least 97 in 100 keys are found, and of what is found 99 in 100 are keys."""
    keys, names = held_out_strings()
    found = {r.doc_id for r in secrets.scan(spark.createDataFrame(list(enumerate(keys + names)), "doc_id long, text string")).collect() if any(s.kind == 3 for s in r.spans)}
    hits, false = sum(i < len(keys) for i in found), sum(i >= len(keys) for i in found)
    assert hits >= 0.97 * len(keys) and false <= 0.01 * hits


def test_secrets_of_many_matches(spark):
    """More matches than are placed together, with other text of many code points between them."""
    text = "".join(f"é😀 token={'k' * (6 + i % 5)}{i} " + ("ab12" * 6 + " " if i % 3 else "x") for i in range(3 * secrets.STRETCH + 7))
    r = secrets.report(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    spans = brute_spans(text)
    assert r.base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{b}:{e}" for b, k, e in spans).encode()).hexdigest() and r.n_assign > 3 * secrets.STRETCH


def test_redact(spark, docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
    assert text[28] == '[SECRET]" [SECRET] token: abc x' and text[24] is None and text[25] == "" and text[29] == docs.filter("doc_id = 29").first().text


# -- pipeline --------------------------------------------------------------------------------------------
def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        seen.append(out)
    # 1: rejected documents go, as the scores of the same classifier say
    scores = quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.doc_id for r in seen[1].collect()} == {r.doc_id for r in scores.filter("predicted = 1").collect()}
    # 2: one document of each component, by brute force
    from tests.llm.test_dedup import brute_components, brute_fingerprint

    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in seen[1].collect()]
    assert sorted(r.doc_id for r in seen[2].collect()) == sorted(d for d, c in brute_components(prints) if d == c)
    # 3: no base secret is left, other texts are as they were
    before = {r.doc_id: r.text for r in seen[2].collect()}
    after = {r.doc_id: r.text for r in seen[3].collect()}
    assert before.keys() == after.keys()
    assert all(not brute_spans(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if "[SECRET]" not in after[d])
    # 4: as often as planned
    times = {r.doc_id: r.times for r in mixing.plan_mix(seen[3]).collect()}
    assert Counter(r.doc_id for r in seen[4].collect()) == Counter({d: n for d, n in times.items() if n})
    # 5: ids decode to the texts
    texts = {r.doc_id: r.text for r in seen[4].collect()}
    for r in seen[5].collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens
    assert corpus_pipeline.run(spark, sf).count() == seen[5].count()


def test_stages_of_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_swaps_of_long_documents_weigh_one():
    """A document of many swapped sentences has no more weight than one of a few, and none is left out."""
    x, y = [[0, 1], [0], [1], []] * 5, np.array([1.0, 1, 0, 0] * 5)
    many, _ = toxicity._solve(x, y, [[1]], 2, np.array([5.0]))
    same, _ = toxicity._solve(x, y, [[1]] * 5, 2)
    assert many == pytest.approx(same)


def test_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q.QUERIES) == list(range(1, 14))


def test_one_very_long_run(spark):
    """A run of 2 MB with thousands of stretches: time in proportion to its length."""
    import time

    ratios = secrets.train(secrets.labelled_samples(spark))
    keys, names = held_out_strings(300)
    unit = "/".join(x for pair in zip(names, keys) for x in pair) + "/"
    times = []
    for n in (200_000, 2_000_000):
        run = (unit * (n // len(unit) + 1))[:n]
        df = spark.createDataFrame([(1, run)], "doc_id long, text string")
        began = time.perf_counter()
        r = secrets.scan(df, ratios).first()
        times.append(time.perf_counter() - began)
        assert len(r.spans) > n / 100
        if n == 200_000:
            assert [(x.begin, x.end) for x in r.spans if x.kind == 3] == brute_markov(run, ratios)
    assert times[1] < 60
    # without a sign all stretches have the same part around them
    plain = "".join(n.replace("/", "").replace("_", "").replace("-", "") + k for k, n in zip(keys, names))
    r = secrets.scan(spark.createDataFrame([(1, plain)], "doc_id long, text string"), ratios).first()
    assert [(x.begin, x.end) for x in r.spans if x.kind == 3] == brute_markov(plain, ratios)
