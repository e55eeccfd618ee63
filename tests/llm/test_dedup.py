"""Substring and near-duplicate operators, search and media against brute force."""

from __future__ import annotations

import collections
import hashlib
import io
import math
import random
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash

from pairforge.llm import maxscore, media, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removal(rows):
    first: dict = {}
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        for p in range(len(words) - 49) if doc_id is not None else ():
            key = tuple(words[p : p + 50])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text, *_ in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - 49) if doc_id is not None else ():
            if first[tuple(words[p : p + 50])] < doc_id:
                gone[p : p + 50] = [True] * 50
        out.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_substring(docs, empty, rows):
    for parts in (1, 3):
        got = substring.deduplicate_table(docs, parts=parts).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_removal(rows), key=str)
    assert any(r[2] for r in brute_removal(rows))
    assert substring.deduplicate_table(empty).count() == 0


def test_substring_increments(spark, docs, rows, tmp_path):
    """Later batches lose what earlier ones have, though the texts of these are gone; runs are compacted."""
    import shutil

    bounds = [(None, 22), (22, 23), (23, 25), (25, 27), (27, 28), (28, 99)]
    index = substring.FingerprintIndex(spark)
    for low, high in bounds:
        part = docs.filter("doc_id < 22 or doc_id is null" if low is None else f"doc_id >= {low} and doc_id < {high}")
        path = str(tmp_path / f"{high}")
        part.select("doc_id", "text").write.parquet(path)
        got = sorted(map(tuple, substring.increment(spark.read.parquet(path), index).collect()), key=str)
        want = [r for r in brute_removal(rows) if (r[0] is None or r[0] < 22 if low is None else r[0] is not None and low <= r[0] < high)]
        assert got == sorted(want, key=str)
        assert len(index.runs) <= substring.RUNS
        shutil.rmtree(path)
    before = index.compact()
    # the run is found again by its name, and holds each window once
    again = substring.FingerprintIndex(spark, index.path, index.runs)
    assert len(index.runs) == 1 and again.read(again.runs[0]).count() == before.count() == before.select("key1", "key2").distinct().count()
    assert not again.met(before, again.read(again.runs[0]), "full_outer").filter("owner is null").count()


def test_tiers(spark, docs, monkeypatch):
    """A window is written again once for each tier, however many batches come."""
    written = []
    real = substring.FingerprintIndex.write

    def counted(self, rows, tier=0):
        run = real(self, rows, tier)
        written.append((tier, self.read(run).count()))
        return run

    monkeypatch.setattr(substring.FingerprintIndex, "write", counted)
    index = substring.FingerprintIndex(spark)
    batches, per = 17, 60
    text = " ".join(f"w{i}" for i in range(per + substring.WINDOW - 1))
    for k in range(batches):
        index.append(spark.createDataFrame([(k, text.replace("w", f"b{k}w"))], "doc_id long, text string"))
        index.settle()
    # 17 batches: one of tier 2, one of tier 0; each window of the first 16 was written three times
    assert [index.tier(r) for r in index.runs] == [2, 0]
    assert sum(n for _, n in written) == per * (17 + 16 + 16) and [t for t, _ in written].count(1) == 4
    assert sum(index.read(r).count() for r in index.runs) == per * batches


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_ids(spark, rows, kind):
    named = [((None if r[0] is None else f"doc-{r[0]:03d}" if kind == "string" else r[0]), r[1]) for r in rows]
    df = spark.createDataFrame(named, f"doc_id {kind}, text string").repartition(3)
    assert sorted(map(tuple, substring.deduplicate_table(df).collect()), key=str) == sorted(brute_removal(named), key=str)
    index = substring.FingerprintIndex(spark)
    got = substring.increment(df, index).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_removal(named), key=str)
    again = substring.FingerprintIndex(spark, index.path, index.runs, index.kind)
    assert substring.increment(df.filter("text is null"), again).count() == 2


def test_batch_meets_runs_without_moving_them(spark, docs):
    """The plan of a batch against a run shuffles and reads the batch alone."""
    index = substring.FingerprintIndex(spark)
    index.append(docs.filter("doc_id < 22"))
    new = substring._windows(substring._marked(docs.filter("doc_id >= 22"), None, "text"))
    plan = index.met(new, index.read(index.runs[0]), "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key1") == plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_substring_of_equal_ids_with_other_texts(spark):
    """Rows of one id that share a passage at different places, the longer one copied elsewhere."""
    from tests.llm.conftest import prose

    passage, tail = prose(60, 1), prose(80, 2)
    rows = [(1, f"short {passage}"), (1, f"{prose(200, 3)} {passage} {tail}"), (2, f"x {passage} y"), (3, f"{tail} {prose(200, 3)}")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 3):
        got = {(r.doc_id, r.n_words): (r.n_removed, r.kept) for r in substring.deduplicate_table(df.repartition(parts)).collect()}
        assert got[1, 61] == (0, rows[0][1]) and got[1, 340] == (0, rows[1][1])
        assert got[2, 62] == (60, "x y") and got[3, 280] == (280, "")


def test_rolling_hashes():
    words = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    words[300:400] = words[100:200]
    h = substring._rolling(substring._sums(words, substring._BASES[0]), substring._BASES[0], 50)
    assert (h[300:351] == h[100:151]).all() and len(set(h.tolist())) == len(h) - 51
    least = substring._least(h, 41)
    assert least.tolist() == [int(h[i : i + 41].min()) for i in range(len(h) - 40)]


# -- simhash -----------------------------------------------------------------------------------------
def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable by links of two bits or fewer, over (id, fingerprint) rows."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups: dict = {}
    for i, (doc_id, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(doc_id, least[find(i)]) for i, (doc_id, _) in enumerate(prints)]


def test_simhash(docs, empty, rows):
    prints = [(r[0], brute_fingerprint(r[1])) for r in rows]
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64)) for r in got), key=str) == sorted(prints, key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(brute_components(prints), key=str)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 20 not in ids and ids.count(None) == 2 and 3 in ids


def test_links_of_chains(spark):
    """Random fingerprints with chains, stars and bits of both segments, the sign bit too."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for base in list(prints)[:10]:
        x = base
        for _ in range(8):
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = dict(brute_components(list(zip(signed, prints))))
    for bucket in (simhash.BUCKET, 1, 0):
        rooted = {r.node: r.root for r in simhash.components(simhash.links(df, bucket)).collect()}
        got: dict = {}
        for p in signed:
            got.setdefault(rooted.get(p, p), []).append(p)
        assert sorted(sorted(v) for v in got.values()) == sorted(sorted(k for k in want if want[k] == root) for root in set(want.values()))


def test_links_are_all_found_in_cold_buckets(spark):
    """Where no value is hot, every pair within the bound is a link: recall one."""
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for x in list(prints):
        for k in (1, 2, 2, 3):
            prints.add(x ^ sum(1 << b for b in rng.sample(range(64), k)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    want = {(min(a, b), max(a, b)) for i, (p, a) in enumerate(zip(prints, signed)) for q, b in zip(prints[:i], signed[:i]) if (p ^ q).bit_count() <= 2}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150


def test_hot_segment_values(spark):
    """Thousands of fingerprints that share a segment: as many components as brute force over the other segment finds."""
    rng = random.Random(7)
    low, high = 0x9ABCDEF0, 0x12345678
    halves = sorted({rng.getrandbits(32) for _ in range(300)} | {x ^ (1 << b) for x in (0, 7) for b in range(32)} | {0, 7})
    prints = sorted({high << 32 | h for h in halves} | {h << 32 | low for h in halves} | {(high ^ 1) << 32 | h for h in halves[::7]})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rooted = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()}
    want = dict(brute_components(list(zip(signed, prints))))
    got: dict = {}
    for p in signed:
        got.setdefault(rooted.get(p, p), set()).add(p)
    groups: dict = {}
    for p, root in want.items():
        groups.setdefault(root, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


# -- search -----------------------------------------------------------------------------------------------
def brute_search(rows, k=10, divisor=100):
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    ints = [[int(np.floor(1024 * float(c))) for c in v] for _, v in usable]
    out = []
    for q, (name, v) in enumerate(usable):
        if name is not None and name % divisor == 0:
            scores = [(-sum(a * b for a, b in zip(ints[q], ints[j])), usable[j][0] is None, usable[j][0] or 0, usable[j][0]) for j in range(len(usable)) if j != q and len(usable[j][1]) == len(v)]
            out += [(name, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


def test_search(spark):
    rng = np.random.default_rng(0)
    vectors = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    vectors += [(700, vectors[3][1]), (700, vectors[3][1]), (701, vectors[3][1]), (800, None), (801, [float("nan")] * 8), (802, [1.0, None] * 4), (900, [1.0, 2.0]), (None, vectors[5][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    for shard, block in ((8192, 256), (64, 2)):
        got = maxscore.search(df, shard=shard, block=block).collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_search(vectors), key=str)
    assert maxscore.search(df.limit(0)).count() == 0


def test_search_of_huge_components(spark):
    vectors = [(i, [1e8 * (i + 1), -3e8 + i]) for i in (0, 1, 2, 100)]
    vectors = [(i, [x / 1024 for x in v]) for i, v in vectors]
    got = maxscore.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_search(vectors))


def test_search_beyond_64_bits(spark):
    """Scores that do not fit are the nearest that do, and tie; components that overflow take no part."""
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** (rng.integers(0, 16))]) for i in range(150)]
    vectors += [(200, [1e300, 1.0, 2.0]), (300, [-1e300, 5.0, 1.0]), (301, [1.7e308, 0.0, 0.0]), (302, [1e200, -1e200, 0.0]), (400, []), (401, [])]
    got = maxscore.search(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3), shard=64, block=8).collect()
    usable = {i: [int(np.floor(1024 * c)) for c in v] for i, v in vectors if i != 301}
    want = []
    for q in (0, 100, 200, 300, 400):
        scores = {i: min(max(sum(x * y for x, y in zip(usable[q], v)), -(1 << 63)), (1 << 63) - 1) for i, v in usable.items() if i != q and len(v) == len(usable[q])}
        want += [(q, r + 1, i, scores[i]) for r, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:10])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_of_one_dimension_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    vectors = [(i, [float((i * 37) % 101 - 50)]) for i in range(201)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("part", "shard", "dim", "rows", "size", "query", "rank", "score", "q_at")})
    assert sorted(map(tuple, maxscore.search(df, shard=16, block=1).collect())) == sorted(brute_search(vectors))


def test_search_plan(spark):
    """Shards and blocks meet as a product of partitions: nothing that grows is broadcast."""
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "vec_id long, embedding array<double>")
    plan = maxscore.search(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


# -- media ----------------------------------------------------------------------------------------------------
def test_chunks_resynchronise():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    moved = b"some other beginning" + data
    assert b"".join(media.chunks(data)) == data and b"".join(media.chunks(moved)) == moved
    a, b = {media.digest(c) for c in media.chunks(data)}, {media.digest(c) for c in media.chunks(moved)}
    assert len(a & b) > 0.9 * len(a)
    assert all(media.LEAST <= len(c) <= media.MOST for c in media.chunks(data)[:-1])
    assert media.chunks(bytes(30_000)) and max(map(len, media.chunks(bytes(30_000)))) <= media.MOST


def brute_feature(payload):
    n = len(payload)
    counts = collections.Counter(payload)
    mean = sum(payload) / n
    rms = math.sqrt(sum((x - 128) ** 2 for x in payload) / n)
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return f"mean={mean:.4f};rms={rms:.4f};crossings={crossings};entropy={abs(entropy):.4f}"


def brute_media(text):
    raw = (text or "").encode()
    payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(16_000)
        w.writeframes(payload)
    stored = sink.getvalue()
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), brute_feature(payload))


def test_media(spark, docs, empty, rows):
    """Every column against the standard library's wave writer and plain loops."""
    path = media.store(docs)
    got = media.read(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(r[0], *brute_media(r[1])) for r in rows], key=str)
    # copies share their chunks: every digest is stored once, and shared files have none of their own
    chunks = {bytes(r.digest) for r in spark.read.parquet(f"{path}/chunks").collect()}
    assert len(chunks) == spark.read.parquet(f"{path}/chunks").count() > 0
    files = {r.doc_id: r for r in spark.read.parquet(f"{path}/files").collect()}
    texts = {r[0]: r[1] for r in rows}
    for doc_id, f in files.items():
        pieces = media.chunks(media.wave(media.payload_of(texts[doc_id])[1])) if doc_id is not None else []
        if pieces:  # the whole file is an ordered chunk list
            assert bytes(f.digests) == b"".join(map(media.digest, pieces))
            assert np.frombuffer(f.lengths, "<u4").tolist() == [len(c) for c in pieces]
            assert f.stored == sum(media.digest(c) in chunks for c in pieces)
    assert not files[3].own and not files[20].own and files[1].own and files[1].stored == 0
    assert media.read(spark, media.store(empty)).count() == 0


def test_damaged_media(spark, docs):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    path = media.store(docs.filter("doc_id < 3"))
    for name, column, value in (("file", "whole", F.lit(b"x")), ("chunk", "digests", F.concat(F.lit(b"0000000000000000"), F.expr("substring(digests, 17)")))):
        spark.read.parquet(f"{path}/files").withColumn(column, value).write.parquet(f"{path}/bad_{name}/files")
        spark.read.parquet(f"{path}/chunks").write.parquet(f"{path}/bad_{name}/chunks")
        with pytest.raises(PySparkException, match=f"a stored {name} does not match its digest"):
            media.read(spark, f"{path}/bad_{name}").collect()
