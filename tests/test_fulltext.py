"""Full-text search against SQLite's own, where it has it, and against plain Python."""

from __future__ import annotations

import random
import sqlite3

import pytest

from pairforge.operators import fulltext
from pairforge.plans.runner import Runner

WORDS = "ann bob cat dog eel".split()
SEARCHES = [
    "ann", "ANN bob", "ann AND bob", "ann OR bob cat", "ann NOT bob", "ann NOT bob NOT cat", "(ann OR bob) NOT (cat AND dog)", '"ann bob"', '"ann bob cat"', "ann + bob", "ca*", '"ann ca"*', "^ann", '^"ann bob"',
    "NEAR(ann bob)", "NEAR(ann bob, 1)", 'NEAR("ann bob" cat, 2)', "NEAR(ann bob cat, 3)", "NEAR(ann bob, 0) OR eel", "zzz", "ann zzz", "zzz OR dog", "NEAR(ann zzz)", "ann NOT zzz", '"ann" "bob"', "NEAR(ann, 2)",
]


def texts():
    rng = random.Random(4)
    rows = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    return [*rows, None, "Ann, BOB; cat-dog eel's", "catalogue", " ".join(["ann", *["x"] * 500, "bob"])]


@pytest.fixture(scope="module")
def engines(spark):
    rows = list(enumerate(texts()))
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    con.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, body string, term string").repartition(3)
    return con, fulltext.index(df, "id", "body"), Runner(spark, {"t": df})


@pytest.mark.parametrize("search", SEARCHES)
def test_same_as_sqlite(engines, search):
    con, postings, _ = engines
    want = [r[0] for r in con.execute("SELECT rowid FROM t WHERE t MATCH ? ORDER BY 1", (search,))]
    assert sorted(r.key for r in fulltext.search(postings, search).collect()) == want


def test_match_in_a_query(engines):
    con, _, runner = engines
    assert runner.run("SELECT id FROM t WHERE body MATCH 'ann'").error.startswith("UNSUPPORTED")
    runner.add_index("t", "body", "id")
    got = runner.run("SELECT count(*) FROM t AS u WHERE u.body MATCH '\"ann bob\" NOT cat' AND id > 20")
    assert got.rows == [[con.execute("SELECT count(*) FROM t WHERE t MATCH '\"ann bob\" NOT cat' AND rowid > 20").fetchone()[0]]]
    assert runner.run("SELECT id FROM t WHERE body MATCH 'ann AND'").error.startswith("UNSUPPORTED")


@pytest.mark.parametrize("search", ["ann AND", "(ann", "ann)", '"open', "NEAR(ann", "NEAR(, 3)", "NEAR(ann bob, x)", "OR ann", "AND*"])
def test_errors(search):
    with pytest.raises(fulltext.SearchError):
        fulltext.parse(search)


def test_reads_the_postings_of_its_terms(engines):
    plan = fulltext.search(engines[1], "ann OR ca*")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(term,ann),StringStartsWith(term,ca))]" in plan and plan.count("Exchange") == 1


def test_empty(spark):
    postings = fulltext.index(spark.createDataFrame([], "id string, body string"), "id", "body")
    assert fulltext.search(postings, "ann").collect() == [] and fulltext.search(postings, '"..."').collect() == []
