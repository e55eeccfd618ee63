"""The stages of a run, with rules in the place of models."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pairforge.operators import evolution
from pairforge.plans import stages
from pairforge.sources import fixtures


def test_generate(spark):
    got = stages.generate(fixtures.tables(spark)).orderBy("table_id").collect()
    assert [(r.table_id, r.seeding_type, r.attempts) for r in got] == [("1-204-7", "reserved", 1), ("1-310-2", "persona", 1), ("1-415-9", "reserved", 1)]
    assert json.loads(got[1].db_result[0]) == ["Gil Moss", 1] or json.loads(got[1].db_result[0])[1] >= 1
    assert "col" in got[0].db_sql and "`" in got[0].sql
    assert [r.asDict() for r in stages.generate(fixtures.tables(spark).repartition(3)).orderBy("table_id").collect()] == [r.asDict() for r in got]


def test_generate_corrects_itself(spark):
    def factory():
        def model(text):
            return "```sql\nSELECT 1\n```" if "no such column" in text else "SELECT missing FROM table_1_204_7"

        return model

    got = stages.generate(fixtures.tables(spark).filter("pos = 0"), factory).collect()
    assert [(r.sql, r.attempts) for r in got] == [("SELECT 1", 2)]
    assert stages.generate(fixtures.tables(spark), lambda: lambda text: "nonsense").count() == 0


def test_evolve(spark):
    q = fixtures.queries(spark)
    got = stages.evolve(q, fixtures.tables(spark)).collect()
    assert len(got) == q.count()
    assert all(r.status in ("rows", "empty", "unanswerable") for r in got), [(r.new_sql, r.status) for r in got]
    for r in got:
        assert (r.new_sql == evolution.UNANSWERABLE) == (r.status == "unanswerable")
        if r.schema_change_type in ("add_column", "rename_column"):
            assert r.accepted and r.db_query_match, r
    all_kinds = stages.evolve(q, fixtures.tables(spark), kinds=("rename_column",), seed=7).collect()
    assert all(r.db_query_match for r in all_kinds)
    lost = stages.evolve(spark.createDataFrame([(0, "nope", "SELECT 1")], "row_id int, table_id string, sql string"), fixtures.tables(spark)).first()
    assert (lost.status, lost.accepted) == ("error", False)


def test_choose(spark):
    df = spark.createDataFrame([(0, 0.9, 0.1, "score: 0.9"), (1, 0.9, 0.9, "score: 0.1"), (2, 0.1, 0.6, None), (3, 0.1, 0.4, "score: 1")], "row_id int, pred double, reward double, answer string")
    got = stages.choose(df, "pred", "reward", "answer").orderBy("row_id").collect()
    assert [(r.row_id, r.filtered) for r in got] == [(0, "prompt"), (2, "reward")]


def test_translate(spark):
    q = fixtures.queries(spark).filter("row_id < 2").select("row_id", "nl")
    t = [(0, "es", 1, "", None, None), (0, "es", 2, "Lista de jugadores y números", 0.9, 0.9), (0, "de", 1, "Liste der Spieler", 0.1, 0.2), (1, "es", 4, "demasiado tarde para esto", 0.9, 0.9)]
    tr = spark.createDataFrame(t, "row_id int, lang string, attempt int, translation string, semantic_similarity double, back_translation_similarity double")
    got = stages.translate(q, tr).collect()
    assert [(r.row_id, r.lang, r.attempt, r.quality_stage) for r in got] == [(0, "es", 2, "pass")]


def test_entities(spark):
    df = spark.createDataFrame([("Which film by Oleh Danko won in Ukraine?",), (None,)], "nl string")
    got = [[e.text for e in r.entities] for r in stages.entities(df, "nl").collect()]
    assert got == [["Oleh Danko", "Ukraine"], []]


def test_relaxed(spark):
    df = spark.createDataFrame([('{"equivalent": false}',), ("```json\n{\"match\": true}\n```",), ("score: 0.9",), ("They are not equivalent",), ("Yes, same",), ("hm",)], "a string")
    assert [r[0] for r in df.select(stages.relaxed_match("a")).collect()] == [0.0, 1.0, 1.0, 0.0, 1.0, None]
    pairs = spark.createDataFrame([("SELECT 1", "SELECT  1"), ("SELECT 1", "SELECT 2")], "g string, p string")
    got = stages.judged_match(pairs, "g", "p", lambda: lambda text: "different" if "SELECT 2" in text else "same")
    assert sorted((r.p, r.relaxed) for r in got.collect()) == [("SELECT  1", 1.0), ("SELECT 2", 0.0)]


def test_timed_and_resume(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert [n for n, s in stages.timed(df, {"a": lambda d: d, "b": lambda d: d.filter(F.col("row_id") > 3)}) if s > 0] == ["a", "b"]
    assert stages.resume(df, df.filter("row_id < 4")).count() == 6


def test_experiments(spark):
    """Every strategy over the first two tables; judges choose among seeds, and by score."""
    import pytest

    t = fixtures.tables(spark)

    def factory():
        def model(text):
            n = text.split("Seeding: ")[1].split(" = ")[1].split("\n")[0]
            return json.dumps({"sql_query": f"SELECT '{n}' AS seed, COUNT(*) FROM \"{text.splitlines()[0][7:]}\"", "question": "?"})

        return model

    for strategy in stages.STRATEGIES[:4]:
        got = stages.experiment(t, strategy, 2, factory).collect()
        assert {(r.table_id, r.seeding_type, r.strategy) for r in got} == {("1-204-7", strategy, strategy), ("1-310-2", strategy, strategy)}
    assert {r.seeding_value for r in stages.experiment(t, "nl_to_sql", 3, factory).collect()} == {"question first"}
    assert all(3 <= int(r.seeding_value) <= 20 for r in stages.experiment(t, "length", 3, factory).collect())
    chosen = stages.experiment(t, "judge_select", 3, factory, judge=lambda: lambda options: (1.0, options[1].upper())).collect()
    second = {r.table_id: r.sql for r in stages.generate(t, factory, seed=43).collect()}
    assert {r.table_id: r.sql for r in chosen} == second
    assert stages.experiment(t, "judge_select", 3, factory, judge=lambda: lambda options: (9.0, options[0])).count() == 0
    scored = stages.experiment(t, "judge_score", 3, factory, judge=lambda: lambda options: (95.0 if "'" in options[0] else 0.0, ""))
    assert {r.sql for r in scored.collect()} == {r.sql for r in stages.generate(t, factory).collect()}
    assert stages.experiment(t, "judge_score", 3, factory, judge=lambda: lambda options: (89.0, "")).count() == 0
    with pytest.raises(ValueError):
        stages.experiment(t, "other")


def test_hot_tables_are_dealt_out(spark):
    """Twenty thousand queries of one table: no group holds more than a few hundred, and every query is run."""
    from pairforge.plans import runner

    q = spark.range(20_000).select(F.col("id").alias("row_id"), F.lit("1-204-7").alias("table_id"), F.concat(F.lit("SELECT "), "id", F.lit(" + COUNT(*) FROM table_1_204_7")).alias("sql"))
    groups = runner.with_tables(q, fixtures.tables(spark)).select(F.size("asked").alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert groups[0] < 2 * runner.GROUP and groups[1] == 20_000
    got = runner.execute_all(q, fixtures.tables(spark)).filter(F.get("result", F.lit(0)) == F.concat(F.lit("["), F.col("row_id") + 5, F.lit("]")))
    assert got.count() == 20_000


def test_evolution_by_plain_sqlite(spark):
    """Status and agreement of each row, from tables that the test builds and changes itself."""
    import sqlite3

    q = fixtures.queries(spark)
    tables = {t[0]: t for t in fixtures.TABLES}
    for kind in ("add_column", "rename_column"):
        for r in stages.evolve(q, fixtures.tables(spark), kinds=(kind,)).collect():
            _, header, types, data = tables[r.table_id]
            con = sqlite3.connect(":memory:")
            declared = ["REAL" if t == "real" else "TEXT" for t in types]
            name = "table_" + r.table_id.replace("-", "_")
            for table_, names in ((name, header), ("table_" + r.new_table_id.replace("-", "_"), header)):
                if table_ != name and kind == "rename_column":
                    old = next(h for h in header if f"{h} (renamed)" in r.new_sql) if "(renamed)" in r.new_sql else None
                    names = [f"{h} (renamed)" if h == old else h for h in names]
                con.execute(f"CREATE TABLE {table_} (" + ", ".join(f'"{h}" {t}' for h, t in zip(names, declared)) + ")")
                con.executemany(f"INSERT INTO {table_} VALUES ({','.join('?' * len(header))})", data)
            before, after = con.execute(r.sql).fetchall(), con.execute(r.new_sql).fetchall()
            assert r.status == ("rows" if after else "empty") and r.db_query_match == (sorted(map(str, before)) == sorted(map(str, after))) and r.accepted == bool(after)


def test_digests_by_definition():
    """Sums of the digests of every row's lower-case and canonical JSON, and the digest of all rows in order."""
    import hashlib

    from hypothesis import given
    from hypothesis import strategies as st

    from pairforge.plans import runner

    value = st.one_of(st.none(), st.integers(-5, 5), st.floats(-3, 3), st.sampled_from([1.0, 2.0, "ΑΣ", "Σ\n", "a'Σ'b", "É", "İ", b"Ab", "\x1f"]), st.text(max_size=4), st.booleans())

    @given(st.lists(st.lists(value, min_size=2, max_size=2), max_size=5))
    def check(rows):
        got, h = runner.digests(iter(rows)), lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=32).digest(), "little")
        dumped = [json.dumps(r, ensure_ascii=False, default=str) for r in rows]
        whole = [json.dumps([int(v) if isinstance(v, float) and v.is_integer() else v for v in r], ensure_ascii=False, default=str) for r in rows]
        assert got.n_rows == len(rows)
        assert int(got.multiset, 16) == sum(map(h, (d.lower() for d in dumped))) % (1 << 256)
        assert int(got.canonical, 16) == sum(h(runner._canonical_row(r)) for r in rows) % (1 << 256)
        assert got.sequence == hashlib.blake2b(b"".join(w.encode("utf-8", "surrogatepass") + b"\n" for w in whole), digest_size=32).hexdigest()

    check()


def test_whole_floats_match_in_both_modes(spark):
    """Results that are equal in order are equal as multisets, as same_result has it."""
    from pairforge.plans import runner

    tables = spark.createDataFrame([("t", "t", ["x"], ["integer"], [["1"], ["2"]])], "id string, name string, header array<string>, types array<string>, rows array<array<string>>")
    pairs = [("SELECT 1.0", "SELECT 1"), ("SELECT x FROM t", "SELECT x * 1.0 FROM t"), ("SELECT x FROM t ORDER BY x", "SELECT x FROM t ORDER BY x DESC"), ("SELECT 1.5", "SELECT 1"), ("SELECT 'A', 2.0", "SELECT 'a', 2"), ("SELECT nope", "SELECT nope")]
    df = spark.createDataFrame([(i, "t", a, b) for i, (a, b) in enumerate(pairs)], "id int, table_id string, a string, b string")
    out = runner.execute_all(df, tables, "a").withColumnRenamed("outcome", "left").drop(*runner._RESULT_NAMES)
    out = runner.execute_all(out, tables, "b").withColumnRenamed("outcome", "right")
    got = {r.id: (r.o, r.m) for r in out.select("id", runner.results_match("left", "right", True).alias("o"), runner.results_match("left", "right").alias("m")).collect()}
    assert got == {0: (1, 1), 1: (1, 1), 2: (0, 1), 3: (0, 0), 4: (0, 1), 5: (0, 0)}
    con = __import__("sqlite3").connect(":memory:")
    runner.load_sqlite(con, "t", ["x"], ["integer"], [["1"], ["2"]])
    for i, (a, b) in enumerate(pairs):
        assert got[i][1] == runner.same_result(runner.run_sqlite(con, a), runner.run_sqlite(con, b)), (a, b)


def test_equal_rows_are_many_groups(spark):
    from pairforge.plans import runner

    tables = spark.createDataFrame([("t", "t", ["x"], ["integer"], [["1"]])], "id string, name string, header array<string>, types array<string>, rows array<array<string>>")
    df = spark.range(20_000).select(F.lit("t").alias("table_id"), F.lit("SELECT x FROM t").alias("sql")).union(spark.createDataFrame([("u", "SELECT 1"), (None, "SELECT 2")], "table_id string, sql string"))
    sizes = [r.n for r in runner.with_tables(df, tables).select(F.size("asked").alias("n")).collect()]
    assert sum(sizes) == 20_002 and len(sizes) > 20_000 / runner.GROUP / 3 and max(sizes) < 12 * runner.GROUP
    out = runner.execute_all(df, tables).groupBy("table_id", "status").count().collect()
    assert sorted((r.table_id or "", r.status, r["count"]) for r in out) == [("", "error", 1), ("t", "rows", 20_000), ("u", "error", 1)]


def test_equal_pairs_have_one_answer(spark):
    """A judge that changes its mind is asked once about pairs that are equal."""

    def factory():
        said = iter(range(1000))
        return lambda prompt: f"score: {next(said) % 2}"

    df = spark.range(20, numPartitions=1).selectExpr("id", "'SELECT a' as gold", "if(id = 0, 'SELECT  a', 'SELECT b') as predicted")
    got = stages.judged_match(df, "gold", "predicted", factory).orderBy("id").collect()
    assert [r.relaxed for r in got] == [1.0] + [0.0] * 19
