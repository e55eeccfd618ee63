"""The dialect and the runner against SQLite itself."""

from __future__ import annotations

import sqlite3

import pytest

from pairforge.plans import dialect
from pairforge.plans.runner import ExecResult, Runner, canonical, correct, execute_all, load_sqlite, results_match, run_sqlite, same_result
from pairforge.sources import catalog, fixtures

QUERIES = [
    "SELECT Player, `No.` FROM table_1_204_7 ORDER BY `No.`, Player",
    "SELECT Player FROM table_1_204_7 WHERE Position LIKE 'GUARD' ORDER BY Player",
    "SELECT `No.`, COUNT(*) FROM table_1_204_7 GROUP BY `No.` ORDER BY COUNT(*) DESC, `No.`",
    "SELECT AVG(`Years in Club`) FROM table_1_204_7",
    "SELECT MAX(`Years in Club`) - MIN(`Years in Club`) FROM table_1_204_7",
    "SELECT 7/2, 7.0/2, 1/0",
    "SELECT COUNT(*)/2 FROM table_1_204_7",
    "SELECT CAST('12abc' AS INTEGER), CAST('3.7x' AS REAL), CAST('x' AS INTEGER)",
    "SELECT Player FROM table_1_204_7 ORDER BY Player LIMIT 1, 2",
    "SELECT GROUP_CONCAT(Position) FROM (SELECT Position FROM table_1_204_7 WHERE `No.` = 2)",
    "SELECT TOTAL(`Points scored`) FROM table_1_204_7 WHERE `No.` > 100",
    "SELECT IIF(`Points scored` > 10, 'hi', 'lo') FROM table_1_204_7 ORDER BY Player",
    "SELECT Player FROM table_1_204_7 WHERE Player GLOB '*o*' ORDER BY 1",
    "SELECT `Points scored`*2 AS d FROM table_1_204_7 WHERE d > 20 ORDER BY d",
    'SELECT "Player" FROM table_1_204_7 WHERE Position = "Guard" ORDER BY Player',
    "SELECT [Position], SUM(`Points scored`) FROM table_1_204_7 GROUP BY [Position] HAVING SUM(`Points scored`) > 5 ORDER BY 1",
    "WITH x AS (SELECT Player p, `Points scored` q FROM table_1_204_7), y AS (SELECT MAX(q) m FROM x) SELECT p FROM x JOIN y ON q = m",
    "SELECT strftime('%Y', '2020-03-04'), julianday('2000-01-01')",
    "SELECT Player FROM table_1_204_7 WHERE `Points scored` IS NULL UNION SELECT 'x' ORDER BY 1",
    "SELECT Player, RANK() OVER (ORDER BY `Points scored` DESC) FROM table_1_204_7 WHERE `Points scored` NOTNULL ORDER BY 2",
    "SELECT MAX(1,5), MIN(3,2)",
    "SELECT Position, Player FROM table_1_204_7 WHERE Position <> 'Guard' GROUP BY Position ORDER BY Position",
    "SELECT Player || '-' || Position FROM table_1_204_7 ORDER BY 1",
    "SELECT 'it''s'",
    "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n+1 FROM c WHERE n<4) SELECT n FROM c",
    "SELECT substr(Player,1,2), instr(Player,' '), ifnull(`Points scored`,0) FROM table_1_204_7 ORDER BY Player",
]


@pytest.fixture(scope="module")
def engines(spark):
    table_id, header, types, rows = fixtures.TABLES[0]
    con = sqlite3.connect(":memory:")
    load_sqlite(con, "table_1_204_7", header, types, rows)
    return con, Runner(spark, {"table_1_204_7": catalog.table_frame(spark, header, types, rows)})


@pytest.mark.parametrize("sql", QUERIES)
def test_same_as_sqlite(engines, sql):
    con, runner = engines
    want, got = run_sqlite(con, sql), runner.run(sql)
    assert want.status != "error", want.error
    assert got.status == want.status, got.error
    assert canonical(got.rows) == canonical(want.rows)


@pytest.mark.parametrize("sql", ["DROP TABLE table_1_204_7", "INSERT INTO t VALUES (1)", "PRAGMA user_version", ""])
def test_writes_are_refused(engines, sql):
    con, runner = engines
    assert runner.run(sql).status == "error"
    assert run_sqlite(con, sql).status == "error"


def test_errors_and_empty_results(engines):
    _, runner = engines
    assert runner.run("SELECT nothing FROM table_1_204_7").status == "error"
    assert runner.run("SELECT Player FROM table_1_204_7 WHERE `No.` = -1").status == "empty"
    assert runner.exists("nope", "table_1_204_7") == "table_1_204_7"


def test_session_is_apart(spark, engines):
    assert not spark.catalog.tableExists("table_1_204_7")


def test_fixture_queries_agree(spark):
    """All fixture queries, by Spark's dialect and by SQLite in the workers."""
    by_sqlite = {r.row_id: r for r in execute_all(fixtures.queries(spark), fixtures.tables(spark)).collect()}
    frames = {"table_" + i.replace("-", "_"): catalog.table_frame(spark, h, t, r) for i, h, t, r in fixtures.TABLES}
    for n, (table_id, _, sql) in enumerate(fixtures.QUERIES):
        name = "table_" + table_id.replace("-", "_")
        got = Runner(spark, {name: frames[name]}).run(sql)
        import json

        want = [json.loads(x) for x in by_sqlite[n].result]
        assert got.status == by_sqlite[n].status == "rows", (sql, got.error)
        assert canonical(got.rows) == canonical(want), sql


def test_execute_all_without_table(spark):
    q = spark.createDataFrame([(0, "no-such", "SELECT 1"), (1, None, None)], "row_id int, table_id string, sql string")
    rows = execute_all(q, fixtures.tables(spark)).collect()
    assert [r.status for r in rows] == ["error", "error"]


def test_whole_results_are_compared(spark):
    """Over 10,000 rows: another order, a difference in the last row, and rows that repeat."""
    numbers = "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 12000) SELECT "
    sqls = [f"{numbers}n FROM t", f"{numbers}n FROM t ORDER BY n DESC", f"{numbers}CASE WHEN n = 12000 THEN 0 ELSE n END FROM t", f"{numbers}n FROM t WHERE n < 12000", "SELECT nothing"]
    table_id = fixtures.TABLES[0][0]
    q = spark.createDataFrame([(i, table_id, s) for i, s in enumerate(sqls)], "row_id int, table_id string, sql string")
    found = execute_all(q, fixtures.tables(spark)).cache()
    assert [(r.truncated, r.outcome and r.outcome.n_rows, len(r.result)) for r in found.orderBy("row_id").collect()] == [(True, 12000, 10000)] * 3 + [(True, 11999, 10000), (False, None, 0)]
    pairs = found.selectExpr("row_id as a", "outcome as x").crossJoin(found.selectExpr("row_id as b", "outcome as y"))
    got = {(r.a, r.b): (r.m, r.o) for r in pairs.select("a", "b", results_match("x", "y").alias("m"), results_match("x", "y", True).alias("o")).collect()}
    assert [got[0, i] for i in range(5)] == [(1.0, 1.0), (1.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    assert got[4, 4] == (0.0, 0.0)
    con = sqlite3.connect(":memory:")
    a, b, c = (run_sqlite(con, s) for s in sqls[:3])
    assert same_result(a, b) and not same_result(a, b, ordered=True) and not same_result(a, c)
    assert same_result(a, ExecResult("rows", [], [[1]], truncated=True)) is None


def test_correction_loop():
    answers = iter(["bad", "empty", "good"])
    results = {"bad": ExecResult("error", error="x"), "empty": ExecResult("empty", error="No result found"), "good": ExecResult("rows", ["a"], [[1]])}
    seen = []

    def generate(error):
        seen.append(error)
        return next(answers)

    sql, result, attempts = correct(generate, results.__getitem__)
    assert (sql, result.rows, attempts, seen) == ("good", [[1]], 3, [None, "x", "No result found"])
    sql, result, attempts = correct(lambda e: "bad", results.__getitem__)
    assert (result.status, attempts) == ("error", 4)


def test_results_match():
    a, b = ExecResult("rows", [], [["A", None], [1.0, b"x"]]), ExecResult("rows", [], [[1, "X"], ["a", None]])
    assert same_result(a, b) and not same_result(a, b, ordered=True)
    assert not same_result(a, ExecResult("error"))


def test_names():
    sql = "WITH a AS (SELECT `No.` FROM t), b AS (SELECT 1) SELECT Player, Pos FROM a JOIN t"
    assert dialect.split_ctes(sql) == ["a", "b"]
    assert dialect.to_physical(sql, ["Player", "No.", "Position"], "table_9") == "WITH a AS (SELECT col1 FROM table_9), b AS (SELECT 1) SELECT col0, Pos FROM a JOIN table_9"
    assert dialect.rename_table("SELECT t.a FROM t", "t", "u") == "SELECT u.a FROM u"


#: Over all three fixture tables, named a, b and c.
MORE = [
    'SELECT * FROM a ORDER BY Player',
    'SELECT a.Player, b.Team FROM a JOIN b ON a.Position = b.Position',
    'SELECT a.Player, b.Player FROM a CROSS JOIN b WHERE b.`Pick #` = 1 ORDER BY 1',
    'SELECT Player FROM a WHERE `No.` IN (34, 7) ORDER BY Player',
    'SELECT GROUP_CONCAT(DISTINCT Team) FROM (SELECT Team FROM b WHERE `Pick #` < 2)',
    'SELECT COUNT(DISTINCT Team), COUNT(College), COUNT(*) FROM b',
    "SELECT Team, MIN(`Pick #`), Player FROM b WHERE Team='Prairie Owls' GROUP BY Team",
    "SELECT Player FROM a WHERE Player LIKE '%\\_%' ESCAPE '\\'",
    'SELECT Player FROM a WHERE `Points scored` BETWEEN 5 AND 20 ORDER BY `Points scored` DESC',
    'SELECT Position AS p, AVG(`Points scored`) AS avgp FROM a GROUP BY p ORDER BY avgp DESC, p',
    'SELECT AVG(`Points scored`) a FROM a HAVING a > 1',
    "SELECT Player, CASE Position WHEN 'Guard' THEN 1 ELSE 0 END FROM a ORDER BY 1",
    'SELECT UPPER(Player), LENGTH(Player), ROUND(`Points scored`, 1), ABS(-3), COALESCE(`No.`, 0) FROM a ORDER BY Player',
    'SELECT Player FROM a ORDER BY `Points scored` LIMIT 2',
    'SELECT Player FROM a ORDER BY `Points scored` DESC LIMIT 2 OFFSET 1',
    'SELECT Country, COUNT(*) c FROM c GROUP BY Country HAVING c > 1',
    'SELECT Position FROM a UNION ALL SELECT Position FROM b ORDER BY 1',
    'SELECT Position FROM a INTERSECT SELECT Position FROM b',
    'SELECT Position FROM a EXCEPT SELECT Position FROM b ORDER BY 1',
    'SELECT MAX(`Years in Club`) FROM a',
    'SELECT SUM(`Points scored`) / COUNT(*) FROM a',
    'SELECT SUM(`No.`) * 1.0 / 4 FROM a',
    'SELECT Player FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.Position = a.Position) ORDER BY Player',
    'SELECT (SELECT COUNT(*) FROM b WHERE b.Position = a.Position) n, Player FROM a ORDER BY Player',
    'SELECT Player FROM a WHERE `Points scored` = (SELECT MAX(`Points scored`) FROM a)',
    'SELECT substr(`Years in Club`, 1, 4) y, COUNT(*) FROM a GROUP BY y ORDER BY y',
    'SELECT CAST(substr(`Years in Club`, 1, 4) AS INTEGER) + 1 FROM a ORDER BY 1',
    'SELECT Player, ROW_NUMBER() OVER (PARTITION BY Position ORDER BY Player) FROM a ORDER BY Player',
    "SELECT replace(Player, ' ', '_'), trim('  x '), ltrim('  x'), rtrim('x  ') FROM a WHERE `No.`=7",
    'SELECT DISTINCT Nationality FROM a ORDER BY Nationality',
    "SELECT t1.Player FROM a AS t1 WHERE t1.`No.` > 5 AND t1.Position != 'Center' ORDER BY t1.Player",
    'SELECT Player FROM a WHERE Position IS NOT NULL AND `No.` IS NULL',
    "SELECT COUNT(*) FROM a WHERE `School/Club Team` LIKE '%o%'",
    'SELECT Team FROM b GROUP BY Team ORDER BY COUNT(*) DESC, Team LIMIT 1',
    'SELECT 5 % 3, 7 - 2 * 3, -5 / 2, 2 || 3',
    'SELECT AVG(`Pick #`), MIN(Player) FROM b',
    'SELECT Position, COUNT(*) FROM a WHERE `Points scored` > 1 GROUP BY Position HAVING COUNT(*) >= 1 ORDER BY 2 DESC, 1',
    "SELECT Player FROM a WHERE LOWER(Nationality) = 'canada' ORDER BY `No.` NULLS LAST",
    "SELECT `Film Name` || ' by ' || Director FROM c ORDER BY 1",
    "SELECT nullif(Position,'Guard') FROM a ORDER BY Player",
    "SELECT printf('%d', 3)",
    "SELECT Player FROM a WHERE `No.` > 'x'",
    "SELECT Team, College FROM b WHERE College IS NULL OR College = 'Laval' ORDER BY Player",
    "SELECT a.* FROM a WHERE Player = 'Ed Fox'",
    "SELECT round(AVG(`Points scored`),2) FROM a WHERE Position LIKE 'G%'",
    "SELECT SUM(CASE WHEN Position='DB' THEN 1 ELSE 0 END) * 100.0 / COUNT(*) FROM b",
    "SELECT SUM(CASE WHEN Position='DB' THEN 1 ELSE 0 END) / COUNT(*) FROM b",
    "SELECT Player FROM b NATURAL JOIN (SELECT 'DB' AS Position)",
    "SELECT Player FROM b JOIN (SELECT 'DB' AS Position) USING (Position) ORDER BY 1",
    "SELECT date('2020-01-31'), strftime('%m', '2020-03-04 05:06:07'), time('12:00')",
]


@pytest.fixture(scope="module")
def three(spark):
    con, frames = sqlite3.connect(":memory:"), {}
    for name, (_, header, types, rows) in zip("abc", fixtures.TABLES):
        load_sqlite(con, name, header, types, rows)
        frames[name] = catalog.table_frame(spark, header, types, rows)
    return con, Runner(spark, frames)


@pytest.mark.parametrize("sql", MORE)
def test_more_like_sqlite(three, sql):
    con, runner = three
    want, got = run_sqlite(con, sql), runner.run(sql)
    assert got.status == want.status, (got.error, want.error)
    assert canonical(got.rows) == canonical(want.rows)


# -- frames over groups of peers -----------------------------------------------------------------
@pytest.fixture(scope="module")
def peers(spark):
    """120 rows with ties, nulls and a group without a value, in SQLite and as a table."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.choice("abc"), rng.choice([None, 1, 2, 2, 3, 5, 8]), rng.choice([None, *range(-4, 9)])) for i in range(120)] + [(200, "z", 1, None), (201, "z", 1, None)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE t (id INTEGER, p TEXT, o INTEGER, x INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    return con, Runner(spark, {"t": spark.createDataFrame(rows, "id long, p string, o long, x long").repartition(3)})


FRAMES = [
    "GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING", "GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "GROUPS 2 PRECEDING", "GROUPS BETWEEN 1 FOLLOWING AND 2 FOLLOWING", "GROUPS BETWEEN 3 PRECEDING AND 1 PRECEDING",
    "GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING", "",
]


@pytest.mark.parametrize("exclude", ["", "EXCLUDE NO OTHERS", "EXCLUDE CURRENT ROW", "EXCLUDE GROUP", "EXCLUDE TIES"])
@pytest.mark.parametrize("part", ["PARTITION BY p ORDER BY o", "ORDER BY o DESC", "PARTITION BY p", "ORDER BY o, x"])
def test_groups_and_exclude(peers, part, exclude):
    con, runner = peers
    # the number of rows and of values, sums, extremes and means within each frame
    calls = [f"{f} OVER ({part} {frame or ('RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW' if exclude else '')} {exclude}) AS c{i}_{j}" for i, frame in enumerate(FRAMES) for j, f in enumerate(("count(*)", "count(x)", "sum(x + 1)", "max(x)", "min(x)", "avg(x)"))]
    for k in range(0, len(calls), 16):
        sql = f"SELECT id, {', '.join(calls[k : k + 16])} FROM t WHERE id <> 7 ORDER BY id"
        want, got = run_sqlite(con, sql), runner.run(sql)
        assert got.status == want.status == "rows", (sql, got.error, want.error)
        for a, b in zip(got.rows, want.rows, strict=True):
            assert a == pytest.approx(b), sql


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT *, sum(x) OVER (PARTITION BY p ORDER BY o GROUPS 1 PRECEDING) AS s FROM t ORDER BY id",
        "SELECT u.id, sum(u.x) OVER w AS a, count(*) OVER w AS b FROM t AS u WHERE u.p = 'a' WINDOW w AS (ORDER BY u.o GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) ORDER BY u.id",
        "SELECT id, s FROM (SELECT id, o, max(x) OVER (ORDER BY o GROUPS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS s FROM t) ORDER BY id",
        "SELECT id, sum(x) OVER (ORDER BY id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS s FROM t ORDER BY id",
        "SELECT id, first_value(id) OVER (PARTITION BY p ORDER BY id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS f FROM t ORDER BY id",
    ],
)
def test_frames_in_queries(peers, sql):
    con, runner = peers
    want, got = run_sqlite(con, sql), runner.run(sql)
    assert (got.status, got.error) == ("rows", None), dialect.rewrite(sql, runner.columns, ("t",))
    assert got.rows == want.rows


def test_frames_without_a_form(peers):
    runner = peers[1]
    for sql in (
        "SELECT sum(x) OVER (ORDER BY o ROWS 2 PRECEDING EXCLUDE GROUP) FROM t",
        "SELECT sum(x) OVER (ORDER BY o RANGE 2 PRECEDING EXCLUDE TIES) FROM t",
        "SELECT p, sum(count(*)) OVER (ORDER BY p GROUPS 1 PRECEDING) FROM t GROUP BY p",
        "SELECT group_concat(x) OVER (ORDER BY o GROUPS 1 PRECEDING EXCLUDE TIES) FROM t",
    ):
        assert runner.run(sql).error.startswith("UNSUPPORTED"), sql


def test_frames_to_the_end_grow(peers):
    """Frames of aggregates begin at the partition's end where they reach it; one that shrinks costs the square of its rows."""
    runner = peers[1]
    for exclude in ("", "EXCLUDE CURRENT ROW", "EXCLUDE GROUP", "EXCLUDE TIES"):
        sql = f"SELECT id, sum(x) OVER (PARTITION BY p ORDER BY o GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING {exclude}) AS s FROM t"
        assert "UNBOUNDED FOLLOWING" not in dialect.rewrite(sql, runner.columns, ("t",)).upper()
