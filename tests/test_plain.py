"""Plain filters answered from columns: the same results as SQLite's, digests included."""

from __future__ import annotations

import random
import sqlite3

import pyarrow as pa
import pytest

from pairforge.plans import corpus, plain, runner

HEADER, TYPES = ["Cust No", "Customer Name", "Segment", "Balance", "n"], ["integer", "text", "text", "real", "number"]


def _table(n: int, seed: int) -> tuple[sqlite3.Connection, plain.Table]:
    draw = random.Random(seed)
    kinds = (
        lambda: str(draw.randint(-5, 50)),
        lambda: draw.choice(["Ann", "ann", "É", "é", "x'y", ""]),
        lambda: draw.choice(["AUTO", "auto", "B"]),
        lambda: draw.choice([str(draw.randint(-5, 12)), f"{draw.random() * 12 - 3:.2f}", "0", "-0.0", "nan"]),
        lambda: draw.choice(["1", "1.0", "2.5", "x"]),
    )
    con = sqlite3.connect(":memory:")
    runner.load_sqlite(con, "t_1", HEADER, TYPES, [[None if draw.random() < 0.1 else k() for k in kinds] for _ in range(n)])
    return con, plain.Table(con, "t_1")


def _same(con: sqlite3.Connection, table: plain.Table, sql: str, most: int) -> bool:
    """Whether the query was answered; if so, as by SQLite."""
    got, want = runner.run_plain(table, sql, most), runner.run_sqlite(con, sql, most=most)
    if got is None:
        return False
    got.columns = want.columns
    assert repr(got) == repr(want), sql
    return True


@pytest.mark.parametrize("n", [1, 7, 300])
def test_answers_are_those_of_sqlite(n):
    draw = random.Random(n)
    con, table = _table(n, n)
    columns = ["`Cust No`", "[Customer Name]", "Segment", "`BALANCE`", "n"]

    def test() -> str:
        c, number = draw.choice(columns), lambda: draw.choice(["3", "11", "-2", "- 1", "0"])
        kind = draw.randrange(4)
        if kind == 0:
            return f"{c} BETWEEN {number()} AND {number()}"
        if kind == 1:
            return f"{c} IS {draw.choice(['', 'NOT '])}NULL"
        return f"{c} {draw.choice('< > = != <> <= >= =='.split())} " + (number() if kind == 2 else draw.choice(["'AUTO'", "'x''y'", "'none'"]))

    def source() -> str:
        tests = [test() for _ in range(draw.randint(0, 3))]
        return f"FROM {draw.choice(['t_1', 'T_1', '`t_1`'])}" + (" WHERE " + f" {draw.choice(['AND', 'or'])} ".join(tests) if tests else "")

    answered = 0
    for _ in range(1500):
        c, order = draw.choice(columns), lambda *some: ", ".join(draw.choice(some) + draw.choice(["", " DESC"]) for _ in range(2))
        sql = draw.choice(
            [
                f"SELECT {c}, {draw.choice(columns)} {source()}",
                f"SELECT {c} {source()} ORDER BY {order(*columns)}",
                f"SELECT COUNT(*) AS m {source()}",
                f"SELECT {c}, count(*) AS m {source()} GROUP BY {c} ORDER BY m DESC, {c}",
                f"SELECT DISTINCT {c} {source()} ORDER BY {c}",
                f"WITH rich AS (SELECT Segment, {c} {source()}) SELECT DISTINCT {c} FROM rich ORDER BY {c}",
            ]
        )
        answered += _same(con, table, sql, draw.choice([0, 1, 10_000]))
    assert answered > 500


def test_the_scans_of_a_catalog_are_answered():
    """Those forms that have thousands of constants; SQLite scanned the table for each of them before."""
    con, table = _table(50, 1)
    parts = {"t": "t_1", "x": "3", "y": "9", "s": "AUTO", "p": "au", "l": "1"}
    forms = [t.format(**parts) for t in corpus.TEMPLATES]
    assert [i for i, q in enumerate(forms) if _same(con, table, q, 1)] == [0, 1, 2, 5, 6, 8]
    gold = "SELECT `Customer Name` FROM t_1 WHERE `Balance` > 3"
    assert all(_same(con, table, q, 0) for q in (gold, gold.upper(), gold + " ORDER BY `Cust No` DESC"))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT `Missing` FROM t_1",
        "SELECT Segment FROM t_1 WHERE Segment > 3",
        "SELECT Segment FROM t_1 WHERE Balance = '3'",
        "SELECT Segment FROM t_1 WHERE Balance > 3.1",
        "SELECT Segment FROM t_1 WHERE Balance > 99999999999999999999",
        "SELECT Segment FROM t_1 WHERE Balance > #",
        "SELECT Segment FROM t_1 WHERE /* 5 */ Balance > 3",
        "SELECT Segment FROM t_1 WHERE NOT Balance > 3",
        "SELECT Segment FROM t_1 LIMIT 3",
        "SELECT Segment FROM t_1; DELETE FROM t_1",
        "SELECT Segment FROM t_2",
        "SELECT Segment, COUNT(*) AS m FROM t_1 GROUP BY Segment ORDER BY m",
        "",
        None,
    ],
)
def test_the_rest_is_left_to_sqlite(sql):
    _, table = _table(9, 2)
    assert runner.run_plain(table, sql) is None


def test_a_changed_table_shares_equal_columns():
    """Columns of other values, types or places of a zero's sign are its own; results of shared ones are known."""
    con, table = _table(60, 3)
    con.execute('CREATE TABLE "t_2" ("Who" TEXT, "Segment" TEXT, "Balance" REAL)')
    con.execute('INSERT INTO t_2 SELECT "Customer Name", upper(Segment), round(Balance + 1, 2) FROM t_1')
    other = plain.Table(con, "t_2", table)
    assert other.columns[0] is table.columns[1] and not {*other.columns[1:]} & {*table.columns}
    for sql in ("SELECT Who FROM t_2 WHERE Who = 'Ann'", "SELECT Segment FROM t_2 WHERE Balance > 3", "SELECT Who, Balance FROM t_2 ORDER BY Balance DESC, Who"):
        assert _same(con, other, sql, 10)
    assert runner.run_plain(other, "SELECT Who FROM t_2 WHERE Who = 'Ann'", 0).digests == runner.run_plain(table, "SELECT `Customer Name` FROM t_1 WHERE `Customer Name` = 'Ann'", 0).digests


def test_pairs_of_a_query_and_its_variants_know_the_answer():
    """Capitals and spaces make no other query: the second of a pair is answered by the first; a reversed one by its own order."""
    con, table = _table(80, 4)
    gold = "SELECT `Customer Name` FROM t_1 WHERE `Balance` > 2"
    first = runner.run_plain(table, gold, 0)
    known = len(table.answers)
    assert runner.run_plain(table, gold.upper().replace(" ", "  ").replace("CUSTOMER  NAME", "CUSTOMER NAME"), 0).digests is first.digests and len(table.answers) == known
    down = runner.run_plain(table, gold + " ORDER BY `Cust No` DESC", 0)
    assert (down.digests.canonical, down.digests.n_rows) == (first.digests.canonical, first.digests.n_rows) and down.digests.sequence != first.digests.sequence
    assert down.digests == runner.run_sqlite(con, gold + " ORDER BY `Cust No` DESC", most=0).digests


def test_repeated_repairs_are_those_of_each_query():
    """Columns with digits, names in texts, numbers beside names, and queries that already hold the mark."""
    from pairforge.operators import evolution
    from pairforge.plans.dialect import rename_table

    queries = [t.format(t="table_1_1_3", x=x, y=x + 4000, s="BUILDING", p="bu", l=x % 3) for t in corpus.TEMPLATES for x in (7, 990099000, 9900)]
    queries += ["SELECT `Cust No`, 5, Balance FROM table_1_1_3 WHERE 3 > Balance -- 5", "SELECT CONCAT(`Balance`, Segment, 12) FROM table_1_1_3 LIMIT 3", "SELECT 1.5, Balance1, 2e3 FROM table_1_1_3 WHERE Segment = 'Cust No 5' AND x5 < 6", ""]
    changes = [
        evolution.Change("add_column", new={"Note 1": ("a",)}),
        evolution.Change("remove_column", columns=("Balance",)),
        evolution.Change("remove_column", columns=("No 5",)),
        evolution.Change("rename_column", names={"Cust No": "Cust No (2)", "Balance": "Balance2"}),
        evolution.Change("split_column", columns=("Customer Name",), new={"Customer Name 1": (), "Customer Name 2": ()}, separator=" "),
        evolution.Change("merge_column", columns=("Segment", "Balance"), new={"Segment and Balance 7": ()}),
    ]
    for change in changes:
        repaired = evolution.repeated_repair(change, lambda q: rename_table(q, "table_1_1_3", "table_m_12"))
        for q in queries * 2:
            want = evolution.repair(q, change)
            assert repaired(q) == (want if want == evolution.UNANSWERABLE else rename_table(want, "table_1_1_3", "table_m_12")), (q, change)


def test_an_evolution_scans_no_table_for_a_plain_filter(spark, monkeypatch):
    """300 thresholds before and after a change; SQLite's steps were those of a scan for each of them."""
    from pairforge.plans import stages

    kept: list = []
    monkeypatch.setattr(stages, "with_tables", lambda *a, **k: type("Groups", (), {"mapInArrow": lambda self, work, schema: kept.append(work)})())
    asked = []
    monkeypatch.setattr(stages, "run_sqlite", lambda con, q, **k: asked.append(q) or runner.run_sqlite(con, q, **k))
    rows = [{"row_id": i, "table_id": "1", "sql": f"SELECT `Customer Name` FROM t_1 WHERE `Balance` > {i}"} for i in range(300)]
    stages.evolve(spark.createDataFrame(rows, "row_id int, table_id string, sql string"), None, most=0)
    data = [[str(i), f"name {i}", "AUTO", str(i % 97)] for i in range(400)]
    batch = pa.RecordBatch.from_pylist([{"asked": rows, "name": "t_1", "header": HEADER[:4], "types": TYPES[:4], "rows": data}])
    out = [r for b in kept[0](iter([batch])) for r in b.to_pylist()]
    merged = [r for r in out if r["new_sql"] != "unanswerable"]
    assert len(out) == 300 and len(merged) > 100 and all(r["db_query_match"] and r["accepted"] == (r["row_id"] < 96 or "merge" in r["schema_change_type"] or "remove" in r["schema_change_type"] or "split" in r["schema_change_type"]) for r in merged)
    assert not asked
