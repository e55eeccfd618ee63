"""Many queries over larger tables: what is run once, and results beyond the rows that are kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairforge.plans import runner, stages


@pytest.fixture(scope="module")
def large(spark):
    """One table of 12,000 rows."""
    rows = F.transform(F.sequence(F.lit(1), F.lit(12_000)), lambda i: F.array(i.cast("string"), F.concat(F.lit("n"), i)))
    return spark.range(1).select(F.lit("1-1-1").alias("id"), F.lit("table_1_1_1").alias("name"), F.array(F.lit("k"), F.lit("n")).alias("header"), F.array(F.lit("integer"), F.lit("text")).alias("types"), rows.alias("rows"), F.lit(0).alias("pos"))


@pytest.fixture(scope="module")
def asked(spark):
    """Two thousand rows of four queries."""
    sql = F.concat(F.lit("SELECT n FROM table_1_1_1 WHERE k > "), F.col("id") % 4)
    return spark.range(2000).select(F.col("id").alias("row_id"), F.lit("1-1-1").alias("table_id"), sql.alias("sql"))


def test_copies_of_a_table_are_bounded_by_its_queries(large, asked):
    """A large table is not sent along with every 256 queries, and equal queries of a small table's few groups meet."""
    assert runner.with_tables(asked, large).count() == 1
    small = large.withColumn("rows", F.slice("rows", 1, 10))
    groups = runner.with_tables(asked, small).select(F.monotonically_increasing_id().alias("g"), F.explode(F.array_distinct("asked.sql")).alias("q"))
    assert groups.groupBy("q").count().filter("count > 1").count() == 0


def test_rows_kept_do_not_change_the_outcome(large, asked):
    few = asked.filter("row_id < 8")
    got = {r.row_id: r for r in runner.execute_all(few, large, most=1).collect()}
    assert [(len(r.result), r.truncated, r.outcome.n_rows, r.status) for _, r in sorted(got.items())] == [(1, True, 12_000 - i % 4, "rows") for i in range(8)]
    none = {r.row_id: r for r in runner.execute_all(few, large, most=0).collect()}
    assert all(none[i].status == "rows" and none[i].result == [] and none[i].outcome == got[i].outcome for i in got)


def test_remembered_rows_have_the_same_digests():
    rows = [(1, "A"), (1.0, "A"), (0.0, None), (-0.0, None), (b"x", "é"), (1, "A"), (2.5, "a")]
    seen: dict = {}
    assert runner.digests(rows, seen) == runner.digests(rows) == runner.digests(rows, seen)
    assert runner.digests([]) == runner.digests([], {})


def test_evolved_groups(large, asked):
    """What a row gives does not depend on the rows beside it, nor on the rows that are kept."""
    few = asked.filter("row_id < 40")
    columns = ("row_id", "schema_change_type", "new_sql", "status", "db_query_match", "accepted")
    whole = sorted(map(tuple, stages.evolve(few, large, most=0).select(*columns).collect()))
    alone = [tuple(stages.evolve(few.filter(F.col("row_id") == i), large).select(*columns).first()) for i in (0, 13, 26)]
    assert len(whole) == 40 and [whole[i] for i in (0, 13, 26)] == alone
    assert {r[4] for r in whole if r[3] == "rows"} == {True}


def test_generated_result_is_counted_whole(large):
    r = stages.generate(large).first()
    assert (len(r.db_result), r.db_result_truncated, r.db_result_rows) == (10_000, True, 12_000)
