"""Running queries and telling what came of them.

Two ways: :class:`Runner` registers tables as views and runs rewritten queries on
Spark, for tables of any size. :func:`execute_all` runs many queries over many
small tables, each inside one task on an in-memory SQLite database, so both the
number of tables and the number of queries scale out and results are SQLite's own.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.operators import fulltext
from pairforge.plans import dialect, plain
from pairforge.plans.digests import Digests, digests
from pairforge.plans.digests import canonical_row as _canonical_row


@dataclass
class ExecResult:
    """What a query gave: ``status`` is rows, empty or error.

    Where ``truncated``, ``rows`` are the first rows only; ``digests`` then stand for all of them.
    """

    status: str
    columns: list[str] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    error: str | None = None
    truncated: bool = False
    digests: Digests | None = None


def canonical(rows: Sequence[Sequence]) -> list[str]:
    """Rows as sorted JSON: strings lower-case, bytes decoded, whole floats as integers, nulls kept."""
    return sorted(map(_canonical_row, rows))


def same_result(a: ExecResult, b: ExecResult, ordered: bool = False) -> bool | None:
    """Equal results: as multisets, or row by row. An error equals nothing.

    Truncated results are compared by the digests of all their rows; null if one has none.
    """
    if "error" in (a.status, b.status):
        return False
    if a.truncated or b.truncated or a.digests and b.digests:
        x, y = (r.digests if r.truncated or r.digests else digests(r.rows) for r in (a, b))
        if x is None or y is None:
            return None
        return x.n_rows == y.n_rows and (x.sequence == y.sequence if ordered else x.canonical == y.canonical)
    if ordered:
        return [list(r) for r in a.rows] == [list(r) for r in b.rows]
    return canonical(a.rows) == canonical(b.rows)


_KINDS = ((T.IntegralType, "integer"), (T.FractionalType, "real"), (T.StringType, "text"))


class Runner:
    """Tables as views of one session that speaks the dialect; the caller's session is untouched."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, max_rows: int = 10_000):
        self.session = spark.newSession()
        self.session.conf.set("spark.sql.ansi.enabled", "false")
        for shim in dialect.SHIMS:
            self.session.sql(shim)
        self.max_rows, self.columns, self.tables, self.indexes = max_rows, {}, [], {}
        for name, df in (tables or {}).items():
            self.register(name, df)

    def register(self, name: str, df: DataFrame) -> None:
        """A view under the logical column names."""
        # a global view is what sessions share; the session's own view keeps the plan
        shared = f"pairforge_{uuid.uuid4().hex}"
        df.createGlobalTempView(shared)
        self.session.table(f"global_temp.{shared}").createOrReplaceTempView(name)
        df.sparkSession.catalog.dropGlobalTempView(shared)
        self.tables.append(name)
        for f in df.schema:
            self.columns[f.name.lower()] = next((k for t, k in _KINDS if isinstance(f.dataType, t)), "other")

    def exists(self, *candidates: str) -> str | None:
        """The first of some names that is a view."""
        return next((c for c in candidates if self.session.catalog.tableExists(c)), None)

    def add_index(self, name: str, column: str, key: str) -> None:
        """Rows of a view whose ``column`` has to MATCH are found by an index of its terms; ``key`` tells the rows."""
        self.indexes[column.lower()] = (key, fulltext.index(self.session.table(name), key, column))

    def _found(self, column: str, expression: str) -> str:
        """A condition that holds for the rows that a search finds."""
        if column.lower() not in self.indexes:
            raise dialect.UnsupportedQuery(f"MATCH without an index of {column}")
        key, postings = self.indexes[column.lower()]
        view = f"pairforge_found_{uuid.uuid4().hex}"
        try:
            fulltext.search(postings, expression).createOrReplaceTempView(view)
        except fulltext.SearchError as e:
            raise dialect.UnsupportedQuery(f"MATCH: {e}") from e
        return f"`{key}` IN (SELECT key FROM {view})"

    def query(self, sql: str) -> DataFrame:
        """The rewritten query as a DataFrame."""
        return self.session.sql(dialect.rewrite(sql, self.columns, tuple(self.tables), self._found))

    def run(self, sql: str) -> ExecResult:
        """Rows up to ``max_rows``, or the error."""
        try:
            df = self.query(sql)
            rows = df.limit(self.max_rows + 1).collect()
        except dialect.UnsupportedQuery as e:
            return ExecResult("error", error=f"UNSUPPORTED: {e}")
        except PySparkException as e:
            return ExecResult("error", error=e.getCondition() or str(e).splitlines()[0])
        kept = [list(r) for r in rows[: self.max_rows]]
        return ExecResult("rows" if kept else "empty", df.columns, kept, None if kept else "No result found", len(rows) > self.max_rows)


def correct(generate: Callable[[str | None], str], run: Callable[[str], ExecResult], most: int = 3, differs_from: str | None = None) -> tuple[str | None, ExecResult, int]:
    """Generate, run, and generate again with the error, up to ``most`` more times; an empty result is a failure.

    Returns the query that ran last, its own result and the number of attempts.
    """
    error: str | None = None
    sql, result = None, ExecResult("error", error="no attempt")
    for attempt in range(1, most + 2):
        sql = generate(error)
        if differs_from is not None and " ".join(sql.split()).lower() == " ".join(differs_from.split()).lower():
            result = ExecResult("error", error="the query must differ from the first")
        else:
            result = run(sql)
        if result.status == "rows":
            return sql, result, attempt
        error = result.error
    return sql, result, most + 1


# -- many small tables ------------------------------------------------------------------------
def _value(text: str | None, kind: str):
    if text is None:
        return None
    try:
        if kind in ("integer", "int"):
            return int(text)
        if kind in ("number", "real", "float", "double", "numeric"):
            x = float(text)
            return int(x) if x.is_integer() and "." not in text and "e" not in text.lower() else x
    except ValueError:
        return None
    return text


def load_sqlite(con: sqlite3.Connection, name: str, header: Sequence[str], types: Sequence[str], rows: Sequence[Sequence[str | None]]) -> None:
    """One web table as a SQLite table under its logical names; short rows are filled with null."""
    n = len(header)
    kinds = [(types[i] if i < len(types) else "text").lower() for i in range(n)]
    sql_types = ["INTEGER" if k in ("integer", "int") else "REAL" if k in ("number", "real", "float", "double", "numeric") else "TEXT" for k in kinds]
    con.execute('CREATE TABLE "{}" ({})'.format(name.replace('"', '""'), ", ".join('"{}" {}'.format(h.replace('"', '""'), t) for h, t in zip(header, sql_types, strict=True))))
    con.executemany('INSERT INTO "{}" VALUES ({})'.format(name.replace('"', '""'), ",".join("?" * n)), [[_value(r[i], kinds[i]) if i < len(r) else None for i in range(n)] for r in rows])


def run_sqlite(con: sqlite3.Connection, sql: str, steps: int = 50_000_000, most: int = 10_000, seen: dict | None = None) -> ExecResult:
    """One read-only query, stopped after so many steps of SQLite's machine.

    The first ``most`` rows are kept; the digests are of all rows (``seen`` as of :func:`digests`).
    """
    if not sql or sql.lstrip()[:6].lower() not in ("select", "values") and sql.lstrip()[:4].lower() != "with":
        return ExecResult("error", error="not a query")
    left = [steps // 1000]

    def tick() -> int:
        left[0] -= 1
        return left[0] < 0

    con.set_progress_handler(tick, 1000)
    try:
        cursor = con.execute(sql)
        first = list(islice(cursor, most))
        found = digests(chain(first, cursor), seen)
    except (sqlite3.Error, sqlite3.Warning, OverflowError) as e:
        return ExecResult("error", error=str(e))
    finally:
        con.set_progress_handler(None, 0)
    names = [d[0] for d in cursor.description or ()]
    return ExecResult("rows" if found.n_rows else "empty", names, [list(r) for r in first], None if found.n_rows else "No result found", found.n_rows > most, found)


def run_plain(table: plain.Table | None, sql: str | None, most: int = 10_000, seen: dict | None = None) -> ExecResult | None:
    """As :func:`run_sqlite`, for a query that needs no scan of its own (without the names of its columns); None for others."""
    found = table and table.answer(sql, most, seen)
    if not found:
        return None
    rows, all_ = found
    return ExecResult("rows" if all_.n_rows else "empty", [], [list(r) for r in rows], None if all_.n_rows else "No result found", all_.n_rows > most, all_)


#: Queries that travel with one copy of their table, at least and at most (twice the table's rows between them, so that
#: copies grow no faster than queries do); groups of a table up to which equal queries stay together; results that are sent back together.
GROUP, GROUP_MOST, TOGETHER, SENT = 256, 1 << 18, 16, 64
RESULT = "status string, columns array<string>, result array<string>, error string, truncated boolean, outcome struct<n_rows:bigint,multiset:string,canonical:string,sequence:string>"
_RESULT_NAMES = ("status", "columns", "result", "error", "truncated", "outcome")


def with_tables(queries: DataFrame, tables: DataFrame, table_id: str = "table_id", sql: str = "sql") -> DataFrame:
    """Groups of rows of one table with that table: ``asked`` (the rows), ``name, header, types, rows``; nulls where there is none.

    A group has about ``GROUP`` rows, or twice as many as its table where that is more. A hot table's rows are dealt over
    as many groups as it takes, so none grows with the data; equal rows are counted, and the counts dealt in portions.
    Equal queries of a table with few groups meet in one of them, and can be run once. Each group gets its own copy of
    the table by key and group, so groups of one table are not bound to one task.
    """
    rows = queries.select(F.col(table_id).alias("_id"), F.struct(*[f"`{c}`" for c in queries.columns]).alias("_row"))
    counted = rows.groupBy("_id", "_row").agg(F.count(F.lit(1)).alias("_n"))
    sizes = tables.select(F.col("id").alias("_id"), (2 * F.size("rows")).alias("_size"))
    size = F.greatest(F.lit(GROUP), F.least(F.lit(GROUP_MOST), F.col("_size")))
    many = counted.groupBy("_id").agg(F.sum("_n").alias("_all")).join(sizes, "_id", "left").select("_id", F.ceil(F.col("_all") / size).alias("_groups"))
    portions = counted.withColumn("_portion", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / GROUP).cast("int"))))
    placed = portions.alias("r").join(many.alias("m"), F.col("r._id").eqNullSafe(F.col("m._id")))
    copies = F.array_repeat("_row", F.least(F.lit(GROUP), F.col("_n") - GROUP * F.col("_portion")).cast("int"))
    place = F.when(F.col("_groups") <= TOGETHER, F.xxhash64(F.col("_row")[sql])).otherwise(F.xxhash64("_row", "_portion"))
    dealt = placed.select("r._id", copies.alias("_rows"), F.pmod(place, F.col("_groups")).alias("_group"))
    groups = dealt.groupBy("_id", "_group").agg(F.flatten(F.collect_list("_rows")).alias("asked"))
    copied = tables.select(F.col("id").alias("_id"), "name", "header", "types", "rows").join(many, "_id").withColumn("_group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_groups") - 1)))
    return groups.join(copied, ["_id", "_group"], "left").select("asked", "name", "header", "types", "rows")


def by_query(asked: pa.Array, sql: str) -> pa.Array:
    """The rows of a group with equal queries side by side."""
    return asked.take(pc.sort_indices(pc.struct_field(asked, sql)))


def execute_all(queries: DataFrame, tables: DataFrame, sql: str = "sql", table_id: str = "table_id", most: int = 10_000) -> DataFrame:
    """Run each row's query on its own table; adds ``status``, ``columns``, ``result`` (rows as JSON), ``error``, ``truncated`` and ``outcome``.

    ``result`` holds the first ``most`` rows, ``truncated`` tells that there are more.
    ``outcome`` stands for all rows (their number and digests) and is what
    :func:`results_match` compares; it is null after an error.

    ``tables`` has (id, name, header, types, rows). Queries travel in the groups of
    :func:`with_tables`, and a table is sent and loaded once for each group; a table with
    a million queries is many groups, which any task may run. Equal queries of a group
    are run once, and plain filters by :mod:`plain` without a scan of SQLite's for each. Rows without a table get an error.
    """
    kept = [f for f in queries.schema.fields if f.name not in _RESULT_NAMES]
    schema = T.StructType([*kept, *T._parse_datatype_string(RESULT).fields])
    arrow = to_arrow_schema(schema)

    joined = with_tables(queries.select(*[f"`{f.name}`" for f in kept]), tables, table_id, sql)

    def asked_of(con: sqlite3.Connection | None, table: plain.Table | None, q: str | None, seen: dict, names: dict) -> ExecResult:
        if con is None:
            return ExecResult("error", error="no such table")
        found = run_plain(table, q, most, seen)
        if found is None:
            return run_sqlite(con, q, most=most, seen=seen)
        shape = plain.constants(q)[0]
        if shape not in names:
            names[shape] = [d[0] for d in con.execute(q).description]
        found.columns = names[shape]
        return found

    def ran(con: sqlite3.Connection | None, table: plain.Table | None, q: str | None, seen: dict, names: dict) -> dict:
        r = asked_of(con, table, q, seen, names)
        outcome = r.digests and {"n_rows": r.digests.n_rows, "multiset": r.digests.multiset, "canonical": r.digests.canonical, "sequence": r.digests.sequence}
        return {"status": r.status, "columns": r.columns, "result": [json.dumps(v, ensure_ascii=False, default=str) for v in r.rows], "error": r.error, "truncated": r.truncated, "outcome": outcome}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = by_query(batch.column(0)[i].values, sql)
                name, header, types, data = (c[i].as_py() for c in batch.columns[1:])
                con = table = None
                if header is not None:
                    con = sqlite3.connect(":memory:")
                    load_sqlite(con, name, header, types or [], data or [])
                    table = plain.Table(con, name)
                seen, names, last = {}, {}, None
                for begin in range(0, len(asked), SENT):
                    out = []
                    for row in asked.slice(begin, SENT).to_pylist():
                        if last is None or last[0] != row[sql]:
                            last = row[sql], ran(con, table, row[sql], seen, names)
                        out.append(row | last[1])
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                if con is not None:
                    con.close()

    return joined.mapInArrow(run, schema)


def canonical_rows(result: str) -> Column:
    """JSON rows of a result as a sorted, lower-case array."""
    return F.array_sort(F.transform(F.col(result), lambda r: F.lower(r)))


def results_match(a: str, b: str, ordered: bool = False) -> Column:
    """Equality of two whole results by their ``outcome`` columns, row by row or as multisets; null outcomes match nothing.

    As with :func:`same_result`, whole floats are integers in both.
    """
    kind = "sequence" if ordered else "canonical"
    same = (F.col(a)["n_rows"] == F.col(b)["n_rows"]) & (F.col(a)[kind] == F.col(b)[kind])
    return F.coalesce(same, F.lit(False)).cast("double")
