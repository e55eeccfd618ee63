"""Registered queries over the driver's tables, each with the SQL that an oracle can run.

``QUERIES`` maps a name to ``(spark, dir) -> DataFrame`` and ``ORACLE_SQL`` to the
equivalent SQL where there is one. Names begin with the operator's number.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import sqlite3
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions import answers, register, seeded, similarity, sqltext, text
from pairforge.operators import aggregates, corruption, evolution, filters, metrics, rows, translation
from pairforge.plans import corpus, runner, sqltree
from pairforge.plans.dialect import rename_table
from pairforge.session import scratch_path, spread
from pairforge.sources import catalog, fixtures, sqlite_source
from pairforge.streaming import drops

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def _values(data: list[tuple], columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in data) + f") AS t({columns})"


_WC = "len(regexp_extract_all(coalesce({0}, ''), '\\S+'))"


def _wc(x: str) -> str:
    return _WC.format(x)


def r6(c):
    return F.round(c, 6)


# == scans, prompts, side outputs ==================================================================
@query("SELECT c_custkey, 'table_1_' || c_nationkey || '_' || c_custkey AS name, '1-' || c_nationkey || '-' || c_custkey AS id FROM customer")
def io1_table_ids(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws("-", F.lit("1"), "c_nationkey", "c_custkey").alias("raw"))
    return c.select("c_custkey", catalog.physical_name(F.col("raw")).alias("name"), catalog.logical_id(catalog.physical_name(F.col("raw"))).alias("id"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) n FROM conversations) WHERE n = 1")
def io3_last_of_each(spark, d):
    return catalog.last_of_each(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("SELECT CASE WHEN n_chars <= 2000 THEN 'accepted' ELSE 'rejected' END AS side, count(*) AS n, cast(sum(n_chars) as bigint) AS chars FROM documents GROUP BY 1")
def io14_side_outputs(spark, d):
    yes, no = translation.split_outputs(table(spark, d, "documents").withColumn("keep", F.col("n_chars") <= 2000))
    both = yes.withColumn("side", F.lit("accepted")).unionByName(no.withColumn("side", F.lit("rejected")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT c.c_custkey, n.n_name AS title, n.n_nationkey IS NOT NULL AS cached FROM customer c LEFT JOIN (SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN n_name END AS n_name FROM nation WHERE n_nationkey < 15) n ON c.c_nationkey = n.n_nationkey")
def io17_cache_lookup(spark, d):
    cache = table(spark, d, "nation").filter("n_nationkey < 15").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("title"))
    return catalog.cached(table(spark, d, "customer"), cache, "c_nationkey", "title").select("c_custkey", "title", "cached")


def _regions(spark, d):
    rows_ = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    t = table(spark, d, "nation").groupBy("n_regionkey").agg(rows_.alias("rows"))
    return t.select(F.concat(F.lit("region_"), "n_regionkey").alias("name"), F.array(F.lit("Key #"), F.lit("Nation")).alias("header"), F.array(F.lit("integer")).alias("types"), "rows")


_REGION_LINES = "(SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, n_nationkey, n_name FROM nation)"


@query("SELECT 'region_' || n_regionkey AS name, 'Table: region_' || n_regionkey || chr(10) || 'Columns:' || chr(10) || '  - Key # (INTEGER)' || chr(10) || '  - Nation (TEXT)' AS prompt FROM nation GROUP BY n_regionkey")
def io18_schema_text(spark, d):
    return _regions(spark, d).select("name", catalog.schema_text().alias("prompt"))


@query(f"SELECT 'region_' || n_regionkey AS name, '| Key # | Nation |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY k) AS sample FROM {_REGION_LINES} WHERE k <= 2 GROUP BY n_regionkey")
def io19_sample_markdown(spark, d):
    return _regions(spark, d).select("name", catalog.sample_markdown(2).alias("sample"))


@query(f"SELECT 'region_' || n_regionkey AS name, 'Table: region_' || n_regionkey || chr(10) || 'Columns: Key #, Nation' || chr(10) || 'Sample rows:' || chr(10) || string_agg('Key #: ' || n_nationkey || ', Nation: ' || n_name, chr(10) ORDER BY k) AS prompt FROM {_REGION_LINES} WHERE k <= 3 GROUP BY n_regionkey")
def io20_table_prompt(spark, d):
    return _regions(spark, d).select("name", catalog.table_prompt(3).alias("prompt"))


@query("SELECT 'count' AS summary, count(s_acctbal) * 1.0 AS v FROM supplier UNION ALL SELECT 'mean', round(avg(s_acctbal), 6) FROM supplier UNION ALL SELECT 'stddev', round(stddev_samp(s_acctbal), 6) FROM supplier UNION ALL SELECT 'min', min(s_acctbal) FROM supplier UNION ALL SELECT 'max', max(s_acctbal) FROM supplier")
def io21_describe(spark, d):
    return catalog.described(table(spark, d, "supplier").select("s_acctbal")).select("summary", F.round(F.col("s_acctbal").cast("double"), 6).alias("v"))


def _shared(spark, name: str) -> str:
    return scratch_path(spark, name)


def _local(path: str) -> str:
    """The shared folder as the file system has it; SQLite's files need one."""
    if re.match(r"^\w+:", path) and not path.startswith("file:"):
        raise ValueError(f"SQLite files need a mounted folder, not {path!r}")
    return re.sub("^file:/*", "/", path)


@query("SELECT '1-1-7' AS id, 'table_1_1_7' AS name, count(*) AS n FROM customer WHERE c_nationkey = 7")
def io2_find_table(spark, d):
    path = _shared(spark, "tables.jsonl")
    corpus.tables(spark, d).withColumn("id", F.when(F.col("pos") % 2 == 0, F.col("id")).otherwise(F.col("name"))).drop("name", "pos").write.json(path)
    t = catalog.read_tables(spark, path)
    return catalog.find_table(t, "table_1_1_7").select(catalog.logical_id(F.col("id")).alias("id"), "name", F.size("rows").alias("n"))


_BIRD = "(SELECT CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS db_id, ' Who is ' || c_name || '? ' AS question, CASE WHEN c_custkey % 7 > 0 THEN ' SELECT ' || c_custkey END AS SQL FROM customer)"


def _bird(spark, d) -> str:
    k, path = F.col("c_custkey"), _shared(spark, "bird.json")
    item = F.struct(F.when(k % 5 > 0, F.col("c_mktsegment")).alias("db_id"), F.concat(F.lit(" Who is "), "c_name", F.lit("? ")).alias("question"), F.when(k % 7 > 0, F.concat(F.lit(" SELECT "), k)).alias("SQL"))
    # an array of some hundred items in each line, as one array over all rows would be one value
    table(spark, d, "customer").groupBy(F.floor(k / 256)).agg(F.to_json(F.collect_list(item)).alias("value")).select("value").write.text(path)
    return path


@query(f"SELECT coalesce(db_id, '') AS db_id, trim(question) AS question, trim(SQL) AS sql FROM {_BIRD} WHERE SQL IS NOT NULL")
def io4_bird_scan(spark, d):
    return catalog.read_bird(spark, _bird(spark, d), lines=True).select("db_id", "question", F.col("SQL").alias("sql"))


@query("SELECT 7 AS n, 7 AS whole")
def io5_bird_head(spark, d):
    items = catalog.read_bird(spark, _bird(spark, d), 7, lines=True)
    return items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("SQL").startswith("SELECT ") & F.col("question").startswith("Who is")).alias("whole"))


_CSV = "SELECT c_custkey, c_name || CASE c_custkey % 3 WHEN 0 THEN ', the \"first\"' WHEN 1 THEN chr(10) || 'second line' ELSE '' END AS name, CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END AS balance FROM customer"


def _csv_rows(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, ', the "first"').when(k % 3 == 1, "\nsecond line").otherwise("")
    return table(spark, d, "customer").select(k, F.concat("c_name", tail).alias("name"), F.when(k % 4 > 0, F.col("c_acctbal")).alias("balance"))


@query(_CSV)
def io6_io12_csv(spark, d):
    path, rows_ = _shared(spark, "out.csv"), _csv_rows(spark, d)
    catalog.write_csv(rows_.limit(3), path)
    catalog.write_csv(rows_, path)  # the whole file again
    return catalog.read_csv(spark, path, rows_.schema)


@query(f"SELECT f AS suffix, x.* FROM ({_CSV}) x, (VALUES ('csv'), ('jsonl'), ('parquet')) AS t(f)")
def io7_by_suffix(spark, d):
    rows_ = _csv_rows(spark, d)
    out = None
    for suffix, kind in (("csv", None), ("jsonl", "json"), ("parquet", "parquet")):
        path = _shared(spark, f"x.{suffix}")
        catalog.write_csv(rows_, path) if kind is None else rows_.write.format(kind).save(path)
        part = catalog.read_any(spark, path, rows_.schema).select(F.lit(suffix).alias("suffix"), *rows_.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io8_sqlite_table(spark, d):
    sqlite_source.register(spark)
    return spark.read.format("sqlite").option("path", _sqlite(spark, d)).option("table", "nation").option("partitions", 3).load()


@query("SELECT t AS name, c AS columns FROM (VALUES ('nation', 'n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER'), ('region', 'r_regionkey INTEGER, r_name TEXT')) AS x(t, c)")
def io9_sqlite_catalog(spark, d):
    found = sqlite_source.catalog(_sqlite(spark, d))
    return spark.createDataFrame([(t, ", ".join(" ".join(c) for c in cs)) for t, cs in found.items()], "name string, columns string")


def _sqlite(spark, d) -> str:
    """A database of the two tables that do not grow with the data, in the shared folder."""
    path = _local(_shared(spark, "small.db"))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with contextlib.closing(sqlite3.connect(path)) as con:
        for name, declared in (("nation", "n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER"), ("region", "r_regionkey INTEGER, r_name TEXT")):
            con.execute(f"CREATE TABLE {name} ({declared})")
            columns = [c.split()[0] for c in declared.split(", ")]
            con.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(columns))})", [tuple(r) for r in table(spark, d, name).select(*columns).collect()])
        con.commit()
    return path


@query("SELECT 't' || c_nationkey AS name, count(*) AS n, round(sum(c_acctbal), 2) AS balance, min(c_name) AS first FROM customer GROUP BY c_nationkey")
def io10_sql_dump(spark, d):
    path = _shared(spark, "dumps")
    quote = F.concat(F.lit("INSERT INTO t"), "c_nationkey", F.lit(" VALUES ("), "c_custkey", F.lit(", '"), F.replace("c_name", F.lit("'"), F.lit("''")), F.lit("', "), "c_acctbal", F.lit(");"))
    script = F.concat(F.lit("CREATE TABLE t"), "c_nationkey", F.lit(" (k INTEGER, name TEXT, balance REAL); "), F.array_join(F.collect_list(quote), " "))
    table(spark, d, "customer").groupBy("c_nationkey").agg(script.alias("value")).select("value").write.text(path)
    sqlite_source.register(spark)
    read = spark.read.format("sqldump").option("path", _local(path) + "/part-*").load()
    data = F.from_json("data", "k long, name string, balance double")
    return read.select(F.col("table").alias("name"), data.alias("x")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.balance"), 2).alias("balance"), F.min("x.name").alias("first"))


@query("SELECT c_custkey, upper(c_name) AS name FROM customer")
def io11_io13_batches(spark, d):
    """Batches appended as they are done; the second run finds all of them written."""
    path = _shared(spark, "results")

    def work(part: DataFrame) -> DataFrame:
        return part.select("c_custkey", F.upper("c_name").alias("name"))

    c = table(spark, d, "customer")
    catalog.append_once(work(c.filter("c_nationkey < 5")), path, "c_custkey")  # a run that was stopped
    catalog.append_once(work(c.filter("c_nationkey < 7")), path, "c_custkey")
    return catalog.in_batches(c, path, "c_custkey", work, every=max(1, c.count() // 3))


@query("SELECT id, cast(count(*) AS bigint) AS n, cast(sum(n_rows) AS bigint) AS n_rows FROM (SELECT CASE k WHEN 0 THEN 'original' ELSE 'derived' END AS id, count(c_custkey) AS n_rows FROM customer, (VALUES (0), (1)) AS t(k) GROUP BY k, c_nationkey) GROUP BY id")
def io15_materialise(spark, d):
    path, t = _shared(spark, "catalog"), corpus.tables(spark, d).drop("pos")
    catalog.materialise(t, path)
    catalog.materialise(evolution.evolve_catalog(t, evolution.Change("rename_column", names={"Segment": "Sector"})).select(*t.columns), path)
    kind = F.when(F.array_contains("header", "Sector"), "derived").otherwise("original")
    return spark.read.parquet(path).groupBy(kind.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("rows")).alias("n_rows"))


@query("SELECT * FROM (VALUES ('1-204-7', 'table_1_204_7', 5, 7), ('1-310-2', 'table_1_310_2', 5, 5), ('1-415-9', 'table_1_415_9', 3, 5)) AS t(id, name, n, columns)")
def io16_example_catalog(spark, d):
    path = _shared(spark, "example.jsonl")
    fixtures.tables(spark).drop("name", "pos").write.json(path)
    return catalog.read_tables(spark, path).select("id", "name", F.size("rows").alias("n"), F.size("header").alias("columns"))


# == projections and filters =========================================================================
@query("SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE quality IS NOT NULL")
def p1_complete(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.complete(joined, ["quality"]).select("doc_id", "quality")


@query("SELECT c_custkey, c_name AS found, 'missing columns: nope, no' AS error FROM customer")
def p2_p10_columns(spark, d):
    c = rows.require(table(spark, d, "customer"), ["c_custkey", "c_name"])
    try:
        rows.require(c, ["nope", "c_name", "no"])
        error = None
    except ValueError as e:
        error = str(e)
    return c.select("c_custkey", F.col(rows.first_existing(c, ["title", "C_NAME", "c_custkey"])).alias("found"), F.lit(error).alias("error"))


@query("SELECT conv_id, turn FROM conversations WHERE regexp_matches(coalesce(text, ''), '\\S') AND regexp_matches(coalesce(role, ''), '\\S')")
def p3_p7_all_present(spark, d):
    return rows.all_present(table(spark, d, "conversations"), ["text", "role"]).select("conv_id", "turn")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 0 AND 1")
def p5_in_range(spark, d):
    return rows.in_range(table(spark, d, "events"), "value").select("event_id", "value")


@query(f"SELECT doc_id FROM documents WHERE {_wc('text')} <= 200")
def p6_at_most_tokens(spark, d):
    return rows.at_most_tokens(table(spark, d, "documents"), "text", 200).select("doc_id")


@query("SELECT part, count(*) AS n FROM (SELECT CASE WHEN contains(p_name, 'm') THEN 'derived' ELSE 'original' END AS part FROM part) GROUP BY part")
def p8_is_derived(spark, d):
    return table(spark, d, "part").groupBy(F.when(rows.is_derived("p_name"), "derived").otherwise("original").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def p9_unprocessed(spark, d):
    done = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return rows.unprocessed(table(spark, d, "customer"), done, "c_custkey").select("c_custkey")


@query("SELECT lang AS language, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS label, count(*) AS n FROM documents GROUP BY 1, 2")
def p11_rename_map(spark, d):
    named = rows.renamed(table(spark, d, "documents"), {"lang": "language"}).withColumn("label", rows.mapped("language", {"en": "English", "de": "German"}))
    return named.groupBy("language", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS pairs, cast(sum(CASE WHEN trim(regexp_replace(a.text, '\\s+', ' ', 'g')) = trim(regexp_replace(b.text, '\\s+', ' ', 'g')) THEN 1 ELSE 0 END) AS bigint) AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn")
def p12_same_squeezed(spark, d):
    c = table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(b, ["conv_id", "turn"]).agg(F.count(F.lit(1)).alias("pairs"), F.sum(text.same_squeezed("text", "other").cast("long")).alias("same"))


@query("SELECT r_regionkey + 100 AS code, r_regionkey FROM region")
def p13_p14_columns(spark, d):
    return rows.insert_first(rows.without_columns(table(spark, d, "region"), [" R_NAME "]), "code", F.col("r_regionkey") + 100)


@query("SELECT s_suppkey, round_even(s_acctbal / 7, 3) AS x FROM supplier")
def p15_rounded(spark, d):
    return rows.rounded(table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 7).alias("x")))


# == joins =========================================================================================
_PAIRS = "SELECT u.conv_id, u.turn, u.text AS text_orig, a.text AS text_trans FROM (SELECT * FROM conversations WHERE role = 'user') u {0} JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a ON u.conv_id = a.conv_id AND u.turn = a.turn"


def _pairs(spark, d, how="inner"):
    c = table(spark, d, "conversations")
    users = c.filter("role = 'user'").select("conv_id", "turn", "text")
    replies = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return rows.paired(users, replies, ["conv_id", "turn"], how=how)


@query(_PAIRS.format("INNER"))
def j1_inner_pairs(spark, d):
    return _pairs(spark, d)


@query(_PAIRS.format("LEFT"))
def j2_left_pairs(spark, d):
    return _pairs(spark, d, "left")


@query("SELECT doc_id, item_id FROM (SELECT l_orderkey AS doc_id, l_partkey AS item_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 25) WHERE k = 1")
def j3_table_lookup(spark, d):
    li = table(spark, d, "lineitem")
    sqls = li.groupBy(F.col("l_orderkey").alias("row_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("FROM table_1_1_"), x["l_partkey"])), " JOIN ").alias("sql"))
    known = table(spark, d, "part").filter("p_size > 25").select(F.concat(F.lit("1-1-"), "p_partkey").alias("id"), F.col("p_partkey").alias("item_id"))
    return rows.with_table(sqls, known, "sql").filter("item_id is not null").select(F.col("row_id").alias("doc_id"), "item_id")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j4_with_metadata(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(table(spark, d, "customer"), "c_custkey", "left").select("o_orderkey", "c_name")


@query("SELECT a.doc_id, a.n_chars, b.quality FROM documents a JOIN labels b ON a.doc_id = b.doc_id")
def j5_zipped(spark, d):
    return rows.zipped(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "n_chars", "quality")


@query("WITH a AS (SELECT DISTINCT l_suppkey k, l_returnflag f FROM lineitem), s AS (SELECT k, list_sort(list(f)) x FROM a GROUP BY k) SELECT k, array_to_string(list_sort(list_filter(['A','N'], lambda v: NOT list_contains(x, v))), ',') AS missing, array_to_string(list_sort(list_filter(x, lambda v: NOT list_contains(['A','N'], v))), ',') AS extra, array_to_string(list_sort(list_filter(['A','N'], lambda v: list_contains(x, v))), ',') AS common FROM s")
def j6_set_report(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_returnflag").alias("x"))
    rep = rows.set_report(F.array(F.lit("A"), F.lit("N")), F.col("x"))
    return s.withColumn("r", rep).select("k", *[F.array_join(f"r.{c}", ",").alias(c) for c in ("missing", "extra", "common")])


#: By template: the columns that those of the next template are assigned to, and whether all are on both sides; by hand.
_ASSIGNED = (
    ({"balance": "balance"}, 0.0),
    ({"balance": "balance", "segment": "segment", "n": "customer name"}, 1.0),
    ({"balance": "balance"}, 0.0),
    ({}, 0.0),
    ({"segment": "segment"}, 0.0),
    ({"balance": "balance", "segment": "segment"}, 0.0),
    ({"balance": "balance", "cust no": "cust no", "segment": "segment"}, 0.0),
    ({"balance": "balance", "customer name": "customer name", "segment": "segment"}, 0.0),
    ({"balance": "balance"}, 0.0),
)
_ASSIGNED_VALUES = _values([(k, json.dumps(m, separators=(",", ":")), score) for k, (m, score) in enumerate(_ASSIGNED)], "k, mapping, score")
_NEIGHBOURS = f"(SELECT a.row_id, mapping, score FROM {corpus.SQL} a JOIN {corpus.SQL} b ON b.row_id = a.row_id + 1 JOIN {_ASSIGNED_VALUES} ON k = a.row_id % {len(corpus.TEMPLATES)})"


@query(f"SELECT row_id, mapping FROM {_NEIGHBOURS}")
def j8_name_assignment(spark, d):
    q = corpus.queries(spark, d).select("row_id", sqltree.tree_columns("sql").alias("gold"))
    after = q.select((F.col("row_id") - 1).alias("row_id"), F.col("gold").alias("predicted"))
    return q.join(after, "row_id").select("row_id", F.to_json(similarity.name_assignment("gold", "predicted")).alias("mapping"))


# == aggregation =====================================================================================
@query("SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS std, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY l_returnflag")
def a1_describe_sample(spark, d):
    return aggregates.describe(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).withColumns({c: r6(F.col(c)) for c in ("mean", "std", "var")})


@query(f"SELECT lang, count(*) AS n, round(avg(w), 6) AS mean, min(w) AS min, max(w) AS max, median(w) AS median, round(stddev_pop(w), 6) AS std, round(var_pop(w), 4) AS var FROM (SELECT lang, {_wc('text')} AS w FROM documents) GROUP BY lang")
def a1_describe_population(spark, d):
    w = table(spark, d, "documents").select("lang", text.word_count("text").alias("w"))
    return aggregates.describe(w, "w", ["lang"], population=True).withColumns({"mean": r6(F.col("mean")), "std": r6(F.col("std")), "var": F.round("var", 4)})


@query("SELECT lang, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents GROUP BY lang")
def a2_percentiles(spark, d):
    return aggregates.percentiles(table(spark, d, "documents"), "n_chars", by=["lang"]).withColumn("p95", r6(F.col("p95")))


@query("SELECT round(avg(n_chars) FILTER (quality = 0), 6) AS mean_flagged, round(avg(n_chars) FILTER (quality = 1), 6) AS mean_other, round(avg((quality = 0)::int), 6) AS share, round(avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0), 6) AS difference FROM documents JOIN labels USING (doc_id)")
def a3_mean_difference(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("bad", F.col("quality") == 0)
    out = aggregates.mean_difference(j, "n_chars", "bad")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def a4_value_counts(spark, d):
    return aggregates.value_counts(table(spark, d, "events"), "event_type").withColumn("share", r6(F.col("share")))


@query("SELECT l_partkey AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 8) AS share FROM lineitem GROUP BY l_partkey ORDER BY n DESC, value LIMIT 10")
def a5_top_values(spark, d):
    return aggregates.value_counts(table(spark, d, "lineitem"), "l_partkey", top=10).withColumn("share", F.round("share", 8))


@query(f"SELECT cast(floor(w / 10.0) * 10 AS bigint) AS bin, count(*) AS n FROM (SELECT {_wc('text')} AS w FROM documents) GROUP BY 1")
def a6_word_histogram(spark, d):
    w = table(spark, d, "documents").select(text.word_count("text").alias("w"))
    return aggregates.histogram(w, "w", 10).withColumn("bin", F.col("bin").cast("long"))


@query("WITH e AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer), b AS (SELECT least(cast(floor((c_acctbal - lo) / ((hi - lo) / 20)) AS int), 19) AS bin, lo, hi FROM customer, e) SELECT bin, round(min(lo + bin * (hi - lo) / 20), 6) AS low, round(min(lo + (bin + 1) * (hi - lo) / 20), 6) AS high, count(*) AS n FROM b GROUP BY bin")
def a6_equal_bins(spark, d):
    out = aggregates.equal_bins(table(spark, d, "customer"), "c_acctbal", 20)
    return out.withColumns({"low": r6(F.col("low")), "high": r6(F.col("high"))})


@query("SELECT bucket, count(*) AS n, round(100 * avg(m), 6) AS percent FROM (SELECT CASE WHEN l_quantity > 2 AND l_quantity <= 6 THEN '(2, 6]' WHEN l_quantity > 6 AND l_quantity <= 10 THEN '(6, 10]' WHEN l_quantity > 10 AND l_quantity <= 14 THEN '(10, 14]' WHEN l_quantity > 14 AND l_quantity <= 18 THEN '(14, 18]' WHEN l_quantity > 18 AND l_quantity <= 22 THEN '(18, 22]' END AS bucket, (l_returnflag IN ('A', 'R'))::int AS m FROM lineitem) WHERE bucket IS NOT NULL GROUP BY bucket")
def a7_cut_rates(spark, d):
    out = aggregates.cut_rates(table(spark, d, "lineitem"), "l_quantity", [2, 6, 10, 14, 18, 22], F.col("l_returnflag").isin("A", "R"))
    return out.withColumn("percent", r6(F.col("percent")))


_SCORED = "(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, least(1.0, n_chars / 2000.0) AS score FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.select("doc_id", "lang", "n_chars", "quality", "toxic", F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("score"))


_METRICS = "round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS specificity, round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"


@query(f"SELECT *, {_METRICS} FROM (SELECT lang, count(*) FILTER (quality = 1 AND p = 1) AS tp, count(*) FILTER (quality = 0 AND p = 0) AS tn, count(*) FILTER (quality = 0 AND p = 1) AS fp, count(*) FILTER (quality = 1 AND p = 0) AS fn FROM (SELECT *, (score > 0.5)::int AS p FROM {_SCORED}) GROUP BY lang)")
def a8_a9_classification(spark, d):
    labelled = _scored(spark, d).withColumn("p", filters.label("score", 0.5, strict=True))
    out = aggregates.classification(aggregates.confusion(labelled, "quality", "p", ["lang"]))
    return out.withColumns({c: r6(F.col(c)) for c in ("accuracy", "precision", "recall", "specificity", "f1")})


@query(f"SELECT count(*) AS n, round(avg((quality - score) ** 2), 6) AS mse, round(avg(abs(quality - score)), 6) AS mae, round(sqrt(avg((quality - score) ** 2)), 6) AS rmse FROM {_SCORED}")
def a10_regression(spark, d):
    out = aggregates.regression(_scored(spark, d), "quality", "score")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("mse", "mae", "rmse")])


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey")
def a11_distinct_count(spark, d):
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("gold"))
    return lists.select("o_custkey", filters.distinct_queries("gold").alias("n"))


_RESERVED_VALUES = _values([(w,) for w in sqltext.RESERVED], "word")
_RESERVED_OF = "len(list_filter(regexp_extract_all(upper({0}), '\\w+'), lambda w: list_contains([" + ",".join(f"'{w}'" for w in sqltext.RESERVED) + "], w)))"


@query(f"WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(upper(sql), '\\w+')) AS word FROM {corpus.SQL}) GROUP BY word) SELECT r.word, coalesce(w.n, 0) AS n, round((coalesce(w.n, 0) + 1) / sum(coalesce(w.n, 0) + 1) OVER (), 8) AS p FROM (SELECT * FROM {_RESERVED_VALUES}) r LEFT JOIN w ON r.word = w.word")
def a12_reserved_probabilities(spark, d):
    return aggregates.reserved_probabilities(corpus.queries(spark, d), "sql").withColumn("p", F.round("p", 8))


@query(f"WITH c AS (SELECT {_RESERVED_OF.format('sql')} AS length, count(*) AS n FROM {corpus.SQL} GROUP BY 1), s AS (SELECT unnest(range(0, (SELECT max(length) FROM c) + 1)) AS length) SELECT s.length, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (), 8) AS p FROM s LEFT JOIN c ON s.length = c.length")
def a13_length_distribution(spark, d):
    return aggregates.length_distribution(corpus.queries(spark, d), "sql").withColumn("p", F.round("p", 8))


@query("SELECT count(*) AS total, cast(sum((o_orderstatus = 'F')::int) as bigint) AS n_F, cast(sum((o_orderstatus = 'O')::int) as bigint) AS n_O, round(avg((o_orderstatus = 'F')::int), 8) AS F_rate, round(avg((o_orderstatus = 'O')::int), 8) AS O_rate FROM orders")
def a14_rates(spark, d):
    return aggregates.rates(table(spark, d, "orders"), "o_orderstatus", ["F", "O"]).withColumns({c: F.round(c, 8) for c in ("F_rate", "O_rate")})


@query(f"WITH x AS (SELECT *, (score > 0.5)::int AS p FROM {_SCORED}), y AS (SELECT n_chars, unnest(CASE WHEN p = 1 AND quality = 1 THEN ['kept', 'true_positive'] WHEN p = 1 THEN ['kept'] WHEN quality = 1 THEN ['discarded', 'false_negative'] ELSE ['discarded'] END) AS subset FROM x) SELECT subset, count(*) AS n, round(avg(n_chars), 6) AS mean_n_chars FROM y GROUP BY subset")
def a15_a16_cell_metrics(spark, d):
    labelled = _scored(spark, d).withColumn("p", filters.label("score", 0.5, strict=True))
    return aggregates.cell_metrics(labelled, "quality", "p", ["n_chars"]).withColumn("mean_n_chars", r6(F.col("mean_n_chars")))


@query("SELECT c_custkey, c_nationkey AS m_nation, c_acctbal AS m_money_balance, c_mktsegment AS m_money_segment FROM customer")
def a17_flatten(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).alias("money")).alias("metrics"))
    return aggregates.flatten(c, "metrics", "m")


SWEEP = [("reward", "score", t, True) for t in (0.55, 0.6, 0.65, 0.7)] + [("prompt", "score", t, False) for t in (0.75, 0.8, 0.85, 0.9)]
_SWEEP_VALUES = _values([(m, t, int(s)) for m, _, t, s in SWEEP], "method, threshold, strict")


@query(f"WITH x AS (SELECT method, cast(threshold as double) AS threshold, quality, CASE WHEN strict = 1 THEN (score > threshold)::int ELSE (score >= threshold)::int END AS p FROM {_SCORED}, {_SWEEP_VALUES}), y AS (SELECT method, threshold, count(*) FILTER (quality = 1 AND p = 1) AS tp, count(*) FILTER (quality = 0 AND p = 0) AS tn, count(*) FILTER (quality = 0 AND p = 1) AS fp, count(*) FILTER (quality = 1 AND p = 0) AS fn FROM x GROUP BY method, threshold), z AS (SELECT *, {_METRICS.replace('round(', '(').replace(', 6)', ')')} FROM y) SELECT method, threshold, tp, tn, fp, fn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1, round(accuracy * specificity * f1, 6) AS quality FROM z")
def a18_threshold_sweep(spark, d):
    out = aggregates.threshold_sweep(_scored(spark, d), "quality", SWEEP)
    return out.withColumns({c: r6(F.col(c)) for c in ("accuracy", "precision", "recall", "specificity", "f1", "quality")})


# == windows and order =================================================================================
@query("SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE user_id = (SELECT min(user_id) FROM events))")
def w1_after_last(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("user_id").alias("u"))
    marked = e.crossJoin(F.broadcast(first))
    return rows.after_last(marked, "event_id", F.col("user_id") == F.col("u")).select("event_id")


@query("SELECT arg_max(c_name, c_custkey) AS c_name FROM (SELECT c_custkey, c_mktsegment || c_custkey AS c_name FROM customer) WHERE NOT contains(c_name, 'm')")
def w2_last_original(spark, d):
    return rows.last_original(table(spark, d, "customer").select("c_custkey", F.concat("c_mktsegment", "c_custkey").alias("c_name")), "c_custkey", "c_name")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def w3_top(spark, d):
    return rows.top(table(spark, d, "documents").select("doc_id", "n_chars"), 20, "n_chars", "doc_id")


@query(f"(SELECT doc_id, 'best' AS side FROM {_SCORED} ORDER BY abs(quality - score), doc_id LIMIT 5) UNION ALL (SELECT doc_id, 'worst' FROM {_SCORED} ORDER BY abs(quality - score) DESC, doc_id LIMIT 5)")
def w4_best_worst(spark, d):
    s, e = _scored(spark, d), F.abs(F.col("quality") - F.col("score"))
    best, worst = rows.top(s, 5, e, "doc_id", ascending=True), rows.top(s, 5, e, "doc_id")
    return best.select("doc_id", F.lit("best").alias("side")).union(worst.select("doc_id", F.lit("worst")))


@query("SELECT item_id FROM benchmark ORDER BY item_id LIMIT 7")
def w5_head(spark, d):
    return rows.top(table(spark, d, "benchmark").select("item_id"), 7, "item_id", ascending=True)


@query("SELECT d.doc_id, round(least(greatest((n_chars - lo) / (hi - lo), 0), 1), 8) AS n_chars FROM documents d, (SELECT min(n_chars) * 1.0 AS lo, max(n_chars) * 1.0 AS hi FROM documents WHERE lang = 'en') WHERE lang <> 'en'")
def w7_scaled_by_reference(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return metrics.scaled_by(docs.filter("lang <> 'en'"), docs.filter("lang = 'en'"), ["n_chars"]).select("doc_id", F.round("n_chars", 8).alias("n_chars"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'reserved' ELSE 'persona' END AS seeding_type, count(*) AS n FROM orders GROUP BY 1")
def w8_alternating(spark, d):
    return table(spark, d, "orders").groupBy(rows.alternating("o_orderkey").alias("seeding_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) k FROM orders) WHERE k = 1")
def w9_first_of_each(spark, d):
    return rows.first_of_each(table(spark, d, "orders"), [F.col("o_custkey")], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders")
def w10_rank_lag(spark, d):
    o = rows.ranked(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice")], "r")
    return rows.beside(o, ["o_custkey"], [F.col("o_orderkey")], "o_orderkey", "before").select("o_orderkey", "r", "before")


# == sets and seeded choices ==============================================================================
@query("SELECT 0 AS part, c_custkey AS key, c_name AS name, NULL AS phone FROM customer UNION ALL SELECT 1, s_suppkey, s_name, 'x' FROM supplier")
def u1_u2_stacked(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("x").alias("phone"))
    return rows.stacked(c, s)


@query("SELECT lower(p_brand) AS brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def u3_distinct_folded(spark, d):
    return rows.distinct_folded(table(spark, d, "part"), "p_brand", "p_partkey").select(F.lower("p_brand").alias("brand"), "p_partkey")


def _md5_u(seed: int, purpose: str, key: str) -> str:
    return f"(cast('0x' || substr(md5('{seed}:{purpose}:' || {key}), 1, 13) AS bigint) / 4503599627370496.0)"


@query(f"SELECT doc_id, CASE WHEN u < 0.75 THEN 'train' WHEN u < 0.875 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, {_md5_u(12, 'split', 'doc_id')} AS u FROM documents)")
def u4_split(spark, d):
    parts = [("train", 0.75), ("val", 0.125), ("test", 0.125)]
    return table(spark, d, "documents").select("doc_id", seeded.split_label(parts, 12, F.col("doc_id")).alias("split"))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN (k - 1) / n < 0.8 THEN 'train' ELSE 'test' END AS split FROM (SELECT row_number() OVER (ORDER BY md5('42:split:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM labels)) GROUP BY split")
def u4_exact_split(spark, d):
    return seeded.exact_split(table(spark, d, "labels"), [("train", 0.8), ("test", 0.2)], 42, "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, CASE WHEN u < 0.3 THEN 'persona' ELSE 'reserved' END AS seeding FROM (SELECT c_custkey, {_md5_u(42, 'seeding', 'c_custkey')} AS u FROM customer)")
def u5_weighted(spark, d):
    return table(spark, d, "customer").select("c_custkey", seeded.weighted(["persona", "reserved"], [0.3, 0.7], 42, "seeding", F.col("c_custkey")).alias("seeding"))


@query(f"SELECT c_custkey, ['add_column', 'remove_column', 'rename_column', 'split_column', 'merge_column'][1 + cast(floor({_md5_u(42, 'change', 'c_custkey')} * 5) AS int)] AS change FROM customer")
def u6_choice(spark, d):
    kinds = F.array(*map(F.lit, evolution.KINDS[:5]))
    return table(spark, d, "customer").select("c_custkey", seeded.choice(kinds, 42, "change", F.col("c_custkey")).alias("change"))


@query("SELECT 3 + o_orderkey % 18 AS requested, count(*) AS n FROM orders GROUP BY 1")
def u7_cyclic(spark, d):
    return table(spark, d, "orders").groupBy(seeded.cyclic(F.col("o_orderkey"), 3, 20).alias("requested")).agg(F.count(F.lit(1)).alias("n"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 1000 FROM nation EXCEPT SELECT s_nationkey + 1000 FROM supplier)")
def u8_intersect_except(spark, d):
    c, s, n = table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select("s_nationkey"), table(spark, d, "nation").select("n_nationkey")
    both = rows.common(c, s)
    rest = rows.only_first(n, s).select(F.col("n_nationkey") + 1000)
    return both.union(rest).toDF("k")


# == SQL text ============================================================================================
@query(f"SELECT row_id, nullif(regexp_extract(sql, '(?i)\\bfrom\\s+[`\"\\[]?([A-Za-z_][\\w$]*)', 1), '') AS name FROM {corpus.SQL}")
def x8_table_name(spark, d):
    return corpus.queries(spark, d).select("row_id", sqltext.table_name("sql").alias("name"))


@query(f"SELECT row_id, CASE WHEN regexp_matches(sql, '(?i)^\\s*with\\b') THEN 'rich' ELSE '' END AS ctes FROM {corpus.SQL}")
def x2_cte_names(spark, d):
    return corpus.queries(spark, d).select("row_id", F.array_join(sqltext.cte_names("sql"), ",").alias("ctes"))


_NOT_COLUMNS = "[" + ",".join(f"'{w}'" for w in sqltext.NOT_COLUMNS) + "]"


@query(f"SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(sql, '`([^`]+)`', 1), regexp_extract_all(regexp_replace(sql, '`[^`]+`', ' ', 'g'), '\\b[A-Za-z_]\\w*\\b')), lambda n: lower(n)), lambda n: NOT list_contains({_NOT_COLUMNS}, n)))), '|') AS names FROM {corpus.SQL}")
def x9_referenced_names(spark, d):
    return corpus.queries(spark, d).select("row_id", F.array_join(F.array_sort(sqltext.referenced_names("sql")), "|").alias("names"))


_COLUMNS_AS = "sql"
for _i, _h in enumerate(corpus.HEADER):
    _COLUMNS_AS = f"replace({_COLUMNS_AS}, '`{_h}`', 'col{_i}')"


@query(f"SELECT row_id, regexp_replace({_COLUMNS_AS}, 'table_1_1_[0-9]+', 'table_x', 'g') AS db_sql FROM {corpus.SQL}")
def x1_x3_physical_sql(spark, d):
    from pairforge.plans.dialect import physical_sql

    known = corpus.tables(spark, d).select(F.col("id").alias("table_id"), "header")
    joined = corpus.queries(spark, d).join(F.broadcast(known), "table_id", "left").withColumn("header", F.coalesce("header", F.array(*map(F.lit, corpus.HEADER))))
    return joined.select("row_id", physical_sql("sql", "header", F.lit("table_x")).alias("db_sql"))


#: What each template must give, computed from the customers: status, number of rows, and the count of the first one.
_EXPECTED = f"""WITH q AS (SELECT row_id, n, x, s, row_id % {len(corpus.TEMPLATES)} AS k FROM {corpus.SQL}),
c AS (SELECT c_nationkey, c_acctbal AS b, c_mktsegment AS g, avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS m FROM customer),
r AS (SELECT q.row_id, k, count(c_nationkey) AS total, count(*) FILTER (b > x) AS above, CASE k WHEN 0 THEN 1 WHEN 3 THEN 1
WHEN 1 THEN count(DISTINCT g) FILTER (b > x) WHEN 5 THEN count(DISTINCT g) FILTER (b > x)
WHEN 2 THEN count(*) FILTER (g = s AND b BETWEEN x AND x + 4000) WHEN 6 THEN count(*) FILTER (b < -1000 * x OR g IS NULL)
WHEN 7 THEN least(5, greatest(0, count(*) FILTER (b > m AND g = s) - q.row_id % 3)) WHEN 8 THEN count(*) FILTER (b > x) ELSE 0 END AS n
FROM q LEFT JOIN c ON c_nationkey = q.n GROUP BY q.row_id, k)
SELECT row_id, CASE WHEN total = 0 OR k = 4 THEN 'error' WHEN n = 0 THEN 'empty' ELSE 'rows' END AS status, CASE WHEN total = 0 THEN 0 ELSE n END AS n, CASE WHEN total > 0 AND k = 0 THEN '[' || above || ']' END AS head FROM r"""


@query(_EXPECTED)
def x5_execute_all(spark, d):
    ran = runner.execute_all(corpus.queries(spark, d), corpus.tables(spark, d), most=1)
    head = F.when(F.col("row_id") % len(corpus.TEMPLATES) == 0, F.get("result", F.lit(0)))
    return ran.select("row_id", "status", F.coalesce("outcome.n_rows", F.lit(0)).alias("n"), head.alias("head"))


#: Pairs of a query with itself in the reverse order, with another threshold, with one that fails, and with itself in capitals.
_MATCHES = f"""WITH k AS (SELECT row_id, row_id % 4 AS v, count(c_nationkey) AS total, count(*) FILTER (c_acctbal > x) AS a, count(*) FILTER (c_acctbal > x + 500) AS b
FROM {corpus.SQL} q LEFT JOIN customer ON c_nationkey = q.n GROUP BY row_id)
SELECT row_id, CASE WHEN total = 0 OR v = 2 THEN 0.0 WHEN v = 1 THEN (a = b)::double ELSE 1.0 END AS same,
CASE WHEN total = 0 OR v = 2 THEN 0.0 WHEN v = 1 THEN (a = b)::double WHEN v = 0 THEN (a <= 1)::double ELSE 1.0 END AS same_order FROM k"""


@query(_MATCHES)
def qm6_execution_match(spark, d):
    q = corpus.queries(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.floor(F.col("o_totalprice") / 50).alias("x")), "row_id")
    name, v = catalog.physical_name(F.col("table_id")), F.col("row_id") % 4
    gold = F.concat(F.lit("SELECT `Customer Name` FROM "), name, F.lit(" WHERE `Balance` > "), F.col("x"))
    other = F.concat(F.lit("SELECT `Customer Name` FROM "), name, F.lit(" WHERE `Balance` > "), F.col("x") + 500)
    predicted = F.when(v == 0, F.concat(gold, F.lit(" ORDER BY `Cust No` DESC"))).when(v == 1, other).when(v == 2, F.lit("SELECT `Missing`")).otherwise(F.upper(gold))
    t = corpus.tables(spark, d)
    both = q.select("row_id", "table_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), gold.alias("sql")), F.struct(F.lit(1).alias("side"), predicted.alias("sql")))).alias("p")).select("row_id", "table_id", "p.*")
    ran = runner.execute_all(both, t, most=0).groupBy("row_id").agg(*[F.max(F.when(F.col("side") == i, F.col("outcome"))).alias(c) for i, c in enumerate(("gold", "predicted"))])
    return ran.select("row_id", runner.results_match("gold", "predicted").alias("same"), runner.results_match("gold", "predicted", ordered=True).alias("same_order"))


@query(f"SELECT row_id, 'table_1_' || split_part(table_id, '-', 2) || '_' || split_part(table_id, '-', 3) AS name FROM {corpus.SQL}")
def x4_bird_ids(spark, d):
    q = corpus.queries(spark, d)
    return q.select("row_id", F.concat(F.lit("table_"), F.translate(F.get(sqltext.table_ids("sql"), F.lit(0)), "-", "_")).alias("name"))


# == evolution ============================================================================================
@query(f"SELECT s_suppkey, ['A', 'B', 'C'][1 + cast(floor({_md5_u(42, 'grade', 's_suppkey')} * 3) AS int)] AS grade FROM supplier")
def ev1_add_column(spark, d):
    c = evolution.Change("add_column", new={"grade": ("A", "B", "C")})
    return evolution.evolve(table(spark, d, "supplier"), c, "s_suppkey").select("s_suppkey", "grade")


@query("SELECT r_regionkey FROM region")
def ev2_remove_column(spark, d):
    return evolution.evolve(table(spark, d, "region"), evolution.Change("remove_column", columns=("R_NAME",)))


@query("SELECT n_nationkey AS id, n_name AS nation, n_regionkey FROM nation")
def ev3_rename_column(spark, d):
    return evolution.evolve(table(spark, d, "nation"), evolution.Change("rename_column", names={"n_nationkey": "id", "N_NAME": "nation"}))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, nullif(split_part(p_name, ' ', 2), '') AS second FROM part")
def ev4_split_column(spark, d):
    c = evolution.Change("split_column", columns=("p_name",), new={"first": (), "second": ()}, separator=" ")
    return evolution.evolve(table(spark, d, "part").select("p_partkey", "p_name"), c)


@query("SELECT o_orderkey, coalesce(o_orderstatus, '') || ', ' || coalesce(nullif(o_orderpriority, '5-LOW'), '') AS state FROM orders")
def ev5_merge_column(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return evolution.evolve(o, evolution.Change("merge_column", columns=("o_orderstatus", "p"), new={"state": ()}))


@query(f"SELECT row_id, regexp_replace(sql, 'table_1_1_([0-9]+)', 'clients_\\1', 'g') AS new_sql FROM {corpus.SQL}")
def ev6_rename_table(spark, d):
    @F.pandas_udf("string")
    def renamed(sql: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([rename_table(q, a, b) for q, a, b in zip(sql, old, new, strict=True)])

    name = catalog.physical_name(F.col("table_id"))
    new = F.concat(F.lit("clients_"), F.substring_index("table_id", "-", -1))
    same = evolution.evolve(corpus.queries(spark, d), evolution.Change("rename_table", table="clients"))  # rows and columns stay
    return same.select("row_id", renamed("sql", name, new).alias("new_sql"))


@query("SELECT t AS change, k AS kept FROM (VALUES ('rename another column', true), ('rows in another order', true), ('one value', false), ('one row less', false), ('one row twice', false)) AS x(t, k)")
def ev15_values_kept(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = {
        "rename another column": evolution.evolve(c, evolution.Change("rename_column", names={"c_acctbal": "balance"})),
        "rows in another order": c.orderBy(F.desc("c_custkey")),
        "one value": c.withColumn("c_name", F.when(F.col("c_custkey") == 3, None).otherwise(F.col("c_name"))),
        "one row less": c.filter("c_custkey <> 3"),
        "one row twice": c.union(c.filter("c_custkey = 3")),
    }
    return spark.createDataFrame([(t, evolution.values_kept(c, x, ["c_custkey", "c_name"])) for t, x in changes.items()], "change string, kept boolean")


@query("SELECT '1-1-' || c_nationkey AS parent, 3 AS ids, 3 AS names, true AS derived FROM customer GROUP BY c_nationkey")
def ev16_derived_ids(spark, d):
    t = corpus.tables(spark, d)
    changes = (evolution.Change("remove_column", columns=("Segment",)), evolution.Change("rename_column", names={"Segment": "Sector"}), evolution.Change("rename_column", names={"Segment": "Part"}))
    made = [evolution.evolve_catalog(t, c) for c in (*changes, changes[0])]  # the same change again has the same id
    both = made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])
    return both.groupBy(F.col("parent_table_id").alias("parent")).agg(F.count_distinct("id").alias("ids"), F.count_distinct("name").alias("names"), F.bool_and(rows.is_derived("id") & F.col("is_derived")).alias("derived"))


@query("SELECT r_regionkey AS bölge_no, r_name AS ad FROM region")
def ev7_translate(spark, d):
    return evolution.evolve(table(spark, d, "region").select("r_regionkey", "r_name"), evolution.Change("translate", names={"r_regionkey": "bölge_no", "r_name": "ad"}))


@query(f"SELECT row_id, replace(sql, '`Customer Name`', '`Client`') AS new_sql FROM {corpus.SQL}")
def ev9_repair_rename(spark, d):
    c = evolution.Change("rename_column", names={"Customer Name": "Client"})
    return evolution.repaired(corpus.queries(spark, d), "sql", c).select("row_id", "new_sql")


# by template: untouched, both as items, or one of them in a clause or alone
@query(f"SELECT row_id, CASE WHEN k IN (0, 3) THEN sql WHEN k = 8 THEN replace(sql, '`Customer Name`, `Segment`', '`Who`') ELSE 'unanswerable' END AS new_sql, CASE WHEN k IN (0, 3) THEN 'unchanged' WHEN k = 8 THEN 'rewritten' ELSE 'unanswerable' END AS change_state FROM (SELECT *, row_id % {len(corpus.TEMPLATES)} AS k FROM {corpus.SQL})")
def ev10_repair_merge(spark, d):
    c = evolution.Change("merge_column", columns=("Customer Name", "Segment"), new={"Who": ()})
    return evolution.repaired(corpus.queries(spark, d), "sql", c).select("row_id", "new_sql", "change_state")


# by template: two items, two keys or two columns in a condition
@query(f"SELECT row_id, row_id % {len(corpus.TEMPLATES)} IN (1, 2, 4, 6, 7, 8) AS together FROM {corpus.SQL}")
def ev11_uses_columns_together(spark, d):
    return corpus.queries(spark, d).select("row_id", evolution.uses_columns_together("sql").alias("together"))


@query(f"SELECT row_id, CASE WHEN contains(sql, '`Customer Name`') THEN 'unanswerable' ELSE 'unchanged' END AS change_state FROM {corpus.SQL}")
def ev12_remove_fast_path(spark, d):
    return evolution.repaired(corpus.queries(spark, d), "sql", evolution.Change("remove_column", columns=("Customer Name",))).select("row_id", "change_state")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def ev13_differing_rows(spark, d):
    s = table(spark, d, "supplier")
    changed = s.withColumn("s_name", F.when(F.col("s_nationkey") == 3, F.lit(None)).otherwise(F.col("s_name")))
    return evolution.differing_rows(s, changed, ["s_name", "s_acctbal"], "s_suppkey")


_CHANGES = "(SELECT o_orderkey, ['add_column', 'rename_column', 'remove_column', 'merge_column', 'translate'][1 + o_orderkey % 5] AS kind, ['rows', 'empty', 'error'][1 + o_custkey % 3] AS status, o_totalprice > 200000 AS same FROM orders)"


@query(f"SELECT o_orderkey, CASE WHEN kind IN ('add_column', 'rename_column') THEN status = 'rows' WHEN kind = 'translate' THEN same ELSE status <> 'error' END AS ok FROM {_CHANGES}")
def ev14_accepted(spark, d):
    o, kinds = table(spark, d, "orders"), ("add_column", "rename_column", "remove_column", "merge_column", "translate")
    kind = F.get(F.array(*map(F.lit, kinds)), F.col("o_orderkey") % 5)
    status = F.get(F.array(*map(F.lit, ("rows", "empty", "error"))), F.col("o_custkey") % 3)
    return o.select("o_orderkey", evolution.accepted(kind, status, F.col("o_totalprice") > 200000).alias("ok"))


#: Declared types with what they are.
_TYPES = [("text", "TEXT"), ("VARCHAR(20)", "TEXT"), ("int", "INTEGER"), ("number", "REAL"), ("Float", "REAL"), ("numeric", "NUMERIC"), ("date", "TEXT"), ("bool", "INTEGER"), ("", "TEXT"), ("blob", "TEXT")]


_DECLARED = f"(SELECT p_partkey, {[t for t, _ in _TYPES]}[1 + p_partkey % {len(_TYPES)}] AS t, {[n for _, n in _TYPES]}[1 + p_partkey % {len(_TYPES)}] AS n, p_size FROM part)"


@query(f"SELECT p_partkey, n AS normal, CASE WHEN n = 'TEXT' THEN 'text' ELSE 'number' END AS plain FROM {_DECLARED}")
def ev17_types(spark, d):
    t = F.get(F.array(*[F.lit(t) for t, _ in _TYPES]), F.col("p_partkey") % len(_TYPES))
    sized = F.concat(F.when(F.col("p_size") % 2 == 0, F.upper(t)).otherwise(t), F.when(t.contains("(") | (t == ""), "").otherwise(F.concat(F.lit(" ("), "p_size", F.lit(")"))))
    s = table(spark, d, "part").select("p_partkey", sqltext.normal_type(sized).alias("normal"))
    return s.select("p_partkey", "normal", sqltext.plain_type("normal").alias("plain"))


# == metrics ===========================================================================================
@query(f"SELECT doc_id, {_wc('text')} AS words FROM documents")
def m1_word_count(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", text.word_count("text").alias("words"))


#: Columns, subqueries, operators, splits and nodes of each template, counted by hand.
_TREES = ((1, 0, 5, 5, 10), (5, 0, 7, 7, 16), (4, 0, 7, 5, 16), (2, 0, 4, 5, 9), (2, 0, 3, 4, 9), (5, 0, 8, 9, 20), (4, 0, 5, 4, 14), (5, 1, 11, 10, 23), (3, 0, 4, 4, 10))
_TREE_VALUES = _values([(k, *t) for k, t in enumerate(_TREES)], "k, columns, subqueries, operators, splits, nodes")


# every fourth query is cut off and so has no tree
@query(f"SELECT row_id, CASE WHEN bad THEN 0 ELSE columns END AS columns, CASE WHEN bad THEN 0 ELSE subqueries END AS subqueries, CASE WHEN bad THEN 0 ELSE operators END AS operators, CASE WHEN bad THEN 0 ELSE splits END AS splits, CASE WHEN bad THEN 0 ELSE nodes END AS nodes, NOT bad AS parsed FROM (SELECT row_id, row_id % {len(corpus.TEMPLATES)} AS k, row_id % 4 = 3 AS bad FROM {corpus.SQL}) q JOIN {_TREE_VALUES} USING (k)")
def m2_m7_tree_metrics(spark, d):
    sql = F.when(F.col("row_id") % 4 == 3, F.concat("sql", F.lit(" AND (x"))).otherwise(F.col("sql"))
    return corpus.queries(spark, d).select("row_id", sqltree.tree_metrics(sql).alias("m")).select("row_id", "m.*")


@query(f"SELECT row_id, CASE WHEN row_id % {len(corpus.TEMPLATES)} = 7 THEN 1 ELSE 0 END + CASE WHEN row_id % 2 = 0 THEN 1 ELSE 0 END AS subqueries FROM {corpus.SQL}")
def m3_subqueries(spark, d):
    sql = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("SELECT * FROM ( "), "sql", F.lit(") WHERE EXISTS (SELECT 1)"))).otherwise(F.col("sql"))
    # a query that begins with WITH is no SELECT, and so its brackets do not count
    sql = F.when((F.col("row_id") % 2 == 0) & F.col("sql").startswith("WITH"), F.concat("sql", F.lit(" LIMIT (SELECT 9)"))).otherwise(sql)
    return corpus.queries(spark, d).select("row_id", sqltext.subquery_count(sql).alias("subqueries"))


#: Operators of each template, counted by hand.
_OPERATORS_OF = (5, 7, 7, 4, 3, 8, 5, 11, 4)


@query(f"SELECT row_id, CASE row_id % {len(corpus.TEMPLATES)} {' '.join(f'WHEN {i} THEN {n}' for i, n in enumerate(_OPERATORS_OF))} END AS operators FROM {corpus.SQL}")
def m4_operators(spark, d):
    return corpus.queries(spark, d).select("row_id", sqltext.operator_total("sql").alias("operators"))


@query("SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)) / ln(1 + hi), 8) AS logged, round((c_acctbal - mean) / std, 6) AS z, round((c_acctbal - lo) / (hi - lo), 8) AS scaled FROM customer, (SELECT min(c_acctbal) lo, max(c_acctbal) hi, avg(c_acctbal) mean, stddev_samp(c_acctbal) std FROM customer)")
def m8_normalise(spark, d):
    c = table(spark, d, "customer")
    x = F.col("c_acctbal")
    s = c.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    cols = [F.col(k) for k in ("lo", "hi", "mean", "std")]
    j = c.crossJoin(F.broadcast(s))
    return j.select("c_custkey", F.round(metrics.normalise(F.greatest(x, F.lit(0.0)), "log_plus_one", *cols), 8).alias("logged"), r6(metrics.normalise(x, "zscore", *cols)).alias("z"), F.round(metrics.normalise(x, "minmax", *cols), 8).alias("scaled"))


@query("SELECT doc_id, CASE WHEN n_chars = 0 THEN 0 ELSE round(least(ln(1 + n_chars) / ln(1 + hi), 1), 8) END AS logged, CASE WHEN n_chars = 0 THEN 0 ELSE round(1 / (1 + exp(-0.5 * (n_chars - mean) / std)), 8) END AS z, CASE WHEN n_chars = 0 THEN 0 ELSE round(least(greatest((n_chars - q25) / (q75 - q25), 0), 1), 8) END AS robust FROM documents, (SELECT max(n_chars) hi, avg(n_chars) mean, stddev_pop(n_chars) std, quantile_cont(n_chars, 0.25) q25, quantile_cont(n_chars, 0.75) q75 FROM documents)")
def m9_normalise_nl(spark, d):
    docs, x = table(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars")
    s = docs.agg(F.max(x).alias("hi"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).crossJoin(aggregates.percentiles(docs, "n_chars", (0.25, 0.75)).toDF("q25", "q75"))
    by = {k: F.col(k) for k in ("hi", "mean", "std", "q25", "q75")}
    j = docs.crossJoin(F.broadcast(s))
    return j.select("doc_id", *[F.round(metrics.normalise_nl(x, m, **by), 8).alias(n) for m, n in (("log", "logged"), ("zscore", "z"), ("robust", "robust"))])


@query("WITH s AS (SELECT avg(l_quantity) a, min(l_quantity) b, max(l_quantity) c, avg(l_discount) e, min(l_discount) f, max(l_discount) g FROM lineitem) SELECT round(a, 6) AS mean_l_quantity, round(e, 6) AS mean_l_discount, round((a - b) / (c - b), 6) AS scaled_l_quantity, round((e - f) / (g - f), 6) AS scaled_l_discount, round(0.4 * (a - b) / (c - b) + 0.6 * (e - f) / (g - f), 6) AS composite FROM s")
def m10_composite(spark, d):
    out = metrics.sql_composite(table(spark, d, "lineitem"), (("l_quantity", 0.4), ("l_discount", 0.6)))
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("SELECT l_orderkey, l_linenumber, round(0.15 * l_quantity + 0.30 * l_discount + 0.35 * l_tax + 0.20 * l_linenumber, 6) AS composite FROM lineitem")
def m11_nl_composite(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("before_verb"), F.col("l_discount").alias("constituents_per_word"), F.col("l_tax").alias("subordinate"), F.col("l_linenumber").alias("coordinate"))
    return li.select("l_orderkey", "l_linenumber", r6(metrics.nl_composite()).alias("composite"))


_READ = f"(SELECT doc_id, {_wc('text')} AS words, CASE WHEN regexp_matches(coalesce(text, ''), '\\S') THEN greatest(len(regexp_extract_all(text, '[.!?]+')), 1) ELSE 0 END AS sentences, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS syllables FROM documents)"


@query(f"SELECT doc_id, words, sentences, syllables, round(206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words), 6) AS reading_ease, round(0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59, 6) AS grade FROM {_READ}")
def m12_m13_readability(spark, d):
    out = metrics.readability(spread(table(spark, d, "documents").select("doc_id", "text")), "text")
    return out.select("doc_id", "words", "sentences", "syllables", r6(F.col("reading_ease")).alias("reading_ease"), r6(F.col("grade")).alias("grade"))


@query(f"SELECT row_id, {_RESERVED_OF.format('sql')} AS n, {_RESERVED_OF.format('sql').replace('len(list_filter', 'len(list_distinct(list_filter') + ')'} AS kinds FROM {corpus.SQL}")
def m14_m15_reserved(spark, d):
    return corpus.queries(spark, d).select("row_id", sqltext.reserved_count("sql").alias("n"), sqltext.reserved_distinct("sql").alias("kinds"))


@query(f"SELECT row_id, CASE WHEN abs(3 + row_id % 18 - n) = 0 THEN 'exact' WHEN abs(3 + row_id % 18 - n) = 1 THEN 'close' ELSE 'way_off' END AS class FROM (SELECT row_id, {_RESERVED_OF.format('sql')} AS n FROM {corpus.SQL})")
def m16_compliance(spark, d):
    q = corpus.queries(spark, d)
    return q.select("row_id", metrics.compliance(seeded.cyclic(F.col("row_id"), 3, 20), sqltext.reserved_count("sql")).alias("class"))


@query("WITH m AS (SELECT lang, avg(n_chars) AS n_chars FROM documents GROUP BY lang) SELECT lang, round(least(greatest((m.n_chars - lo) / (hi - lo), 0), 1), 8) AS n_chars FROM m, (SELECT min(n_chars) * 1.0 lo, max(n_chars) * 1.0 hi FROM documents)")
def m17_m18_by_language(spark, d):
    return metrics.by_language(table(spark, d, "documents"), ["n_chars"]).select("lang", F.round("n_chars", 8).alias("n_chars"))


# == query match ==========================================================================================
@query("SELECT p_partkey, (p_brand = p_type)::double AS same, round(1 - levenshtein(p_brand, p_type) / greatest(length(p_brand), length(p_type)), 8) AS edit FROM part")
def qm1_qm3_ratios(spark, d):
    return table(spark, d, "part").select("p_partkey", similarity.exact("p_brand", "p_type").alias("same"), F.round(similarity.edit_ratio("p_brand", "p_type"), 8).alias("edit"))


@query()
def qm2_qm8_fuzzy(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(similarity.partial_ratio("p_name", "p_type"), 6).alias("partial"), F.round(similarity.ratio("p_name", "p_type"), 6).alias("whole"), (similarity.lower_ratio("p_name", "p_type") >= 0.8).alias("near"))


# neighbours in order of the templates: each pair's columns, without regard to the tables
@query(f"SELECT row_id, cast(score AS double) AS score FROM {_NEIGHBOURS}")
def qm4_context_match(spark, d):
    q = corpus.queries(spark, d)
    after = q.select((F.col("row_id") - 1).alias("row_id"), F.col("sql").alias("other"))
    return q.join(after, "row_id").select("row_id", sqltree.context_match("sql", "other").alias("score"))


_NAMES = "(SELECT p_partkey, replace(p_name, ' ', '_') AS a, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'the ' || p_name WHEN 2 THEN p_type ELSE p_type || ' ' || split_part(p_name, ' ', 1) || 's' END AS b FROM part)"


@query(f"SELECT p_partkey, lower(a) = lower(b) OR contains(lower(b), lower(a)) OR contains(lower(a), lower(b)) OR len(list_filter(string_split(lower(a), '_'), lambda p: p <> '' AND contains(lower(b), p))) > 0 AS m FROM {_NAMES}")
def qm5_name_matches(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    b = F.when(k == 0, F.upper(n)).when(k == 1, F.concat(F.lit("the "), n)).when(k == 2, F.col("p_type")).otherwise(F.concat("p_type", F.lit(" "), F.split_part(n, F.lit(" "), F.lit(1)), F.lit("s")))
    s = table(spark, d, "part").select("p_partkey", F.replace(n, F.lit(" "), F.lit("_")).alias("a"), b.alias("b"))
    return s.select("p_partkey", similarity.name_matches("a", "b").alias("m"))


# == filters ==============================================================================================
@query(f"SELECT route, count(*) AS n, cast(sum(keep::int) AS bigint) AS kept FROM (SELECT CASE WHEN score >= 0.25 THEN 'prompt' ELSE 'reward' END AS route, CASE WHEN score >= 0.25 THEN score >= 0.8 ELSE coalesce(toxic * 1.0 >= 0.5, false) END AS keep FROM {_SCORED}) GROUP BY route")
def f1_f4_routes(spark, d):
    s = _scored(spark, d).withColumns({"option": filters.route("score"), "reward": F.col("toxic") * 1.0, "response": F.concat(F.lit("Score: "), F.format_string("%.17f", "score"))})
    return filters.filtered(s).groupBy(F.col("option").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("keep").cast("long")).alias("kept"))


@query(f"SELECT doc_id, (score > 0.55)::int AS reward_55, (score >= 0.75)::int AS prompt_75 FROM {_SCORED}")
def f5_f7_labels(spark, d):
    return _scored(spark, d).select("doc_id", filters.label("score", 0.55, True).alias("reward_55"), filters.label("score", 0.75, False).alias("prompt_75"))


@query(f"SELECT row_id, row_id % 3 <> 0 AS keep FROM {corpus.SQL}")
def f6_generate_and_compare(spark, d):
    near = F.when(F.col("row_id") % 3 == 0, F.lit("zzz")).when(F.col("row_id") % 3 == 1, F.lower("sql")).otherwise(F.concat(F.lit("xx "), F.upper("sql")))
    q = corpus.queries(spark, d).withColumn("candidates", F.array(F.lit("SELECT 1"), near))
    return q.select("row_id", filters.generate_and_compare("candidates", "sql").alias("keep"))


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN x WHEN 1 THEN 1.0 WHEN 2 THEN x WHEN 3 THEN x WHEN 5 THEN 0.0 WHEN 6 THEN x END AS score FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0 AS x FROM orders)")
def f8_score_of(spark, d):
    k, x = F.col("o_orderkey") % 7, F.format_string("%.2f", (F.col("o_orderkey") % 101) / 100.0)
    said = (
        F.when(k == 0, F.concat(F.lit('{"score": '), x, F.lit("}")))
        .when(k == 1, F.concat(F.lit('```json\n{"score": 1'), F.substring(x, 2, 3), F.lit("}\n```")))
        .when(k == 2, F.concat(F.lit("Score: "), x, F.lit(" because of 12")))
        .when(k == 3, F.concat(F.lit("I would give 12, or "), x, F.lit(" of 2")))
        .when(k == 5, F.concat(F.lit("score=-1"), x))
        .when(k == 6, F.concat(F.lit('ok:\n```json\n{"why": "3 rows", "score": '), x, F.lit("}\n```")))
        .otherwise("none")
    )
    return table(spark, d, "orders").select("o_orderkey", said.alias("a")).select("o_orderkey", answers.score_of("a").alias("score"))


@query("SELECT conv_id, turn, least(length(text) / 100.0, 1) AS score FROM conversations WHERE text IS NOT NULL")
def f9_model_scores(spark, d):
    def scorer():
        return lambda texts: np.minimum(np.array([len(t) for t in texts]) / 100.0, 1.0)

    c = table(spark, d, "conversations").filter("text is not null")
    return filters.scored(c, "text", scorer).select("conv_id", "turn", "score")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 OR value > 1 OR value < 0 THEN -1.0 ELSE round(2 * exp(-2 * abs(value - 0.5)) - 1, 8) END AS reward FROM (SELECT event_id, floor(value * 10) / 1000 AS value FROM events)")
def f10_reasoning_reward(spark, d):
    e = table(spark, d, "events").select("event_id", (F.floor(F.col("value") * 10) / 1000).alias("value"))
    said = F.concat(F.when(F.col("event_id") % 4 == 0, "").otherwise("<think>x</think>"), F.lit("<score>"), F.format_string("%.3f", "value"), F.lit("</score>"))
    return e.select("event_id", F.round(answers.reasoning_reward(said, F.lit(0.5)), 8).alias("reward"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 < 2 AND p_partkey % 3 < 2 THEN CASE p_size % 4 WHEN 0 THEN p_name || ' of ' || p_brand ELSE p_type || ' by ' || p_brand END END AS picked FROM part")
def f11_judged(spark, d):
    options = F.array(F.concat("p_name", F.lit(" of "), "p_brand"), F.concat("p_type", F.lit(" by "), "p_brand"))
    i, k = F.col("p_size") % 4, F.col("p_partkey") % 3
    own = F.coalesce(F.get(options, i), F.lit("x"))
    said = F.when(k == 0, F.upper(own)).when(k == 1, F.replace(own, F.lit(" "), F.lit("  "))).otherwise("zzzzzz")
    s = table(spark, d, "part").select("p_partkey", options.alias("options"), i.alias("i"), said.alias("t"))
    return s.select("p_partkey", filters.judged("options", "i", "t").alias("picked"))


@query("SELECT conv_id, min(turn) AS turn FROM conversations WHERE turn <= 3 AND length(text) >= 90 GROUP BY conv_id")
def f12_tr8_first_kept(spark, d):
    return filters.first_kept(table(spark, d, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", filters.judge_gate("n")).select("conv_id", "turn")


# == ambiguity ============================================================================================
@query("WITH x AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n, max(o_totalprice) > 200000 AS a FROM orders GROUP BY o_custkey), e AS (SELECT min(n) lo, max(n) hi FROM x WHERE a) SELECT o_custkey, n, CASE WHEN a THEN CASE WHEN hi <= 1 THEN 10.0 ELSE round(5 + 5 * (n - lo) / greatest(hi - lo, 1), 8) END ELSE 0.0 END AS label FROM x, e")
def am3_am4_labels(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("gold"), (F.max("o_totalprice") > 200000).alias("a"))
    out = filters.ambiguity_labels(x.withColumn("n", filters.distinct_queries("gold")), "n", "a")
    return out.select("o_custkey", "n", F.round("label", 8).alias("label"))


_FLAGS = [("True", 1), (" yes ", 1), ("Y", 1), ("1", 1), ("t", 1), ("no", 0), ("0", 0), ("", 0), (None, 0), ("truely", 0)]


@query(f"SELECT event_id, {[x for _, x in _FLAGS]}[1 + event_id % {len(_FLAGS)}] = 1 AS flag FROM events")
def am5_truthy(spark, d):
    v = F.get(F.array(*[F.lit(v) for v, _ in _FLAGS]), F.col("event_id") % len(_FLAGS))
    return table(spark, d, "events").select("event_id", answers.truthy(v).alias("flag"))


@query(f"SELECT row_id, 'NL: ' || nl || ' [SEP] SQL: ' || sql AS line FROM {corpus.SQL}")
def am6_model_text(spark, d):
    return corpus.queries(spark, d).select("row_id", text.model_text("nl", "sql").alias("line"))


@query("SELECT o_orderkey, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['SELECT ' || o_custkey, o_orderpriority] WHEN 1 THEN ['SELECT ' || o_custkey] WHEN 2 THEN [o_orderstatus || ', ' || o_orderpriority] ELSE [] END) AS item FROM orders")
def am1_am2_am7_lists(spark, d):
    k, q = F.col("o_orderkey") % 4, F.concat(F.lit("SELECT "), "o_custkey")
    x = F.when(k == 0, F.concat(F.lit("['"), q, F.lit("', '', ' "), "o_orderpriority", F.lit("', None]"))).when(k == 1, F.concat(F.lit(" "), q, F.lit(" "))).when(k == 2, F.concat(F.lit('["'), "o_orderstatus", F.lit(", "), "o_orderpriority", F.lit('"]')))
    return table(spark, d, "orders").select("o_orderkey", F.explode(answers.parsed_list(x)).alias("item"))


# == corruption ===========================================================================================
# by template: what stands after the condition stays from ORDER BY, else GROUP BY on
@query(f"""SELECT row_id, CASE WHEN k IN (3, 4) THEN sql WHEN k = 1 THEN regexp_extract(sql, '^(.*?) WHERE', 1) || ' ORDER BY n DESC, `Segment`;' WHEN k = 2 THEN regexp_extract(sql, '^(.*?) WHERE', 1) || ' ORDER BY `Customer Name`;'
WHEN k = 5 THEN regexp_extract(sql, '^(.*?) WHERE', 1) || ' ORDER BY `Segment`;' WHEN k = 7 THEN regexp_extract(sql, '^(.*?) WHERE', 1) || ' ' || regexp_extract(sql, '(ORDER BY .*)$', 1) || ';' ELSE regexp_extract(sql, '^(.*?) WHERE', 1) || ';' END AS gone FROM (SELECT *, row_id % {len(corpus.TEMPLATES)} AS k FROM {corpus.SQL})""")
def cr1_remove_where(spark, d):
    return corpus.queries(spark, d).select("row_id", corruption.remove_where("sql").alias("gone"))


@query(f"SELECT c_custkey, 'SELECT ' || ['SUM', 'AVG', 'MAX', 'MIN'][1 + cast(floor({_md5_u(7, 'agg-COUNT', 'c_custkey')} * 4) AS int)] || '(x) FROM country' AS sql FROM customer")
def cr2_change_agg(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.lit("SELECT COUNT(x) FROM country").alias("sql"))
    return c.select("c_custkey", corruption.change_agg("sql", 7, F.col("c_custkey")).alias("sql"))


_FALLBACK_VALUES = "[" + ",".join(f"'{v}'" for v in corruption.FALLBACK_VALUES) + "]"
_QUOTE = "chr(39)"
_CONDITION = f"""SELECT c_custkey, ['item_id','uuid','name','description','status','created_at','updated_at'][1 + cast(floor({_md5_u(7, 'column', 'c_custkey')} * 7) AS int)] AS c,
['=','!=','>','<','>=','<=','LIKE','NOT LIKE','IN','NOT IN','BETWEEN','IS NULL','IS NOT NULL'][1 + cast(floor({_md5_u(7, 'operator', 'c_custkey')} * 13) AS int)] AS op,
{_QUOTE} || {_FALLBACK_VALUES}[1 + cast(floor({_md5_u(7, 'value', 'c_custkey')} * 6) AS int)] || {_QUOTE} AS one,
array_to_string(list_transform(list_sort(list_transform({_FALLBACK_VALUES}, lambda v: md5('7:list:' || c_custkey || ':' || v) || v))[1:3], lambda x: {_QUOTE} || substr(x, 33) || {_QUOTE}), ', ') AS few,
cast(floor({_md5_u(7, 'low', 'c_custkey')} * 51) AS int) || ' AND ' || (51 + cast(floor({_md5_u(7, 'high', 'c_custkey')} * 50) AS int)) AS span FROM customer"""


@query(f"SELECT c_custkey, 'SELECT a FROM t WHERE ' || c || ' ' || op || CASE WHEN op LIKE 'IS%' THEN '' WHEN op IN ('IN', 'NOT IN') THEN ' (' || few || ')' WHEN op = 'BETWEEN' THEN ' ' || span ELSE ' ' || one END || ';' AS sql FROM ({_CONDITION})")
def cr3_cr7_add_condition(spark, d):
    c = corruption.with_plausible(table(spark, d, "customer").select("c_custkey", F.lit("x").alias("db_id"), F.lit("SELECT a FROM t").alias("sql")), None)
    return c.select("c_custkey", corruption.add_condition("sql", 7, F.col("c_custkey")).alias("sql"))


_ITEMS = "['a', 'b', 'c']"


@query(f"SELECT c_custkey, 'SELECT ' || array_to_string(list_filter({_ITEMS}, lambda v: v <> {_ITEMS}[1 + cast(floor({_md5_u(7, 'remove', 'c_custkey')} * 3) AS int)]), ', ') || ' FROM t' AS removed, 'SELECT a, b, c, ' || ['item_id','uuid','name','description','status','created_at','updated_at'][1 + cast(floor({_md5_u(7, 'add', 'c_custkey')} * 7) AS int)] || ' FROM t' AS added FROM customer")
def cr4_select_list(spark, d):
    c = corruption.with_plausible(table(spark, d, "customer").select("c_custkey", F.lit("x").alias("db_id"), F.lit("SELECT a, b, c FROM t").alias("sql")), None)
    k = F.col("c_custkey")
    return c.select("c_custkey", corruption.remove_column("sql", 7, k).alias("removed"), corruption.add_column("sql", 7, k).alias("added"))


@query()
def cr5_cr6_cr8_corrupted(spark, d):
    q = corruption.with_plausible(spread(corpus.queries(spark, d)).withColumn("db_id", F.lit("x")), None)
    return corruption.corrupted(q, "sql", "row_id").select("row_id", "corrupted_sql", "corruption_count", "is_corrupted")


_NOT_ENTITIES = "[" + ",".join(f"'{w}'" for w in sqltext.NOT_ENTITIES) + "]"


@query(
    f"SELECT row_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(regexp_replace(sql, '[\"'']([^\"'']+)[\"'']', '', 'g')), '\\b[a-z_][a-z0-9_]*\\b'), lambda w: NOT list_contains({_NOT_ENTITIES}, w) AND NOT regexp_full_match(w, 't\\d*') AND length(w) > 1), list_transform(regexp_extract_all(sql, '[\"'']([^\"'']+)[\"'']', 1), lambda v: lower(v))))), '|') AS names FROM {corpus.SQL}"
)
def cr9_entities(spark, d):
    return corpus.queries(spark, d).select("row_id", F.array_join(F.array_sort(sqltext.entities("sql")), "|").alias("names"))


@query("SELECT p_partkey, lower(p_type) || ' ' || lower(split_part(p_name, ' ', 1)) || CASE p_partkey % 4 WHEN 2 THEN ' year' ELSE '' END AS p FROM part")
def cr10_entity_phrase(spark, d):
    k = F.col("p_partkey") % 4
    e = F.concat(F.lower("p_type"), F.lit("_"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.when(k == 0, "_name").when(k == 1, "_title").when(k == 2, "Year").otherwise(""))
    return table(spark, d, "part").select("p_partkey", e.alias("e")).select("p_partkey", sqltext.entity_phrase("e").alias("p"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::double[], (SELECT embedding::double[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS cosine FROM embeddings")
def cr12_cosine(spark, d):
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("first"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", r6(similarity.cosine("embedding", "first")).alias("cosine"))


@query("WITH w AS (SELECT embedding::double[] v FROM embeddings WHERE vec_id BETWEEN 1 AND 5) SELECT vec_id, round(max(list_cosine_similarity(embedding::double[], v)), 6) AS best, round(max(list_cosine_similarity(embedding::double[], v)), 6) >= 0.45 AS mentioned FROM embeddings, w GROUP BY vec_id")
def cr11_max_cosine(spark, d):
    e = table(spark, d, "embeddings")
    words = e.filter("vec_id between 1 and 5").agg(F.collect_list("embedding").alias("words"))
    best = r6(corruption.max_cosine(F.col("embedding"), F.col("words")))
    return e.crossJoin(F.broadcast(words)).select("vec_id", best.alias("best"), (best >= 0.45).alias("mentioned"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(x - s) > 0.3 AND s > 0.7 THEN greatest(x, s) WHEN abs(x - s) > 0.3 AND s < 0.5 THEN least(x, s) ELSE x END, 8) AS score, round(greatest(s * (1 - 0.1 * l_linenumber), 0), 8) AS fallback FROM (SELECT *, least(greatest(0.4 * s + 0.6 * pow(0.7, l_linenumber - 1) * pow(0.7, floor(l_tax * 50)), 0), 1) AS x FROM (SELECT *, l_quantity / 50 AS s FROM lineitem))")
def cr13_cr14_graded(spark, d):
    li = table(spark, d, "lineitem").withColumn("s", F.col("l_quantity") / 50)
    score = corruption.graded(F.col("s"), F.col("l_linenumber") - 1, F.floor(F.col("l_tax") * 50))
    return li.select("l_orderkey", "l_linenumber", F.round(score, 8).alias("score"), F.round(corruption.penalised(F.col("s"), F.col("l_linenumber")), 8).alias("fallback"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN 'two' ELSE 'How much does ' || c_name || ' owe?' END AS q FROM customer")
def cr15_question_of(spark, d):
    k, q = F.col("c_custkey") % 5, F.concat(F.lit("How much does "), "c_name", F.lit(" owe?"))
    x = (
        F.when(k == 0, F.concat(F.lit("think\n<question> "), q, F.lit(" </question> x")))
        .when(k == 1, F.concat(F.lit("a\nQuestion: "), q, F.lit(" \nz")))
        .when(k == 2, F.concat(F.lit("short\n"), q, F.lit("\nok")))
        .when(k == 3, F.lit("one\ntwo"))
        .otherwise(F.concat(F.lit("Question: "), q, F.lit(" Validate: x")))
    )
    return table(spark, d, "customer").select("c_custkey", x.alias("x")).select("c_custkey", answers.question_of("x").alias("q"))


# == translation ==========================================================================================
_PAIR_SQL = "(" + _PAIRS.format("INNER") + ")"


@query(f"SELECT conv_id, turn, reason = 'ok' AS is_valid, reason FROM (SELECT conv_id, turn, CASE WHEN NOT regexp_matches(t, '\\S') THEN 'empty' WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 2 OR NOT regexp_matches(t, '\\p{{L}}') THEN 'suspicious' WHEN NOT (CASE WHEN length(o) > 0 THEN length(t) / length(o) ELSE 0 END BETWEEN 0.3 AND 3) THEN 'length_ratio' ELSE 'ok' END AS reason FROM (SELECT conv_id, turn, coalesce(text_orig, '') AS o, coalesce(text_trans, '') AS t FROM {_PAIR_SQL}))")
def tr1_tr4_verdict(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", translation.verdict("text_orig", "text_trans").alias("v")).select("conv_id", "turn", "v.is_valid", "v.reason")


@query(f"SELECT lang, count(*) AS total, count(*) FILTER (reason = 'ok') AS accepted, count(*) FILTER (reason <> 'ok') AS rejected, cast(sum(length(text_trans)) FILTER (reason = 'ok') AS bigint) AS kept_chars, count(*) FILTER (reason = 'length_ratio') AS by_length FROM (SELECT *, CASE WHEN turn % 4 < 2 THEN 'tr' ELSE 'es' END AS lang, CASE WHEN length(text_trans) < 2 OR NOT regexp_matches(text_trans, '\\p{{L}}') THEN 'suspicious' WHEN NOT (CASE WHEN length(text_orig) > 0 THEN length(text_trans) / length(text_orig) ELSE 0 END BETWEEN 0.3 AND 3) THEN 'length_ratio' ELSE 'ok' END AS reason FROM {_PAIR_SQL}) GROUP BY lang")
def tr7b_heuristic_batch(spark, d):
    p = _pairs(spark, d).withColumn("lang", F.when(F.col("turn") % 4 < 2, "tr").otherwise("es"))
    yes, no, counts = translation.heuristic_batch(p, "text_orig", "text_trans")
    kept = yes.groupBy("lang").agg(F.sum(F.length("text_trans")).alias("kept_chars"))
    lost = no.groupBy("lang").agg(F.count_if(F.col("reason") == "length_ratio").alias("by_length"))
    return counts.join(kept, "lang", "left").join(lost, "lang", "left").withColumn("by_length", F.coalesce("by_length", F.lit(0)))


_SCORES = "(SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE least(value / 100, 1) END AS s, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END AS b FROM events)"


@query(f"SELECT event_id, round(c, 8) AS combined, CASE WHEN c IS NULL THEN 'accept' WHEN round(c, 8) >= 0.72 THEN 'pass' WHEN round(c, 8) >= 0.60 THEN 'review' ELSE 'fail' END AS stage FROM (SELECT event_id, CASE WHEN s IS NOT NULL AND b IS NOT NULL THEN 0.4 * s + 0.6 * b ELSE coalesce(s, b) END AS c FROM {_SCORES})")
def tr5_tr6_decision(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.least(F.col("value") / 100, F.lit(1.0))).alias("s"), F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 100) / 100.0).alias("b"))
    c = F.round(translation.combined("s", "b"), 8)
    return e.select("event_id", c.alias("combined"), translation.decision(c).alias("stage"))


@query(f"SELECT stage, count(*) AS n FROM (SELECT CASE WHEN NOT (CASE WHEN length(o) > 0 THEN length(t) / length(o) ELSE 0 END BETWEEN 0.3 AND 3) THEN 'heuristic' WHEN turn % 3 = 0 THEN 'accept' WHEN turn % 3 = 1 THEN 'pass' ELSE 'review' END AS stage FROM (SELECT turn, text_orig AS o, text_trans AS t FROM {_PAIR_SQL})) GROUP BY stage")
def tr7_gate(spark, d):
    p = _pairs(spark, d).withColumns({"semantic_similarity": F.when(F.col("turn") % 3 == 1, 0.9).when(F.col("turn") % 3 == 2, 0.65).cast("double"), "back_translation_similarity": F.lit(None).cast("double")})
    return translation.gate(p, "text_orig", "text_trans").groupBy(F.col("quality_stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name || '|' || 'Nation ' || c_nationkey || '|' || c_mktsegment AS names FROM customer")
def tr9_tr10_entities(spark, d):
    nation = F.concat(F.lit("Nation "), "c_nationkey")
    found = [(F.col("c_mktsegment"), "X"), (nation, "GPE"), (F.lower("c_mktsegment"), "Y"), (F.upper("c_name"), "X"), (F.col("c_name"), "PERSON"), (F.lit("ab"), "GPE")]
    e = F.array(*[F.struct(t.alias("text"), F.lit(k).alias("label")) for t, k in found])
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(translation.merged_entities(e), lambda e: e["text"]), "|").alias("names"))


@query("SELECT s_suppkey, CASE WHEN n_nationkey < 10 THEN upper(n_name) END AS title, coalesce(n_nationkey < 20, false) AS cached FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def tr11_looked_up(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("entity")), "s_nationkey")
    title = F.when(F.col("n_nationkey") < 10, F.upper("n_name")).otherwise(F.concat("n_name", F.lit(" (disambiguation)")))
    known = n.filter("n_nationkey < 20").select(F.col("n_name").alias("entity"), title.alias("title"))
    return translation.looked_up(s, known).select("s_suppkey", "title", "cached")


@query("SELECT c_custkey, 'deal of X' || c_custkey || ' and ' || CASE WHEN c_custkey % 2 = 0 THEN 'Big Seg' ELSE lower(c_mktsegment) || 's' END || ' in Nation' || c_nationkey AS t FROM customer")
def tr12_substituted(spark, d):
    seg = F.lower("c_mktsegment")
    t = F.concat(F.lit("deal of "), F.lower("c_name"), F.lit(" and "), F.when(F.col("c_custkey") % 2 == 0, seg).otherwise(F.concat(seg, F.lit("s"))), F.lit(" in Nation"), "c_nationkey")
    names = F.create_map(F.col("c_name"), F.concat(F.lit("X"), "c_custkey"), F.col("c_mktsegment"), F.lit("Big Seg"), F.lit("customer"), F.lit("WRONG"))
    return spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")).select("c_custkey", similarity.substituted(t, names).alias("t"))


@query("SELECT lang, count(*) AS n FROM customer, (VALUES ('es'), ('tr'), ('ru'), ('zh'), ('ja'), ('hi'), ('de'), ('uk'), ('kk'), ('ro')) AS t(lang) GROUP BY lang")
def tr13_fan_out(spark, d):
    return translation.fan_out(table(spark, d, "customer")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, CASE WHEN u < 0.5 THEN CASE WHEN v < 0.8 THEN 'tr' ELSE 'de' END END AS plan FROM (SELECT c_custkey, {_md5_u(42, 'schema', 'c_custkey')} AS u, {_md5_u(42, 'schema-tr', 'c_custkey')} AS v FROM customer)")
def ev18_schema_plan(spark, d):
    return table(spark, d, "customer").select("c_custkey", translation.schema_plan(F.lit("tr"), F.col("c_custkey"), F.lit("reward")).alias("plan"))


@query()
def tr2_language(spark, d):
    found = spread(table(spark, d, "documents").select("doc_id", "text", "lang")).withColumn("language", translation.detected_language("text"))
    return found.select("doc_id", "language", translation.language_match("text", F.col("lang"), F.col("language")).alias("match"))


@query()
def tr14_bleu(spark, d):
    p = _pairs(spark, d)
    return translation.bleu_share(p, "text_orig", "text_trans").select(r6(F.col("mean_bleu")).alias("mean_bleu"), r6(F.col("share_above")).alias("share_above"))


@query(f"SELECT count(*) AS n, round(avg(r), 6) AS mean_length_ratio, round(min(r), 6) AS min_length_ratio, round(max(r), 6) AS max_length_ratio, round(stddev_samp(r), 6) AS std_length_ratio, round(avg(w), 6) AS mean_word_ratio, round(avg(wo), 6) AS mean_words_original FROM (SELECT CASE WHEN length(text_orig) > 0 THEN length(text_trans) / length(text_orig) ELSE 0 END AS r, CASE WHEN {_wc('text_orig')} > 0 THEN {_wc('text_trans')} / {_wc('text_orig')} ELSE 0 END AS w, {_wc('text_orig')} AS wo FROM {_PAIR_SQL})")
def tr15_tr16_report(spark, d):
    out = translation.report(translation.pair_metrics(_pairs(spark, d), "text_orig", "text_trans"))
    keep = ("mean_length_ratio", "min_length_ratio", "max_length_ratio", "std_length_ratio", "mean_word_ratio", "mean_words_original")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in keep])


# == answers ==============================================================================================
@query(f"SELECT row_id, CASE WHEN row_id % 4 = 3 THEN 'SQL query: ' || sql || '; and more' ELSE sql END AS fenced, sql AS query FROM {corpus.SQL}")
def t1_t2_queries(spark, d):
    k = F.col("row_id") % 4
    x = F.when(k == 0, F.concat(F.lit("x\n```sql\n"), "sql", F.lit("\n```\ny"))).when(k == 1, F.concat(F.lit("```\n"), "sql", F.lit(" ;\n```")))
    x = x.when(k == 2, F.concat(F.lit("  "), "sql", F.lit(" "))).otherwise(F.concat(F.lit("SQL query: "), "sql", F.lit("; and more")))
    s = corpus.queries(spark, d).select("row_id", x.alias("x"))
    return s.select("row_id", F.regexp_replace(answers.fenced("x"), " ;$", "").alias("fenced"), answers.query_of("x").alias("query"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"question1": "' || p_name || ' {x}", "question2": "' || p_type || '"}' END AS json, CASE p_partkey % 3 WHEN 0 THEN p_name || ' {x}|' || p_type ELSE '' END AS questions,
CASE p_partkey % 3 WHEN 0 THEN '{"question2":"' || p_type || '","question1":"' || p_name || ' {x}"}' WHEN 1 THEN '{"old_name":"' || p_name || '","new_name":"' || p_type || '"}' END AS change FROM part""")
def t3_t5_t6_programs(spark, d):
    k = F.col("p_partkey") % 3
    x = F.when(k == 0, F.concat(F.lit('ok {"question2": "'), "p_type", F.lit('", "question1": "'), "p_name", F.lit(' {x}",} end'))).when(k == 1, F.concat(F.lit("old_name: "), "p_name", F.lit('\nnew_name: "'), "p_type", F.lit('",'))).otherwise("nothing")
    s = table(spark, d, "part").select("p_partkey", x.alias("x"))
    return s.select("p_partkey", answers.loose_json(F.col("x")).alias("json"), F.array_join(answers.ordered_questions(F.col("x")), "|").alias("questions"), F.to_json(answers.schema_change_of(F.col("x"))).alias("change"))


@query("""SELECT page_id, regexp_replace(html, ',(\\s*[}\\]])', '\\1', 'g') AS x FROM pages""")
def t4_trailing_commas(spark, d):
    return table(spark, d, "pages").select("page_id", answers.without_trailing_commas("html").alias("x"))


@query("SELECT c_custkey, 'A buyer named ' || c_name || ' of ' || c_mktsegment || '.' AS persona FROM customer")
def t7_persona(spark, d):
    k, who = F.col("c_custkey") % 4, F.concat(F.lit("A buyer named "), "c_name", F.lit(" of "), "c_mktsegment", F.lit("."))
    x = F.when(k == 0, F.concat(F.lit('{"persona": "'), who, F.lit('"}'))).when(k == 1, F.concat(F.lit("## Persona\n"), who, F.lit("\n# Next\nmore"))).when(k == 2, F.concat(F.lit('```json\n{"description": "'), who, F.lit('"}\n```'))).otherwise(F.concat(F.lit(" "), who, F.lit(" ")))
    return table(spark, d, "customer").select("c_custkey", x.alias("x")).select("c_custkey", answers.persona_of("x").alias("persona"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|' || p_type WHEN 1 THEN p_type || '|' || p_name || '|' || p_brand ELSE '' END AS questions FROM part")
def t8_questions(spark, d):
    k = F.col("p_partkey") % 3
    x = F.when(k == 0, F.concat(F.lit('```json\n{"question_3": "'), "p_type", F.lit('", "question1": "'), "p_name", F.lit('"}\n```')))
    x = x.when(k == 1, F.concat(F.lit('{"Question4": "'), "p_brand", F.lit('", "question1": "'), "p_type", F.lit('", "question_2": "'), "p_name", F.lit('"}'))).otherwise('{"question9": "x"}')
    return table(spark, d, "part").select("p_partkey", x.alias("x")).select("p_partkey", F.array_join(answers.questions("x"), "|").alias("questions"))


@query("SELECT c_custkey, 'señor ' || c_name AS translation FROM customer")
def t9_translation(spark, d):
    k, t = F.col("c_custkey") % 4, F.concat(F.lit("señor "), "c_name")
    x = F.when(k == 0, F.concat(F.lit('{"translation": "'), t, F.lit('"}'))).when(k == 1, F.concat(F.lit("Translation: '"), t, F.lit("'"))).when(k == 2, F.concat(F.lit("```text\n“"), t, F.lit("”\n```"))).otherwise(F.concat(F.lit('"'), t, F.lit('"')))
    return table(spark, d, "customer").select("c_custkey", x.alias("x")).select("c_custkey", answers.translation_of("x").alias("translation"))


@query("SELECT event_id, event_id % 5 IN (0, 2, 3) AS retry FROM events")
def t10_retryable(spark, d):
    k = F.col("event_id") % 5
    said = F.when(k == 0, "HTTP 503 Unavailable").when(k == 1, "bad key").when(k == 2, "Quota exceeded for model").when(k == 3, "429: RESOURCE EXHAUSTED")
    return table(spark, d, "events").select("event_id", answers.is_retryable(said).alias("retry"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN (o_orderkey % 90 + 10) / 100.0 END AS threshold FROM orders")
def t12_threshold(spark, d):
    k, x = F.col("o_orderkey") % 3, F.format_string("%.2f", (F.col("o_orderkey") % 90 + 10) / 100.0)
    name = F.when(k == 0, F.concat(F.lit("reward_"), x)).when(k == 1, F.concat(F.lit("prompt_"), x, F.lit("_v2"))).otherwise("base")
    return table(spark, d, "orders").select("o_orderkey", answers.threshold_of(name).alias("threshold"))


@query(f"SELECT row_id, 'Q: ' || nl || ' over ' || table_id AS prompt FROM {corpus.SQL}")
def t11_template(spark, d):
    return corpus.queries(spark, d).select("row_id", text.fill("Q: {nl} over {table}", nl="nl", table="table_id").alias("prompt"))


# == relational constructs through the dialect =================================================================
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: name: (query in the SQLite dialect, oracle form where it differs)
RELATIONAL = {
    "select_where": ("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND NOT c_mktsegment IN ('BUILDING') AND c_nationkey BETWEEN 3 AND 9", None),
    "like": ("SELECT p_partkey FROM part WHERE p_type LIKE '%onom%' OR p_name LIKE 'a%'", "SELECT p_partkey FROM part WHERE p_type ILIKE '%onom%' OR p_name ILIKE 'a%'"),
    "group_having": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING COUNT(*) > 10", None),
    "order_limit": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "joins": ("SELECT n.n_name, COUNT(s.s_suppkey) AS n FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name <> 'ASIA' GROUP BY n.n_name", None),
    "full_join": ("SELECT a.k AS a, b.k AS b FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k", None),
    "set_operators": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", None),
    "case_cast_exists": ("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS state, CAST(c_nationkey AS TEXT) AS t FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "subqueries": ("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", None),
    "recursive_cte": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 10) SELECT n FROM t", None),
    "windows": ("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders", None),
    "group_concat": ("SELECT n_regionkey, LENGTH(GROUP_CONCAT(n_name, ';')) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, length(string_agg(n_name, ';')) AS n FROM nation GROUP BY n_regionkey"),
    "integer_division": ("SELECT n_nationkey, n_nationkey / 4 AS q, n_nationkey % 4 AS r FROM nation", "SELECT n_nationkey, n_nationkey // 4 AS q, n_nationkey % 4 AS r FROM nation"),
    "total_iif": ("SELECT TOTAL(s_acctbal) > 0 AS t, COUNT(IIF(s_acctbal < 0, 1, NULL)) AS n FROM supplier", "SELECT sum(s_acctbal) > 0 AS t, count(CASE WHEN s_acctbal < 0 THEN 1 END) AS n FROM supplier"),
    "glob": ("SELECT p_partkey FROM part WHERE p_type GLOB '*MY'", "SELECT p_partkey FROM part WHERE p_type LIKE '%MY'"),
    "bare_column": ("SELECT r_name, MAX(n_nationkey) AS m FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT any_value(r_name) AS r_name, max(n_nationkey) AS m FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey"),
    "alias_in_where": ("SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier WHERE twice > 10000", "SELECT s_suppkey, s_acctbal * 2 AS twice FROM supplier WHERE s_acctbal * 2 > 10000"),
    "pricing_summary": ("SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS q, ROUND(AVG(l_discount), 6) AS d, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus", None),
    "top_customers": ("SELECT c_custkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey ORDER BY revenue DESC, c_custkey LIMIT 20", None),
}


def _relational(sql: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return runner.Runner(spark, {t: table(spark, d, t) for t in _TABLES}).query(sql)

    return run


for _name, (_sql, _oracle) in RELATIONAL.items():
    query(_oracle or _sql, f"r_{_name}")(_relational(_sql))


# == streams, functions of SQL text ============================================================================
@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value > 1 GROUP BY event_type")
def s_drop_folder(spark, d):
    """Files dropped in two runs; each is read once."""
    source, out, mark = (_shared(spark, x) for x in ("drops", "batches", "mark"))
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 > 0):
        e.filter(part).write.mode("append").json(source)
        stream = drops.read_drops(spark, source, "event_id long, user_id long, event_type string, value double", files=4)
        drops.write_batches(stream, out, mark, lambda b: b.filter("value > 1")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"SELECT row_id, {_wc('sql')} AS words, CASE WHEN k = 7 THEN 1 ELSE 0 END AS subqueries, CASE WHEN k IN (2, 7) THEN 1 ELSE 0 END AS strings FROM (SELECT *, row_id % {len(corpus.TEMPLATES)} AS k FROM {corpus.SQL})")
def s_registered_functions(spark, d):
    register.register(spark)
    q = corpus.queries(spark, d)
    return spark.sql("SELECT row_id, word_count(sql) AS words, subquery_count(sql) AS subqueries, count_if(kind = 'string') AS strings FROM {q}, LATERAL sql_tokens(sql) GROUP BY row_id, sql", q=q)


# == stages ====================================================================================================
_DRAWN = "(cast('0x' || substr(md5('42:' || id || ':1'), 1, 13) AS bigint) / 4503599627370496.0)"


@query(f"""SELECT id AS table_id, 'SELECT `Customer Name`, COUNT(*) FROM "' || name || '" GROUP BY `Customer Name` ORDER BY 1' AS sql, 'SELECT col1, COUNT(*) FROM ' || name || ' GROUP BY col1 ORDER BY 1' AS db_sql, CASE WHEN n % 2 = 0 THEN 'reserved' ELSE 'persona' END AS seeding_type,
CASE WHEN n % 2 = 0 THEN cast(3 + cast(floor({_DRAWN} * 18) AS int) AS varchar) ELSE ['analyst', 'student'][1 + cast(floor({_DRAWN} * 2) AS int)] END AS seeding_value, 1 AS attempts, n_rows FROM (SELECT c_nationkey AS n, '1-1-' || c_nationkey AS id, 'table_1_1_' || c_nationkey AS name, count(DISTINCT c_name) AS n_rows FROM customer GROUP BY c_nationkey)""")
def x7_generate(spark, d):
    from pairforge.plans import stages

    return stages.generate(corpus.tables(spark, d)).select("table_id", "sql", "db_sql", "seeding_type", "seeding_value", "attempts", F.col("db_result_rows").alias("n_rows"))


@query()
def ev8_evolve_stage(spark, d):
    from pairforge.plans import stages

    return stages.evolve(corpus.queries(spark, d), corpus.tables(spark, d), most=0).select("row_id", "schema_change_type", "new_sql", "status", "db_query_match", "accepted")


def _judge(prompt: str) -> str:
    """A judge that looks at the pair and answers in one of five forms."""
    gold, _, predicted = prompt.removeprefix("Gold: ").partition("\nPredicted: ")
    yes = gold.lower() == predicted.lower()
    forms = (
        json.dumps({"equivalent": yes, "why": "both {as read}"}),
        f"Here is my verdict:\n```json\n{json.dumps({'match': 'yes' if yes else 'no'})}\n```",
        "The two are equivalent." if yes else "They are not equivalent.",
        f"score: {0.9 if yes else 0.1}",
        "Yes, the same." if yes else "No, these are different.",
    )
    return forms[len(gold) % len(forms)]


@query(f"SELECT row_id, CASE row_id % 4 WHEN 2 THEN CASE WHEN contains(sql, 'Balance') THEN 0.0 ELSE 1.0 END WHEN 3 THEN 0.0 ELSE 1.0 END AS relaxed FROM {corpus.SQL}")
def qm7_relaxed_match(spark, d):
    """Pairs that differ in their capitals, in nothing, in a column and in a limit."""
    from pairforge.plans import stages

    k = F.col("row_id") % 4
    predicted = F.when(k == 0, F.upper("sql")).when(k == 1, F.col("sql")).when(k == 2, F.replace("sql", F.lit("Balance"), F.lit("Segment"))).otherwise(F.concat("sql", F.lit(" LIMIT 1")))
    pairs = spread(corpus.queries(spark, d)).select("row_id", F.col("sql").alias("gold"), predicted.alias("predicted"))
    return stages.judged_match(pairs, "gold", "predicted", lambda: _judge).select("row_id", F.col("relaxed").cast("double").alias("relaxed"))


@query(f"SELECT row_id, table_id FROM {corpus.SQL} WHERE row_id > 3")
def w1_resume(spark, d):
    from pairforge.plans import stages

    q = corpus.queries(spark, d)
    return stages.resume(q, q.filter("row_id <= 3")).select("row_id", "table_id")


# further queries register themselves
from pairforge.plans import learned as learned  # noqa: E402
