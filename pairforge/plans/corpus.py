"""A catalog and thousands of queries over it, made of the driver's tables.

Every nation's customers are one small table; every order is a query over one of
these tables, by one of the templates. Queries are told apart by
``row_id % len(TEMPLATES)``. Both engines build the texts from the same parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = ("Cust No", "Customer Name", "Segment", "Balance")
#: {t}: the table, {x}: a balance, {y}: a larger one, {s}: a segment, {p}: how it begins, {l}: 0 to 2.
TEMPLATES = (
    "SELECT COUNT(*) AS n FROM {t} WHERE `Balance` > {x}",
    "SELECT `Segment`, COUNT(*) AS n FROM {t} WHERE `Balance` > {x} GROUP BY `Segment` ORDER BY n DESC, `Segment`",
    "SELECT `Customer Name` FROM {t} WHERE `Segment` = '{s}' AND `Balance` BETWEEN {x} AND {y} ORDER BY `Customer Name`",
    "SELECT MAX(`Balance`) - MIN(`Balance`) AS span FROM {t}",
    "SELECT `Missing`, `Segment` FROM {t} LIMIT {l}, 3",
    "WITH rich AS (SELECT `Segment`, `Balance` FROM {t} WHERE `Balance` > {x}) SELECT DISTINCT `Segment` FROM rich ORDER BY `Segment`",
    "SELECT `Cust No`, `Balance` FROM {t} WHERE `Balance` < -{x}000 OR `Segment` IS NULL",
    "SELECT `Customer Name` FROM {t} WHERE `Balance` > (SELECT AVG(`Balance`) FROM {t}) AND `Segment` LIKE '{p}%' ORDER BY `Cust No` LIMIT {l}, 5",
    "SELECT `Customer Name`, `Segment` FROM {t} WHERE `Balance` > {x}",
)
#: The parts as SQL that both engines read.
_PARTS = {
    "t": "concat('table_1_1_', cast(n AS string))",
    "x": "cast(x AS string)",
    "y": "cast(x + 4000 AS string)",
    "s": "s",
    "p": "lower(substring(s, 1, 2))",
    "l": "cast(row_id % 3 AS string)",
}
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _text(template: str) -> str:
    """The template as a call of concat; quotes are written as their code, as engines escape them differently."""
    parts = ["chr(39)" if p == "'" else _PARTS[p[1]] if re.fullmatch(r"\{\w\}", p) else f"'{p}'" for p in re.split(r"(\{\w\}|')", template) if p]
    return "concat(" + ", ".join(parts) + ")"


_SEGMENT = "CASE o_custkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SEGMENTS)) + " END"
_SQL = f"CASE row_id % {len(TEMPLATES)} " + " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(TEMPLATES)) + " END"
_BASE = f"SELECT o_orderkey AS row_id, o_custkey % 25 AS n, cast(floor(o_totalprice / 50) AS bigint) AS x, {_SEGMENT} AS s FROM {{orders}}"
_QUERIES = f"SELECT row_id, concat('1-1-', cast(n AS string)) AS table_id, concat('Question ', cast(row_id AS string), ' about ', s) AS nl, {_SQL} AS sql, n, x, s FROM ({_BASE})"

#: The queries for an oracle: row_id, table_id, nl, sql, and what they were made of (n, x, s).
SQL = "(" + _QUERIES.format(orders="orders") + ")"


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, table_id, nl, sql), one for each order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(_QUERIES.format(orders="{orders}"), orders=orders).select("row_id", "table_id", "nl", "sql")


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, header, types, rows, pos): the customers of each nation, in order of their keys."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cells = F.struct("c_custkey", F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("string")).alias("cells"))
    rows = F.transform(F.array_sort(F.collect_list(cells)), lambda r: r["cells"])
    nations = c.groupBy("c_nationkey").agg(rows.alias("rows"))
    key = F.col("c_nationkey").cast("string")
    header, types = (F.array(*map(F.lit, x)) for x in (HEADER, ("integer", "text", "text", "real")))
    return nations.select(F.concat(F.lit("1-1-"), key).alias("id"), F.concat(F.lit("table_1_1_"), key).alias("name"), header.alias("header"), types.alias("types"), "rows", F.col("c_nationkey").alias("pos"))
