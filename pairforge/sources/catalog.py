"""Catalogs of small tables: readers, look-ups, prompts and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "id string, name string, header array<string>, types array<string>, rows array<array<string>>, page_title string, section_title string, caption string"
BIRD = "db_id string, question string, SQL string, evidence string"


def physical_name(table_id: Column) -> Column:
    """``1-10-2`` as ``table_1_10_2``; names that have the form stay."""
    return F.when(table_id.startswith("table_"), table_id).otherwise(F.concat(F.lit("table_"), F.translate(table_id, "-", "_")))


def logical_id(name: Column) -> Column:
    """The reverse."""
    return F.translate(F.regexp_replace(name, "^table_", ""), "_", "-")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of web tables; broken lines are dropped; ``name`` is the physical name and ``pos`` tells the order."""
    raw = spark.read.schema(TABLES + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = raw.filter(F.col("_bad").isNull() & F.col("id").isNotNull()).drop("_bad")
    return good.withColumn("name", physical_name(F.col("id"))).withColumn("pos", F.monotonically_increasing_id())


def find_table(tables: DataFrame, table_id: str) -> DataFrame:
    """The first table of an id in either form."""
    wanted = table_id.removeprefix("table_").replace("_", "-")
    return tables.filter(logical_id(F.col("id")) == wanted).orderBy("pos").limit(1)


def last_of_each(tables: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """One row for each key, the last in order; a maximum, so that each task sends one row of a key."""
    row = F.struct(*[f"`{c}`" for c in tables.columns])
    return tables.groupBy(F.col(key).alias("_k")).agg(F.max_by(row, F.struct(order)).alias("_r")).select("_r.*")


def read_bird(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Benchmark items; those without question or query are dropped, texts trimmed, no database is ''.

    A file is one JSON array, which one task has to read; with ``lines`` each line is an item or an
    array of its own, and files are split.
    """
    raw = spark.read.schema(BIRD).option("multiLine", not lines).json(path)
    items = raw.filter("question is not null and SQL is not null").select(F.coalesce("db_id", F.lit("")).alias("db_id"), F.trim("question").alias("question"), F.trim("SQL").alias("SQL"), "evidence")
    return items.limit(limit) if limit else items


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """By suffix: csv, json (an array), jsonl or parquet."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return read_csv(spark, path, schema)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix not in ("json", "jsonl"):
        raise ValueError(f"no reader for {path!r}")
    reader = spark.read.option("multiLine", suffix == "json")
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_once(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the Parquet table at ``path`` does not have, so that a repeated run adds nothing."""
    spark = df.sparkSession
    if _is_table(spark, path):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)


def in_batches(df: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], every: int) -> DataFrame:
    """Work through a frame in batches of about ``every`` rows, each appended to ``path`` when it is done; returns the table.

    Rows whose key is written are left out before ``work``, so a run that was
    stopped goes on after its last batch. Batches are hash parts of the keys.
    """
    spark = df.sparkSession
    parts = max(1, -(-df.count() // every))
    for k in range(parts):
        part = df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        if _is_table(spark, path):
            part = part.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
        work(part).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _is_table(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  the first run has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return True


def write_by_language(df: DataFrame, path: str, lang: str = "lang") -> None:
    """One folder for each language, for partition pruning."""
    df.write.mode("overwrite").partitionBy(lang).parquet(path)


def materialise(tables: DataFrame, path: str, mode: str = "append") -> None:
    """Add (derived) tables to a written catalog."""
    tables.write.mode(mode).parquet(path)


def table_frame(spark: SparkSession, header: Sequence[str], types: Sequence[str], rows: Sequence[Sequence[str | None]]) -> DataFrame:
    """One web table as a typed DataFrame; short rows are filled with null, what does not read as a number is null."""
    kinds = {"integer": "bigint", "int": "bigint", "number": "double", "real": "double", "float": "double", "double": "double", "numeric": "double", "boolean": "int", "bool": "int"}
    n = len(header)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
    data = [tuple(None if i >= len(r) or r[i] is None else str(r[i]) for i in range(n)) for r in rows]
    raw = spark.createDataFrame(data, schema)
    return raw.select(*[F.expr(f"try_cast(c{i} as {kinds.get((types[i] if i < len(types) else 'text').lower(), 'string')})").alias(h) for i, h in enumerate(header)])


# -- prompts -------------------------------------------------------------------------------
def schema_text(name: str = "name", header: str = "header", types: str = "types") -> Column:
    """``Table: name``, ``Columns:`` and one line for each column; a missing type is text."""
    line = F.transform(F.col(header), lambda h, i: F.concat(F.lit("  - "), h, F.lit(" ("), F.upper(F.coalesce(F.get(F.col(types), i), F.lit("text"))), F.lit(")")))
    return F.concat(F.lit("Table: "), F.col(name), F.lit("\nColumns:\n"), F.array_join(line, "\n"))


def sample_markdown(rows: int = 2, header: str = "header", data: str = "rows") -> Column:
    """The first rows as a Markdown table, short rows filled with ''."""
    head = F.concat(F.lit("| "), F.array_join(header, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda h: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(data, 1, rows), lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.col(header), lambda h, i: F.coalesce(F.get(r, i), F.lit(""))), " | "), F.lit(" |")))
    return F.array_join(F.concat(F.array(head, rule), body), "\n")


def table_prompt(rows: int | None = 3, name: str = "name", header: str = "header", data: str = "rows") -> Column:
    """Table, columns and sample rows as ``column: value`` lists; all rows for None."""
    sample = F.col(data) if rows is None else F.slice(data, 1, rows)
    body = F.transform(sample, lambda r: F.array_join(F.transform(F.col(header), lambda h, i: F.concat(h, F.lit(": "), F.coalesce(F.get(r, i), F.lit("")))), ", "))
    text = F.concat(F.lit("Table: "), F.col(name), F.lit("\nColumns: "), F.array_join(header, ", "))
    return text if rows == 0 else F.concat(text, F.lit("\nSample rows:\n"), F.array_join(body, "\n"))


def described(df: DataFrame) -> DataFrame:
    """Count, mean, deviation and extremes of every column."""
    return df.describe()


def cached(df: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Left join with a key-value cache: ``cached`` is true where the key is known, even with a null value."""
    known = cache.select(key, value, F.lit(True).alias("cached")).dropDuplicates([key])
    return df.join(known, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
