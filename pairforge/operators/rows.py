"""Projections, filters, joins, windows and set operators of the dataset pipeline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions import sqltext
from pairforge.functions.text import non_blank


# -- projection and filter ---------------------------------------------------------
def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, if it has all columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null in the columns."""
    return require(df, columns).dropna(subset=list(columns))


def all_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a non-blank value in every column."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & non_blank(F.col(c).cast("string"))
    return df.filter(keep)


def in_range(df: DataFrame, column: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    return df.filter(F.col(column).between(lo, hi))


def at_most_tokens(df: DataFrame, column: str, n: int, count=None) -> DataFrame:
    """Rows of at most ``n`` tokens; ``count`` is a column function, words by default."""
    count = count or (lambda c: F.coalesce(F.regexp_count(F.col(c), F.lit(r"\S+")), F.lit(0)))
    return df.filter(count(column) <= n)


def is_derived(table_id: str) -> Column:
    """Whether an id has the mark of a derived table."""
    return F.col(table_id).contains("m")


def first_existing(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is a column, without regard to case."""
    by_lower = {c.lower(): c for c in df.columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def without_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns by name, without regard to case or outer space."""
    drop = {n.strip().lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.strip().lower() not in drop])


def insert_first(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(value.alias(name), *[F.col(f"`{c}`") for c in df.columns if c != name])


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def mapped(column: str, names: Mapping[str, str], otherwise: str | None = None) -> Column:
    """Values through a small map; others stay, or become ``otherwise``."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column) if otherwise is None else F.lit(otherwise))


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """All floating columns rounded half to even."""
    return df.withColumns({f.name: F.bround(f.name, digits) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


# -- joins ------------------------------------------------------------------------------
def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done; null keys stay."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def paired(a: DataFrame, b: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_orig", "_trans"), how: str = "inner") -> DataFrame:
    """Equi-join with suffixes on the columns that both sides have."""
    both = (set(a.columns) & set(b.columns)) - set(on)
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in both})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in both})
    return left.join(right, list(on), how)


def with_table(df: DataFrame, tables: DataFrame, sql: str, table_key: str = "id") -> DataFrame:
    """Each query's row with the first of the tables that its text names and that exists, nulls if there is none.

    The row travels with the first name, so ``df`` is read once and texts are sent once; ``tables`` has one row for each key.
    """
    row = df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[f"`{c}`" for c in df.columns]).alias("_q"), sqltext.table_ids(sql).alias("_ids"))
    named = row.select("_row", "_q", F.posexplode_outer("_ids").alias("_at", "_id")).withColumn("_q", F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_q")))
    known = tables.select(F.col(table_key).alias("_id"), F.struct(*[f"`{c}`" for c in tables.columns]).alias("_t"))
    hit = named.join(known, "_id", "left").drop("_id").filter("_q is not null or _t is not null")
    # dealt out before the aggregate, as an aggregate of rows sorts: it would sort in the join's tasks too, and names hardly meet there
    first = hit.repartition("_row").groupBy("_row").agg(F.first("_q", ignorenulls=True).alias("_q"), F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_at"))).alias("_t"))
    return first.select("_q.*", "_t.*")


def zipped(a: DataFrame, b: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows aligned by an explicit row number."""
    return a.join(b, row_id, "inner")


def set_report(a: Column, b: Column) -> Column:
    """Missing, extra and common members of two sets."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("missing"), F.array_sort(F.array_except(b, a)).alias("extra"), F.array_sort(F.array_intersect(a, b)).alias("common"))


# -- windows ------------------------------------------------------------------------------
def after_last(df: DataFrame, order: str, is_key: Column) -> DataFrame:
    """Rows after the last one with the key, all if there is none: where a run resumes."""
    last = df.filter(is_key).agg(F.max(order).alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def last_original(df: DataFrame, order: str, table_id: str) -> DataFrame:
    """The last table id that is not derived."""
    return df.filter(~is_derived(table_id)).agg(F.max_by(table_id, order).alias(table_id))


def top(df: DataFrame, n: int, score: Column | str, *ties: str, ascending: bool = False) -> DataFrame:
    """The n best rows; a partial top-n in each task."""
    s = F.col(score) if isinstance(score, str) else score
    return df.orderBy(s.asc() if ascending else s.desc(), *ties).limit(n)


def alternating(row_id: str, first: str = "reserved", second: str = "persona") -> Column:
    return F.when(F.pmod(F.col(row_id), F.lit(2)) == 0, first).otherwise(second)


def first_of_each(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in ascending order, nulls first; a minimum, so that each task sends one row of a group."""
    row = F.struct(*[f"`{c}`" for c in df.columns])
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """The rank of each row in its group, ties alike."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(*order)))


def beside(df: DataFrame, by: Sequence[str], order: Sequence[Column], column: str, name: str, offset: int = 1) -> DataFrame:
    """A column's value so many rows before (negative: after) in the group; null beyond its ends."""
    return df.withColumn(name, F.lag(column, offset).over(Window.partitionBy(*by).orderBy(*order)))


# -- sets ----------------------------------------------------------------------------------
def stacked(*parts: DataFrame) -> DataFrame:
    """Union by name, missing columns null, with the part's number for its order."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def distinct_folded(df: DataFrame, column: str, order: str) -> DataFrame:
    """One row for each value without regard to case, the first in order."""
    return first_of_each(df, [F.lower(column)], [F.col(order)])


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have, nulls equal to nulls; columns by place."""
    return a.intersect(b)


def only_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first that the second does not have; columns by place."""
    return a.subtract(b)
