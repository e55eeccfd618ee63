"""Schema evolution of tables, and the queries over them.

One :class:`Change` describes what happens. It is applied to a DataFrame
(:func:`evolve`), to whole catalogs of small tables (:func:`evolve_catalog`) and to
query text (:func:`repair`). Random choices are functions of seed and row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.seeded import choice
from pairforge.functions.udf import vectorised
from pairforge.plans.dialect import Rewriter, bare

UNANSWERABLE = "unanswerable"
KINDS = ("add_column", "remove_column", "rename_column", "split_column", "merge_column", "rename_table", "translate")


@dataclass(frozen=True)
class Change:
    """``kind`` and what it needs.

    add_column: ``new`` name to sample values. remove_column: ``columns``.
    rename_column, translate: ``names`` old to new (and ``table``). split_column: one
    of ``columns``, ``new`` names to sample values, or ``separator`` for real parts.
    merge_column: ``columns`` into the first of ``new``. rename_table: ``table``.
    """

    kind: str
    columns: tuple[str, ...] = ()
    names: Mapping[str, str] = field(default_factory=dict)
    new: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    table: str | None = None
    separator: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown change {self.kind!r}")


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def merged(columns: Sequence[str]) -> Column:
    """Values joined by comma and space, null as the empty text (so ``concat_ws`` will not do)."""
    return F.array_join(F.array(*[F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns]), ", ")


def evolve(df: DataFrame, change: Change, row_id: str | None = None, seed: int = 42) -> DataFrame:
    """The changed table: a projection, so no shuffle.

    ``row_id`` names the row for sampled values; without it all columns do.
    """
    key = [_col(row_id)] if row_id else [F.to_json(F.struct(*[_col(c) for c in df.columns]))]

    def sampled(name: str, values: Sequence[str]) -> Column:
        return choice(F.array(*map(F.lit, values)), seed, name, *key) if values else F.lit("")

    if change.kind == "add_column":
        return df.withColumns({n: sampled(n, v) for n, v in change.new.items()})
    if change.kind == "remove_column":
        gone = {c.lower() for c in change.columns}
        return df.select(*[_col(c) for c in df.columns if c.lower() not in gone])
    if change.kind in ("rename_column", "translate"):
        names = {k.lower(): v for k, v in change.names.items()}
        return df.select(*[_col(c).alias(names.get(c.lower(), c)) for c in df.columns])
    if change.kind == "split_column":
        source = change.columns[0]
        parts = F.split(_col(source).cast("string"), re.escape(change.separator)) if change.separator else None
        new = [(F.get(parts, F.lit(i)) if parts is not None else sampled(n, v)).alias(n) for i, (n, v) in enumerate(change.new.items())]
        return df.select(*[_col(c) for c in df.columns if c.lower() != source.lower()], *new)
    if change.kind == "merge_column":
        gone = {c.lower() for c in change.columns}
        return df.select(*[_col(c) for c in df.columns if c.lower() not in gone], merged(change.columns).alias(next(iter(change.new))))
    return df


# -- queries -----------------------------------------------------------------------------------
def mentions(sql: str, columns: Sequence[str]) -> list[str]:
    """Those of the columns that stand in a query as whole names, quoted or plain."""
    r = Rewriter(sql)
    names = {bare(k, t).strip().lower() for k, t in r.toks if k in ("word", "name", "dquote")}
    return [c for c in columns if c.strip().lower() in names or not re.fullmatch(r"\w+", c) and re.search(rf"(?i)(?<!\w){re.escape(c)}(?!\w)", sql)]


def rename_in(sql: str, names: Mapping[str, str]) -> str:
    """Names replaced where they stand as names; string literals stay. New names that need it are quoted."""
    low = {k.strip().lower(): v for k, v in names.items()}
    r = Rewriter(sql)
    for i, (kind, text) in enumerate(r.toks):
        if kind in ("word", "name", "dquote"):
            new = low.get(bare(kind, text).strip().lower())
            if new is not None:
                r.toks[i] = ("name", f"`{new}`") if kind == "name" or not re.fullmatch(r"[A-Za-z_]\w*", new) else (kind, new if kind == "word" else f'"{new}"')
    return r.sql()


def _items(r: Rewriter, clause: tuple[int, int]) -> list[tuple[int, int]]:
    return r.split(clause[0] + 1, clause[1])


def repair_merge(sql: str, columns: Sequence[str], new: str) -> str:
    """The query over the merged column, or ``unanswerable``.

    The merged columns may only stand together: all of them as items of the
    select list, or all in one CONCAT.
    """
    if not mentions(sql, columns):
        return sql
    low = {c.strip().lower() for c in columns}
    r = Rewriter(sql)
    # a CONCAT of all of them is the merged column
    i = len(r.toks) - 1
    while i >= 0:
        if r.word(i) == "concat" and r.text(r.step(i)) == "(":
            end = r.closing(r.step(i))
            inside = {bare(k, t).strip().lower() for k, t in r.toks[i:end] if k in ("word", "name", "dquote")}
            if low <= inside:
                r.replace(i, end + 1, f"`{new}`")
        i -= 1
    parts = r.clauses()
    if "select" not in parts:
        return UNANSWERABLE
    for name in ("where", "group", "having", "order"):
        if name in parts and low & {bare(k, t).strip().lower() for k, t in r.toks[slice(*parts[name])] if k in ("word", "name", "dquote")}:
            return UNANSWERABLE
    items = _items(r, parts["select"])
    plain = [r.plain(*item) for item in items]
    whole = [p for p in plain if p in low]
    if whole and set(whole) != low:
        return UNANSWERABLE
    others = [r.sql(*item).strip() for item, p in zip(items, plain, strict=True) if p not in low]
    if any(mentions(o, columns) for o in others):
        return UNANSWERABLE  # part of an expression that is no CONCAT of all
    if whole:
        a, b = parts["select"]
        r.replace(a + 1, b, " " + ", ".join([*others, f"`{new}`"]) + " ")
    return r.sql()


def repair(sql: str, change: Change) -> str:
    """A query after a change: as it is, rewritten, or ``unanswerable``."""
    if change.kind in ("rename_column", "translate"):
        names = dict(change.names)
        return rename_in(sql, names)
    if change.kind in ("remove_column", "split_column"):
        return UNANSWERABLE if mentions(sql, change.columns) else sql
    if change.kind == "merge_column":
        return repair_merge(sql, change.columns, next(iter(change.new)))
    return sql


#: Whole numbers of a query, and what is read over; the numbers that stand for them while it is repaired.
_NUMBER = re.compile(r"`[^`]*`|\[[^\]]*\]|\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|[A-Za-z_][\w$]*|(?<![\w.])(\d+)(?![\w.])")
_MARK, _MARKED = "990099", re.compile(r"990099(\d{3})")


def repeated_repair(change: Change, then: Callable[[str], str] = str) -> Callable[[str], str]:
    """:func:`repair` (and ``then`` of what is answerable) for many queries, those that differ in whole numbers once.

    Names are found by the tokens that they are, or by a search for the columns' text; numbers are neither
    where no column's name has a digit.
    """
    known: dict[str, list[str]] = {}
    alone = any(c.isdigit() for name in (*change.columns, *change.names) for c in name)

    def direct(sql: str) -> str:
        new = repair(sql, change)
        return new if new == UNANSWERABLE else then(new)

    def repaired(sql: str) -> str:
        numbers: list[str] = []

        def mark(m: re.Match) -> str:
            if m[1] is None:
                return m[0]
            numbers.append(m[1])
            return f"{_MARK}{len(numbers) - 1:03d}"

        if alone or not sql or _MARK in sql or "--" in sql or "/*" in sql:
            return direct(sql)
        form = _NUMBER.sub(mark, sql)
        if len(numbers) > 999:
            return direct(sql)
        if form not in known:
            known[form] = _MARKED.split(direct(form))
        parts = known[form]
        return parts[0] if len(parts) == 1 else "".join(numbers[int(x)] if i % 2 else x for i, x in enumerate(parts))

    return repaired


@vectorised("string")
def _repair_rename(sql: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if q is None else rename_in(q, dict(n) if n is not None else {}) for q, n in zip(sql, names, strict=True)])


def repaired(df: DataFrame, sql: str, change: Change) -> DataFrame:
    """Add ``new_sql`` and ``change_state`` (unchanged, rewritten, unanswerable).

    A cheap test first: queries that name no affected column skip the program.
    """
    affected = list(change.names) if change.names else list(change.columns)
    touched = F.lit(False)
    for c in affected:
        touched = touched | F.contains(F.lower(sql), F.lit(c.lower()))

    @F.pandas_udf("string")
    def program(qs: pd.Series) -> pd.Series:
        known = {q: None if q is None else repair(q, change) for q in qs.unique()}
        return qs.map(known)

    hit = df.filter(F.coalesce(touched, F.lit(False))).withColumn("new_sql", program(F.col(sql)))
    rest = df.filter(~F.coalesce(touched, F.lit(False))).withColumn("new_sql", F.col(sql))
    state = F.when(F.col("new_sql") == UNANSWERABLE, UNANSWERABLE).when(F.col("new_sql") == F.col(sql), "unchanged").otherwise("rewritten")
    return hit.unionByName(rest).withColumn("change_state", state)


_AGG = re.compile(r"(?i)\b(COUNT|SUM|AVG|MAX|MIN|GROUP_CONCAT)\s*\(")


def joins_columns(sql: str) -> bool:
    """Whether a query uses two or more columns in one operation: a key list, a select list, an expression or a condition."""
    r = Rewriter(sql)
    parts = r.clauses()
    if "select" not in parts:
        return False

    def names(a: int, b: int) -> set[str]:
        out = set()
        for j in range(a, b):
            kind, text = r.toks[j]
            if kind in ("name", "dquote") or kind == "word" and r.text(r.step(j)) != "(" and text.lower() not in _WORDS and r.word(r.step(j, -1)) != "as":
                out.add(bare(kind, text).strip().lower())
        return out

    for name in ("group", "order"):
        if name in parts:
            begin = r.step(r.step(parts[name][0]))
            if sum(bool(names(a, b)) and "(" not in r.sql(a, b) for a, b in r.split(begin, parts[name][1])) >= 2:
                return True
    items = _items(r, parts["select"])
    if sum(r.plain(a, b) not in (None, "*") for a, b in items) >= 2:
        return True
    if any(not _AGG.search(r.sql(a, b)) and "(" not in r.sql(a, b) and len(names(a, b)) >= 2 for a, b in items):
        return True
    return any(len(names(*parts[n])) >= 2 for n in ("where", "having") if n in parts)


_WORDS = {w for w in "select distinct from where group order by having limit offset and or not in like between is null true false as asc desc case when then else end on join".split()}


@vectorised("boolean")
def uses_columns_together(sql: pd.Series) -> pd.Series:
    return sql.map(lambda q: bool(q) and joins_columns(q))


# -- checks --------------------------------------------------------------------------------------
def differing_rows(before: DataFrame, after: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Row ids whose shared columns are not all kept, nulls equal to nulls; rows of one side only count too."""
    a = before.select(F.col(row_id), F.struct(*[_col(c) for c in columns]).alias("_a"))
    b = after.select(F.col(row_id), F.struct(*[_col(c) for c in columns]).alias("_b"))
    return a.join(b, row_id, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(row_id)


def values_kept(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> bool:
    """Whether both tables have the same rows in the shared columns, as multisets."""
    a, b = (d.select(*[_col(c) for c in columns]) for d in (before, after))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def accepted(kind: Column, status: Column, equal: Column | None = None) -> Column:
    """Added and renamed columns need a result; translations the same result; other changes take any but an error."""
    same = F.coalesce(equal, F.lit(False)) if equal is not None else F.lit(False)
    return F.when(kind.isin("add_column", "rename_column"), status == "rows").when(kind == "translate", same).otherwise(status != "error")


def derived_id(parent: str, change: Change, seed: int = 42) -> str:
    """A stable id for the changed table: the mark, a digest of parent, change and seed, and the parent."""
    digest = hashlib.md5(repr((parent, change.kind, change.columns, sorted(change.names.items()), sorted((k, tuple(v)) for k, v in change.new.items()), seed)).encode()).hexdigest()
    return f"m-{int(digest[:10], 16)}-{digest[10:18]}-{parent}"


# -- catalogs ---------------------------------------------------------------------------------------
def evolve_rows(header: Sequence[str], types: Sequence[str], rows: Sequence[Sequence[str | None]], change: Change, seed: int = 42) -> tuple[list[str], list[str], list[list[str | None]]]:
    """A change on one table of a catalog, row lists in and out."""
    header, types = list(header), [*types, *["text"] * (len(header) - len(types))][: len(header)]
    rows = [[r[i] if i < len(r) else None for i in range(len(header))] for r in rows]
    gone = {c.strip().lower() for c in change.columns} if change.kind in ("remove_column", "split_column", "merge_column") else set()
    places = {h.strip().lower(): i for i, h in enumerate(header)}
    added: list[list] = [[] for _ in rows]
    if change.kind in ("add_column", "split_column") and not change.separator:
        for n, values in change.new.items():
            for i, out in enumerate(added):
                u = int(hashlib.md5(f"{seed}:{n}:{i}".encode()).hexdigest()[:13], 16) / 16**13
                out.append(values[int(u * len(values))] if values else "")
    elif change.kind == "split_column":
        at = places[change.columns[0].strip().lower()]
        for r, out in zip(rows, added, strict=True):
            parts = (r[at] or "").split(change.separator)
            out += [parts[i] if i < len(parts) else None for i in range(len(change.new))]
    elif change.kind == "merge_column":
        at = [places[c.strip().lower()] for c in change.columns]
        for r, out in zip(rows, added, strict=True):
            out.append(", ".join("" if r[i] is None else str(r[i]) for i in at))
    names = {k.strip().lower(): v for k, v in change.names.items()}
    keep = [i for i, h in enumerate(header) if h.strip().lower() not in gone]
    new = list(change.new) if change.kind in ("add_column", "split_column", "merge_column") else []
    return [names.get(header[i].strip().lower(), header[i]) for i in keep] + new, [types[i] for i in keep] + ["text"] * len(new), [[r[i] for i in keep] + extra for r, extra in zip(rows, added, strict=True)]


def evolve_catalog(tables: DataFrame, change: Change, seed: int = 42) -> DataFrame:
    """Changed tables of a catalog that have the columns, under derived ids with ``parent_table_id``."""
    needed = [c.lower() for c in (list(change.columns) or list(change.names))]

    @F.pandas_udf("id string, header array<string>, types array<string>, rows array<array<string>>")
    def program(ids: pd.Series, headers: pd.Series, types: pd.Series, rows: pd.Series) -> pd.DataFrame:
        out = []
        for i, h, t, r in zip(ids, headers, types, rows, strict=True):
            out.append((derived_id(i, change, seed), *evolve_rows(list(h), list(t), [list(x) for x in r], change, seed)))
        return pd.DataFrame(out, columns=["id", "header", "types", "rows"])

    lower = F.transform("header", lambda h: F.lower(F.trim(h)))
    able = tables.filter(F.forall(F.array(*map(F.lit, needed)), lambda c: F.array_contains(lower, c))) if needed else tables
    changed = able.withColumn("_x", program("id", "header", "types", "rows"))
    name = F.lit(change.table) if change.table else F.concat(F.lit("table_"), F.translate(F.col("_x.id"), "-", "_"))
    return changed.select("_x.id", name.alias("name"), "_x.header", "_x.types", "_x.rows", F.col("id").alias("parent_table_id"), F.lit(True).alias("is_derived"))
