"""SQL text as columns: names, keywords, counts that regular expressions can give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import C, _c

#: Fixed value: the keywords of SQLite that are counted in queries.
RESERVED = (
    "ABORT ACTION ADD AFTER ALL ALTER ALWAYS ANALYZE AND AS ASC ATTACH AUTOINCREMENT BEFORE BEGIN BETWEEN BY CASCADE CASE CAST CHECK COLLATE "
    "COLUMN COMMIT CONFLICT CONSTRAINT CREATE CROSS CURRENT CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP DATABASE DEFAULT DEFERRABLE DEFERRED "
    "DELETE DESC DETACH DISTINCT DO DROP EACH ELSE END ESCAPE EXCEPT EXCLUDE EXCLUSIVE EXISTS EXPLAIN FAIL FILTER FIRST FOLLOWING FOR FOREIGN "
    "FROM FULL GENERATED GLOB GROUP GROUPS HAVING IF IGNORE IMMEDIATE IN INDEX INDEXED INITIALLY INNER INSERT INSTEAD INTERSECT INTO IS ISNULL "
    "JOIN KEY LAST LEFT LIKE LIMIT MATCH MATERIALIZED NATURAL NO NOT NOTHING NOTNULL NULL NULLS OF OFFSET ON OR ORDER OTHERS OUTER OVER "
    "PARTITION PLAN PRAGMA PRECEDING PRIMARY QUERY RAISE RANGE RECURSIVE REFERENCES REGEXP REINDEX RELEASE RENAME REPLACE RESTRICT RETURNING "
    "RIGHT ROLLBACK ROW ROWS SAVEPOINT SELECT SET TABLE TEMP TEMPORARY THEN TIES TO TRANSACTION TRIGGER UNBOUNDED UNION UNIQUE UPDATE USING "
    "VACUUM VALUES VIEW VIRTUAL WHEN WHERE WINDOW WITH WITHOUT"
).split()

#: Fixed value: words that are no entity of a query.
NOT_ENTITIES = (
    "select from where order by group having limit offset insert update delete create drop alter table index and or not in like between is null "
    "exists count sum avg min max distinct as asc desc inner left right outer join on union all case when then else end if while for"
).split()

#: Fixed value: words that are no column of a query.
NOT_COLUMNS = (
    "select from where group by order having limit offset and or not in is null like between as on join left right inner outer count sum avg min "
    "max distinct asc desc case when then else end union"
).split()

#: Fixed value: operators counted by kind, as (kind, pattern over upper-case text without literals).
OPERATORS = (
    ("=", "=|=="),
    ("!= <>", "!=|<>"),
    ("<", "<"),
    (">", ">"),
    ("<=", "<="),
    (">=", ">="),
    ("AND", r"\bAND\b"),
    ("OR", r"\bOR\b"),
    ("NOT", r"\bNOT\b"),
    ("LIKE", r"\bLIKE\b"),
    ("IN", r"\bIN\b"),
    ("BETWEEN", r"\bBETWEEN\b"),
    ("IS NULL", r"\bIS\s+NULL\b"),
    ("IS NOT NULL", r"\bIS\s+NOT\s+NULL\b"),
    ("COUNT", r"\bCOUNT\s*\("),
    ("SUM", r"\bSUM\s*\("),
    ("AVG", r"\bAVG\s*\("),
    ("MIN", r"\bMIN\s*\("),
    ("MAX", r"\bMAX\s*\("),
    ("ORDER BY", r"\bORDER\s+BY\b"),
    ("GROUP BY", r"\bGROUP\s+BY\b"),
    ("HAVING", r"\bHAVING\b"),
    ("JOIN", r"\bJOIN\b"),
    ("LEFT JOIN", r"\bLEFT\s+(?:OUTER\s+)?JOIN\b"),
    ("RIGHT JOIN", r"\bRIGHT\s+(?:OUTER\s+)?JOIN\b"),
    ("INNER JOIN", r"\bINNER\s+JOIN\b"),
    ("OUTER JOIN", r"\bOUTER\s+JOIN\b"),
    ("UNION", r"\bUNION\b"),
    ("DISTINCT", r"\bDISTINCT\b"),
    ("LIMIT", r"\bLIMIT\b"),
    ("CASE", r"\bCASE\b"),
    ("EXISTS", r"\bEXISTS\b"),
    ("AS", r"\bAS\b"),
    ("WHERE", r"\bWHERE\b"),
    ("SELECT", r"\bSELECT\b"),
    ("FROM", r"\bFROM\b"),
    ("INSERT", r"\bINSERT\b"),
    ("UPDATE", r"\bUPDATE\b"),
    ("DELETE", r"\bDELETE\b"),
    ("CREATE", r"\bCREATE\b"),
    ("DROP", r"\bDROP\b"),
    ("ALTER", r"\bALTER\b"),
)
#: Kinds that a syntax tree has no node of their own for: a join's side, an alias and a null test are parts of other nodes.
NAMED_ONLY = ("IS NULL", "IS NOT NULL", "LEFT JOIN", "RIGHT JOIN", "INNER JOIN", "OUTER JOIN", "AS")


def _words(x: C) -> Column:
    """All word runs, upper-case."""
    return F.regexp_extract_all(F.upper(F.coalesce(_c(x), F.lit(""))), F.lit(r"\w+"), F.lit(0))


def reserved_words(x: C) -> Column:
    """Keywords in order, repeats included.

    A whole-word match of a keyword is a word run that equals it, so one pass
    over the text serves all keywords.
    """
    known = F.array(*map(F.lit, RESERVED))
    return F.filter(_words(x), lambda w: F.array_contains(known, w))


def reserved_count(x: C) -> Column:
    return F.size(reserved_words(x))


def reserved_distinct(x: C) -> Column:
    return F.size(F.array_distinct(reserved_words(x)))


def subquery_count(x: C) -> Column:
    """Opening brackets before SELECT, those of WITH queries and of EXISTS left out, as these are no subqueries of a tree."""
    every = F.regexp_count(_c(x), F.lit(r"(?i)\(\s*select\b"))
    other = F.regexp_count(_c(x), F.lit(r"(?i)\b(?:as|materialized|exists)\s*\(\s*select\b"))
    return F.coalesce(every - other, F.lit(0))


def _among(items: Column, wanted: list[str]) -> Column:
    """How many items are one of the wanted."""
    return F.size(F.filter(items, lambda s: s.isin(wanted)))


def operator_counts(x: C) -> dict[str, Column]:
    """Operators by kind, those in literals and quoted names left out.

    The AND of a BETWEEN is none, nor the NOT of IS NOT NULL; comparisons are read whole, so ``<=`` is no ``<``.
    """
    up = F.upper(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"", "x"))
    signs = F.regexp_extract_all(up, F.lit("<=|>=|<>|!=|==|=|<|>"), F.lit(0))
    out = {}
    for kind, p in OPERATORS:
        if kind[0] in "=!<>":
            out[kind] = _among(signs, p.split("|"))
        else:
            out[kind] = F.regexp_count(up, F.lit(p))
    out["AND"] = out["AND"] - out["BETWEEN"]
    out["NOT"] = out["NOT"] - out["IS NOT NULL"]
    return out


def operator_total(x: C) -> Column:
    """All operators that are nodes of a tree."""
    out = F.lit(0)
    for kind, c in operator_counts(x).items():
        if kind not in NAMED_ONLY:
            out = out + c
    return out


def table_name(x: C) -> Column:
    """The first name after FROM, else after JOIN; null if there is neither."""
    name = r"[`\"\[]?([A-Za-z_][\w$]*)"
    first = F.regexp_extract(_c(x), r"(?i)\bfrom\s+" + name, 1)
    second = F.regexp_extract(_c(x), r"(?i)\bjoin\s+" + name, 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def referenced_names(x: C) -> Column:
    """Distinct back-quoted names and plain identifiers that are no keyword, lower-case, in order of occurrence."""
    quoted = F.regexp_extract_all(_c(x), F.lit(r"`([^`]+)`"), F.lit(1))
    plain = F.regexp_extract_all(F.regexp_replace(_c(x), r"`[^`]+`", " "), F.lit(r"\b[A-Za-z_]\w*\b"), F.lit(0))
    known = F.array(*map(F.lit, NOT_COLUMNS))
    names = F.transform(F.concat(quoted, plain), lambda n: F.lower(n))
    return F.array_distinct(F.filter(names, lambda n: ~F.array_contains(known, n)))


def entities(x: C) -> Column:
    """Identifiers without keywords, aliases ``t``, ``t1`` ... and single letters, with the quoted values, lower-case."""
    text = F.coalesce(_c(x), F.lit(""))
    values = F.transform(F.regexp_extract_all(text, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), lambda v: F.lower(v))
    bare = F.lower(F.regexp_replace(text, "[\"']([^\"']+)[\"']", ""))
    words = F.regexp_extract_all(bare, F.lit(r"\b[a-z_][a-z0-9_]*\b"), F.lit(0))
    known = F.array(*map(F.lit, NOT_ENTITIES))
    names = F.filter(words, lambda w: ~F.array_contains(known, w) & ~w.rlike(r"^t\d*$") & (F.length(w) > 1))
    return F.array_distinct(F.concat(names, values))


def entity_phrase(x: C) -> Column:
    """``snake_case`` and ``camelCase`` as words, a trailing name or title dropped."""
    spaced = F.regexp_replace(F.regexp_replace(_c(x), "_", " "), r"([a-z])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(spaced), r"\s+(name|title)$", ""))


def table_ids(x: C) -> Column:
    """Ids ``a-b-c`` of the names ``table_a_b_c`` in a query, in order, distinct."""
    found = F.regexp_extract_all(_c(x), F.lit(r"table_(\d+_\d+_\d+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda t: F.translate(t, "_", "-")))


def cte_names(x: C) -> Column:
    """Names that a WITH list defines, lower-case."""
    names = F.regexp_extract_all(_c(x), F.lit(r"(?i)(?:\bwith\s+(?:recursive\s+)?|\)\s*,\s*)([A-Za-z_]\w*)\s*(?:\([^()]*\)\s*)?\bas\s*\("), F.lit(1))
    return F.when(F.coalesce(_c(x).rlike(r"(?i)^\s*with\b"), F.lit(False)), F.array_distinct(F.transform(names, lambda n: F.lower(n)))).otherwise(F.array().cast("array<string>"))


def normal_type(x: C) -> Column:
    """A declared column type as one of TEXT, INTEGER, REAL, NUMERIC.

    ``number`` is REAL here, so that decimals survive.
    """
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"\(.*$", "")))
    return F.when(t.isin("integer", "int", "boolean", "bool"), "INTEGER").when(t.isin("real", "float", "double", "number"), "REAL").when(t == "numeric", "NUMERIC").otherwise("TEXT")


def plain_type(x: C) -> Column:
    """The reverse: ``number`` or ``text``."""
    return F.when(F.upper(F.trim(_c(x))).isin("INTEGER", "INT", "REAL", "FLOAT", "DOUBLE", "NUMERIC"), "number").otherwise("text")
