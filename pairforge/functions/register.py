"""The package's functions for SQL text: table functions and scalar functions of a session."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Scalar functions as SQL bodies, so that they are inlined and stay in the JVM.
SCALARS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION word_count(x STRING) RETURNS INT RETURN coalesce(regexp_count(x, '\\\\S+'), 0)",
    "CREATE OR REPLACE TEMPORARY FUNCTION squeeze(x STRING) RETURNS STRING RETURN trim(regexp_replace(x, '\\\\s+', ' '))",
    "CREATE OR REPLACE TEMPORARY FUNCTION edit_ratio(a STRING, b STRING) RETURNS DOUBLE RETURN CASE WHEN greatest(length(a), length(b)) = 0 THEN 1D ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END",
    "CREATE OR REPLACE TEMPORARY FUNCTION subquery_count(x STRING) RETURNS INT RETURN coalesce(regexp_count(x, '(?i)\\\\(\\\\s*select\\\\b') - regexp_count(x, '(?i)\\\\b(?:as|materialized|exists)\\\\s*\\\\(\\\\s*select\\\\b'), 0)",
)


class Tokens:
    """(pos, kind, token) of a query."""

    def eval(self, sql: str) -> Iterator[tuple]:
        from pairforge.plans.dialect import tokens

        for i, (kind, text) in enumerate(t for t in tokens(sql or "") if t[0] != "space"):
            yield i, kind, text


class Names:
    """(pos, name) of a query's identifiers and quoted values, keywords left out."""

    def eval(self, sql: str) -> Iterator[tuple]:
        from pairforge.functions.sqltext import NOT_ENTITIES
        from pairforge.plans.dialect import bare, tokens

        known, seen = set(NOT_ENTITIES), set()
        for kind, text in tokens(sql or ""):
            name = bare(kind, text).lower()
            if kind in ("word", "name", "dquote", "string") and len(name) > 1 and name not in known and not re.fullmatch(r"t\d*", name) and name not in seen:
                seen.add(name)
                yield len(seen) - 1, name


def register(spark: SparkSession) -> None:
    """``sql_tokens(x)`` and ``sql_names(x)`` as table functions, and the scalar functions."""
    spark.udtf.register("sql_tokens", udtf(Tokens, returnType="pos int, kind string, token string"))
    spark.udtf.register("sql_names", udtf(Names, returnType="pos int, name string"))
    for body in SCALARS:
        spark.sql(body)
