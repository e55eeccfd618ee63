"""What can be read out of a model's answer: queries, scores, JSON, translations.

Most of it is regular expressions in the JVM. Brace matching and the parsing of
Python literals are programs and run as pandas UDFs.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import C, _c, strip
from pairforge.functions.udf import vectorised


def _found(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def fenced(x: C, tag: str = "sql") -> Column:
    """The text in the first fence of a language, else in the first fence of any, else the whole, stripped."""
    own = F.regexp_extract(_c(x), rf"(?s)```{tag}\s*(.*?)```", 1)
    anyone = F.regexp_extract(_c(x), r"(?s)```\w*\s*(.*?)```", 1)
    return strip(F.coalesce(_found(own), _found(anyone), _c(x)))


def query_of(x: C) -> Column:
    """The SQL of a free answer: fenced, or after ``SQL query:`` or ``Query:``, or the first paragraph; up to its semicolon."""
    own = _found(F.regexp_extract(_c(x), r"(?is)```(?:sql)?\s*(.*?)```", 1))
    named = _found(F.regexp_extract(_c(x), r"(?is)(?:sql query|query):\s*(.*?)(?:\n\s*\n|$)", 1))
    para = F.substring_index(strip(x), "\n\n", 1)
    return strip(F.substring_index(F.coalesce(own, named, para), ";", 1))


def json_query(x: C) -> Column:
    """``sql_query`` or ``query`` of a JSON answer, else the fenced query."""
    body = fenced(x, "json")
    return F.coalesce(F.get_json_object(body, "$.sql_query"), F.get_json_object(body, "$.query"), fenced(x, "sql"))


def score_of(x: C) -> Column:
    """A score in [0, 1]: JSON ``score``, else ``score: n``, else the first number in range; null if none.

    Scores outside of the range are clamped where the answer names them.
    """
    text = _c(x)
    number = r"(-?\d+(?:\.\d+)?)"
    named = F.coalesce(
        F.get_json_object(fenced(text, "json"), "$.score").try_cast("double"),
        _found(F.regexp_extract(text, r"(?i)[\"']?score[\"']?\s*[:=]\s*" + number, 1)).try_cast("double"),
    )
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda n: n.try_cast("double"))
    first = F.get(F.filter(numbers, lambda n: n.between(0, 1)), F.lit(0))
    clamped = F.when(named.isNotNull(), F.least(F.greatest(named, F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(clamped, first)


def tagged_score(x: C) -> Column:
    """The number in a ``<score>`` tag."""
    return _found(F.regexp_extract(_c(x), r"(?is)<score>\s*(-?\d+(?:\.\d+)?)\s*</score>", 1)).try_cast("double")


def reasoning_reward(completion: C, truth: C) -> Column:
    """-1 without a thought, a score, or a score in range; else 2 exp(-2 error) - 1."""
    score = tagged_score(completion)
    ok = _c(completion).rlike(r"(?is)<think>.*</think>") & score.between(0, 1)
    return F.when(F.coalesce(ok, F.lit(False)), 2 * F.exp(-2 * F.abs(score - _c(truth))) - 1).otherwise(F.lit(-1.0))


def reasoning_reward_squared(completion: C, truth: C) -> Column:
    """The variant with 1 - 2 error ** 2."""
    score = tagged_score(completion)
    ok = _c(completion).rlike(r"(?is)<think>.*</think>") & score.between(0, 1)
    return F.when(F.coalesce(ok, F.lit(False)), 1 - 2 * F.pow(score - _c(truth), 2)).otherwise(F.lit(-1.0))


def without_trailing_commas(x: C) -> Column:
    return F.regexp_replace(_c(x), r",(\s*[}\]])", "$1")


def translation_of(x: C) -> Column:
    """JSON ``translation``, else a fenced text, else what follows ``translation:``; quotes stripped."""
    body = fenced(x, "json")
    named = _found(F.regexp_extract(_c(x), r"(?i)[\"']?translation[\"']?\s*:\s*[\"']?([^\"'\n}]+)", 1))
    got = F.coalesce(F.get_json_object(body, "$.translation"), named, fenced(x, "text"))
    return F.regexp_replace(strip(got), r"^[\"'“”]+|[\"'“”]+$", "")


def question_of(x: C) -> Column:
    """The question of a chain of thought: its tag, else its ``question:`` line, else the last long line, else the last."""
    lines = F.filter(F.transform(F.split(_c(x), "\n"), lambda s: strip(s)), lambda s: F.length(s) > 0)
    long = F.filter(lines, lambda s: F.length(s) > 20)
    tag = _found(strip(F.regexp_extract(_c(x), r"(?is)<question>(.*?)</question>", 1)))
    named = _found(strip(F.regexp_extract(_c(x), r"(?i)question:[ \t]*([^\n]+)", 1)))
    got = F.coalesce(tag, named, F.try_element_at(long, F.lit(-1)), F.try_element_at(lines, F.lit(-1)))
    return strip(F.regexp_replace(got, r"(?is)(validate|think:).*$", ""))


def questions(x: C, n: int = 4) -> Column:
    """Values of the keys ``question1`` .. of a JSON answer, in order, absent ones left out."""
    body = fenced(x, "json")
    keys = [F.coalesce(F.get_json_object(body, f"$.question{i}"), F.get_json_object(body, f"$.question_{i}"), F.get_json_object(body, f"$.Question{i}")) for i in range(1, n + 1)]
    return F.filter(F.array(*keys), lambda q: q.isNotNull())


def persona_of(x: C) -> Column:
    """The persona text: a JSON key, a headed section, or the first 500 characters."""
    body = fenced(x, "json")
    keys = [F.get_json_object(body, f"$.{k}") for k in ("persona", "description", "profile", "character")]
    section = _found(strip(F.regexp_extract(_c(x), r"(?is)(?:^|\n)[#* ]*persona[^\n]*:?\s*\n+(.*?)(?:\n#|\n\*\*|$)", 1)))
    return F.coalesce(*keys, section, F.left(strip(x), F.lit(500)))


def is_retryable(x: C) -> Column:
    """Whether an error may pass: rate limits, quotas, server failures."""
    return F.coalesce(F.lower(_c(x)).rlike(r"429|500|503|quota|rate limit|resource.?exhausted|unavailable|timeout"), F.lit(False))


def threshold_of(x: C) -> Column:
    """The threshold in an experiment's name."""
    return _found(F.regexp_extract(_c(x), r"(\d\.\d+)", 1)).try_cast("double")


def truthy(x: C) -> Column:
    return F.coalesce(F.lower(strip(_c(x).cast("string"))).isin("true", "1", "yes", "y", "t"), F.lit(False))


# -- programs ------------------------------------------------------------------
def brace_match(text: str | None) -> str | None:
    """The first balanced JSON object or array; brackets within strings do not count."""
    if not text:
        return None
    start = next((i for i, c in enumerate(text) if c in "{["), -1)
    if start < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def load_loose(text: str | None):
    """The JSON value in a free answer, trailing commas forgiven; None if there is none."""
    body = brace_match(text)
    if body is None:
        return None
    for candidate in (body, re.sub(r",(\s*[}\]])", r"\1", body)):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    try:
        return ast.literal_eval(body)
    except (ValueError, SyntaxError):
        return None


def literal(text: str | None):
    """A stored Python or JSON literal; None if it is neither."""
    if text is None or not str(text).strip():
        return None
    for parse in (ast.literal_eval, json.loads):
        try:
            return parse(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


def list_of(text: str | None) -> list[str]:
    """A stringified list's items without blanks; a plain text is its own only item."""
    got = literal(text)
    if isinstance(got, (list, tuple)):
        return [str(v).strip() for v in got if v is not None and str(v).strip()]
    return [str(text).strip()] if text is not None and str(text).strip() else []


@vectorised("string")
def loose_json(x: pd.Series) -> pd.Series:
    """The JSON value in a free answer, as canonical JSON text."""
    return x.map(lambda t: None if (v := load_loose(t)) is None else json.dumps(v, sort_keys=True, ensure_ascii=False, default=str))


@vectorised("array<string>")
def ordered_questions(x: pd.Series) -> pd.Series:
    """Values of the ``questionN`` keys of a free answer, by N."""

    def one(t: str | None) -> list[str]:
        got = load_loose(t)
        named = [(int(m[1]), str(v)) for k, v in got.items() if (m := re.fullmatch(r"(?i)question_?(\d+)", str(k)))] if isinstance(got, dict) else []
        return [v for _, v in sorted(named)]

    return x.map(one)


@vectorised("array<string>")
def parsed_list(x: pd.Series) -> pd.Series:
    """Items of a stringified list, blanks removed."""
    return x.map(list_of)


@vectorised("string")
def first_query(x: pd.Series) -> pd.Series:
    """The first item of a stringified list, or the text itself."""
    return x.map(lambda t: next(iter(list_of(t)), None))


@vectorised("string")
def stored_result(x: pd.Series) -> pd.Series:
    """A stored result as canonical JSON: rows of lists; a list of strings is parsed item by item."""

    def one(t: str | None) -> str | None:
        got = literal(t)
        if got is None:
            return None
        if isinstance(got, (list, tuple)):
            got = [v if not isinstance(v, str) or (p := literal(v)) is None or not isinstance(p, (list, tuple)) else p for v in got]
        return json.dumps(got, ensure_ascii=False, default=str)

    return x.map(one)


@vectorised("map<string,string>")
def schema_change_of(x: pd.Series) -> pd.Series:
    """A schema-change answer as a flat map: JSON first, then ``key: value`` lines."""

    def one(t: str | None) -> dict[str, str] | None:
        got = load_loose(t)
        if isinstance(got, dict):
            return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in got.items()}
        pairs = re.findall(r"(?im)^\s*[\"']?(column_name|column_type|old_name|new_name|new_column|columns?|values?|answerable|query)[\"']?\s*[:=]\s*(.+?)\s*,?\s*$", t or "")
        return {k.lower(): v.strip("\"'") for k, v in pairs} or None

    return x.map(one)


def loose_json_column(x: C) -> Column:
    return loose_json(_c(x))
