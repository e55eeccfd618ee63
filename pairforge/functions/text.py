"""Text columns: counts, readability, templates. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: C) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def strip(x: C) -> Column:
    """All white space off both ends; SQL's ``trim`` takes spaces only."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def non_blank(x: C) -> Column:
    """True for a text with something other than white space; null counts as blank."""
    return F.coalesce(_c(x).rlike(r"\S"), F.lit(False))


def word_count(x: C) -> Column:
    """Runs of non-space; 0 for a blank or null text."""
    return F.coalesce(F.regexp_count(_c(x), F.lit(r"\S+")), F.lit(0))


def char_count(x: C) -> Column:
    return F.coalesce(F.length(_c(x)), F.lit(0))


def sentence_count(x: C) -> Column:
    """Runs of terminal marks, at least 1 for a text that is not blank."""
    marks = F.regexp_count(_c(x), F.lit(r"[.!?]+"))
    return F.when(non_blank(x), F.greatest(marks, F.lit(1))).otherwise(0)


def syllable_count(x: C) -> Column:
    """Groups of vowels."""
    return F.coalesce(F.regexp_count(F.lower(_c(x)), F.lit(r"[aeiouy]+")), F.lit(0))


def flesch_reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    """Null where there are no words or no sentences."""
    ok = (words > 0) & (sentences > 0)
    return F.when(ok, 206.835 - 1.015 * (words / sentences) - 84.6 * (syllables / words))


def flesch_kincaid_grade(words: Column, sentences: Column, syllables: Column) -> Column:
    ok = (words > 0) & (sentences > 0)
    return F.when(ok, 0.39 * (words / sentences) + 11.8 * (syllables / words) - 15.59)


def same_squeezed(a: C, b: C) -> Column:
    """Equality up to runs of white space."""
    return squeeze(a) == squeeze(b)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def model_text(nl: C, sql: C) -> Column:
    """The line that an ambiguity model reads."""
    return F.concat(F.lit("NL: "), F.coalesce(_c(nl), F.lit("")), F.lit(" [SEP] SQL: "), F.coalesce(_c(sql), F.lit("")))


def fill(template: str, **parts: C) -> Column:
    """A prompt from a template with ``{name}`` places; a null part is empty."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(_c(part).cast("string"), F.lit("")))
    return out
