"""Complexity metrics, their normalisation and composites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions import sqltext, text


def normalise(x: Column, method: str, lo: Column | None = None, hi: Column | None = None, mean: Column | None = None, std: Column | None = None) -> Column:
    """``log_plus_one``, ``zscore`` or ``minmax``; 0 where the scale is flat."""
    if method == "log_plus_one":
        return F.when(hi > 0, F.log1p(x) / F.log1p(hi)).otherwise(F.lit(0.0))
    if method == "zscore":
        return F.when(std > 0, (x - mean) / std).otherwise(F.lit(0.0))
    if method == "minmax":
        return F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0))
    raise ValueError(f"unknown method {method!r}")


def normalise_nl(x: Column, method: str, hi: Column | None = None, mean: Column | None = None, std: Column | None = None, q25: Column | None = None, q75: Column | None = None) -> Column:
    """The variant for questions: 0 stays 0; log capped at 1; logistic of half the z score; clipped robust scale."""
    if method == "log":
        got = F.when(hi > 0, F.least(F.log1p(x) / F.log1p(hi), F.lit(1.0))).otherwise(F.lit(0.0))
    elif method == "zscore":
        got = F.when(std > 0, 1 / (1 + F.exp(-0.5 * (x - mean) / std))).otherwise(F.lit(0.5))
    elif method == "robust":
        got = F.when(q75 > q25, F.least(F.greatest((x - q25) / (q75 - q25), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.when(x == 0, F.lit(0.0)).otherwise(got)


#: Weights of the composites.
SQL_WEIGHTS = (("words", 0.10), ("columns", 0.15), ("subqueries", 0.30), ("operators", 0.25), ("splits", 0.20))
NL_WEIGHTS = (("before_verb", 0.15), ("constituents_per_word", 0.30), ("subordinate", 0.35), ("coordinate", 0.20))


def sql_composite(df: DataFrame, weights: Sequence[tuple[str, float]] = SQL_WEIGHTS, method: str = "minmax") -> DataFrame:
    """One row: means of the metric columns, scaled by their extremes, and the weighted sum of those."""
    stats = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c, _ in weights for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))])
    scaled = [normalise(F.col(f"mean_{c}"), method, F.col(f"min_{c}"), F.col(f"max_{c}"), F.col(f"mean_{c}"), F.col(f"std_{c}")).alias(f"scaled_{c}") for c, _ in weights]
    out = stats.select("*", *scaled)
    total = F.lit(0.0)
    for c, w in weights:
        total = total + w * F.col(f"scaled_{c}")
    return out.select(*[f"mean_{c}" for c, _ in weights], *[f"scaled_{c}" for c, _ in weights], total.alias("composite"))


def nl_composite(weights: Sequence[tuple[str, float]] = NL_WEIGHTS) -> Column:
    """Row-wise weighted sum of the four question metrics."""
    out = F.lit(0.0)
    for c, w in weights:
        out = out + w * F.col(c)
    return out


def readability(df: DataFrame, column: str) -> DataFrame:
    """Add words, sentences, syllables, reading ease and grade of a text column."""
    out = df.withColumns({"words": text.word_count(column), "sentences": text.sentence_count(column), "syllables": text.syllable_count(column)})
    w, s, y = F.col("words"), F.col("sentences"), F.col("syllables")
    return out.withColumns({"reading_ease": text.flesch_reading_ease(w, s, y), "grade": text.flesch_kincaid_grade(w, s, y)})


def scaled_by(df: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Min-max scale columns by the extremes of a reference dataset (one broadcast row), clipped to [0, 1]."""
    ends = reference.agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.least(F.greatest(normalise(F.col(c), "minmax", F.col(f"_lo_{c}"), F.col(f"_hi_{c}")), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return df.crossJoin(F.broadcast(ends)).withColumns(scaled).select(*df.columns)


def by_language(df: DataFrame, columns: Sequence[str], lang: str = "lang") -> DataFrame:
    """Mean of each column by language, scaled by the extremes over all languages."""
    means = df.groupBy(lang).agg(*[F.avg(c).alias(c) for c in columns])
    return scaled_by(means, df, columns)


def compliance(requested: Column, actual: Column) -> Column:
    """exact, close (off by one), way_off, or error where there is no query."""
    gap = F.abs(requested - actual)
    return F.when(gap.isNull(), "error").when(gap == 0, "exact").when(gap == 1, "close").otherwise("way_off")


def text_metrics(df: DataFrame, sql: str) -> DataFrame:
    """The metrics of a query's text that need no tree, as columns."""
    return df.withColumns(
        {
            "words": text.word_count(sql),
            "columns": F.size(sqltext.referenced_names(sql)),
            "subqueries": sqltext.subquery_count(sql),
            "operators": sqltext.operator_total(sql),
            "reserved": sqltext.reserved_count(sql),
            "reserved_distinct": sqltext.reserved_distinct(sql),
        }
    )
