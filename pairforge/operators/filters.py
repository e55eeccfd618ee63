"""Score filters, routes and ambiguity labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions import answers
from pairforge.functions.similarity import best_window_ratio, matching_ratio
from pairforge.functions.udf import vectorised

#: Thresholds of the routes and filters.
AMBIGUOUS, REWARD, PROMPT = 0.25, 0.5, 0.8


def route(predicted: str, threshold: float = AMBIGUOUS) -> Column:
    """prompt for ambiguous rows, reward for the others; no prediction means reward."""
    return F.when(F.col(predicted) >= threshold, "prompt").otherwise("reward")


def reward_keep(score: str, threshold: float = REWARD) -> Column:
    return F.coalesce(F.col(score) >= threshold, F.lit(False))


def prompt_keep(response: str, threshold: float = PROMPT) -> Column:
    """Keep by the score in a judge's answer; an answer without one scores 0."""
    return F.coalesce(answers.score_of(response), F.lit(0.0)) >= threshold


def filtered(df: DataFrame, option: str = "option", reward: str = "reward", response: str = "response") -> DataFrame:
    """Add ``filtered`` (prompt, reward or none) and ``keep`` by each row's route."""
    by = F.col(option)
    keep = F.when(by == "prompt", prompt_keep(response)).when(by == "reward", reward_keep(reward)).otherwise(F.lit(True))
    return df.withColumns({"filtered": F.when(by.isin("prompt", "reward"), by).otherwise("none"), "keep": keep})


def label(score: str, threshold: float, strict: bool) -> Column:
    """1 above (strict) or from the threshold on; no score counts as 0."""
    x = F.coalesce(F.col(score), F.lit(0.0))
    return (x > threshold if strict else x >= threshold).cast("int")


def generate_and_compare(candidates: str, truth: str, threshold: float = 0.9) -> Column:
    """Whether any generated candidate resembles the query, its best window taken, without regard to case.

    Rows without candidates are not kept. Candidates are compared row by row in
    one pandas UDF, so nothing is exploded.
    """

    @vectorised("boolean")
    def hit(cs: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([y is not None and c is not None and any(x is not None and best_window_ratio(x.lower(), y.lower()) >= threshold for x in c) for c, y in zip(cs, t, strict=True)])

    return hit(F.col(candidates), F.col(truth))


def judged(options: str, index: str, picked: str, threshold: float = 0.8) -> Column:
    """The option a judge picked, if its number is in range and the judged text resembles it; else null."""

    @vectorised("string")
    def pick(os: pd.Series, i: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for o, k, text in zip(os, i, p, strict=True):
            good = o is not None and not pd.isna(k) and 0 <= int(k) < len(o) and text is not None and o[int(k)] is not None
            out.append(o[int(k)] if good and matching_ratio(o[int(k)].lower(), text.lower()) >= threshold else None)
        return pd.Series(out, dtype="object")

    return pick(F.col(options), F.col(index), F.col(picked))


def judge_gate(score: str, threshold: float = 90) -> Column:
    return F.coalesce(F.col(score) >= threshold, F.lit(False))


def distinct_queries(gold: str, others: str | None = None) -> Column:
    """Distinct non-blank queries of one or two array columns."""
    both = F.coalesce(F.col(gold), F.array().cast("array<string>"))
    if others:
        both = F.concat(both, F.coalesce(F.col(others), F.array().cast("array<string>")))
    return F.size(F.array_distinct(F.filter(F.transform(both, lambda q: F.trim(q)), lambda q: q != "")))


def gold_count(gold: str) -> Column:
    return F.size(F.filter(F.coalesce(F.col(gold), F.array().cast("array<string>")), lambda q: q.isNotNull() & (F.trim(q) != "")))


def ambiguity_labels(df: DataFrame, n: str, ambiguous: str) -> DataFrame:
    """Add ``label``: 0 if not ambiguous, else 5 to 10 by the number of queries among the ambiguous rows.

    The extremes are one broadcast row of an aggregation, not a window over all rows.
    """
    ends = df.filter(F.col(ambiguous)).agg(F.min(n).alias("_lo"), F.max(n).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = F.when(hi <= 1, F.lit(10.0)).otherwise(5 + 5 * (F.col(n) - lo) / F.greatest(hi - lo, F.lit(1)))
    got = F.when(F.coalesce(F.col(ambiguous), F.lit(False)), F.least(F.greatest(scaled, F.lit(0.0)), F.lit(10.0))).otherwise(F.lit(0.0))
    return df.crossJoin(F.broadcast(ends)).withColumn("label", got).drop("_lo", "_hi")


def clamped(x: Column, lo: float = 0.0, hi: float = 10.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def scored(df: DataFrame, column: str, scorer, name: str = "score") -> DataFrame:
    """Add a model's scores; ``scorer`` is a function of a list of texts that each worker loads once.

    ``scorer()`` returns the batch function, as with ``predict_batch_udf``.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    return df.withColumn(name, predict_batch_udf(scorer, return_type=DoubleType(), batch_size=256)(F.col(column)))


def first_kept(df: DataFrame, key: str, attempt: str, keep: Column, most: int = 3) -> DataFrame:
    """The first attempt that passes, of those up to ``most``; rows without one are dropped."""
    w = Window.partitionBy(key).orderBy(attempt)
    return df.filter((F.col(attempt) <= most) & keep).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
