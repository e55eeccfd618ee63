"""Aggregations over metric columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions import sqltext


#: Relative rank error of the sketches that bracket a quantile, and rows of a group that needs no bracket.
RANK_ERROR, SMALL = 1e-4, 1 << 16
#: Values of so many bytes, as the plan estimates them, are put in order without brackets.
SMALL_BYTES = 32 << 20


def _group(by: Sequence[str]) -> Column:
    return F.struct(*[f"`{c}`" for c in by]) if by else F.struct(F.lit(0).alias("_all"))


def quantiles(df: DataFrame, column: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``_group`` (a struct of ``by``) and ``q``, the exact quantiles with linear interpolation as an array of doubles.

    Selection by sampled splitters. A rank sketch of each group, built by partial
    aggregation, gives a bracket around each quantile: the values whose ranks
    are within three rank errors of it, whatever the shape of the distribution. A second pass
    counts equal values within brackets and merely counts the rows between
    brackets, again by partial aggregation, so all but some six ten-thousandths of a
    group's rows for each point are a handful of counts before anything is put in
    order. Ranks are exact: a quantile outside of its bracket, which the sketch's
    guarantee rules out, would raise an error. A column that is small as a whole, by the plan's own
    estimate, goes without brackets; results are the same.

    Nulls and NaN are left out; groups without a value have no row.
    """
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    rows = df.select(_group(by).alias("_group"), x.alias("x")).filter("x is not null")
    hits = _bracketed(rows, points, by) if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES else _counted(rows)
    hits = hits.withColumn("hit", F.explode(F.filter(_ranks(points), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))))
    value = F.when(F.col("between"), F.raise_error(F.lit("a quantile lies outside of its bracket")).cast("double")).otherwise(F.col("x"))
    found = hits.groupBy("_group").agg(F.map_from_entries(F.collect_list(F.struct("hit", value))).alias("at"), F.first("total").alias("total"))

    def at(p: float) -> Column:
        r = p * (F.col("total") - 1)
        low, high = F.col("at")[F.floor(r)], F.col("at")[F.ceil(r)]
        return F.when(low == high, low).otherwise(low + (high - low) * (r - F.floor(r)))

    return found.select("_group", F.array(*map(at, points)).alias("q"))


def _ranks(points: Sequence[float]) -> Column:
    """The ranks, from 0, that the points lie between."""
    last = F.col("total") - 1
    return F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p * last), F.ceil(p * last)) for p in points])))


def _counted(rows: DataFrame) -> DataFrame:
    """Each value of a group with the rows up to it."""
    counted = rows.groupBy("_group", "x").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("_group")
    return counted.select("_group", "x", F.lit(False).alias("between"), "n", F.sum("n").over(group).alias("total"), F.sum("n").over(group.orderBy("x")).alias("upto"))


def _bracketed(rows: DataFrame, points: Sequence[float], by: Sequence[str]) -> DataFrame:
    """The same for values within brackets, and for all rows between two brackets together."""
    low, high = ([min(max(p + side * 3 * RANK_ERROR, 0.0), 1.0) for p in points] for side in (-1, 1))
    sketch = F.percentile_approx("x", [*low, *high], round(1 / RANK_ERROR))
    # groups with brackets have SMALL rows each, so they are few beside the rows, which need not be put together by group
    large = rows.groupBy("_group").agg(F.count("x").alias("_size"), sketch.alias("_ends")).filter(F.col("_size") > SMALL).select("_group", "_ends")
    joined = rows.join(F.broadcast(large), "_group", "left")

    def end(i: int, p: float, outer: float) -> Column:
        return F.lit(outer) if p in (0.0, 1.0) else F.coalesce(F.col("_ends")[i], F.lit(outer))

    brackets = [(end(i, lo, float("-inf")), end(len(points) + i, hi, float("inf"))) for i, (lo, hi) in enumerate(zip(low, high, strict=True))]
    inside = reduce(lambda a, b: a | b, (F.col("x").between(*b) for b in brackets))
    # rows between brackets stand behind the bracket that ends before them
    before = F.greatest(F.lit(float("-inf")), *[F.when(hi < F.col("x"), hi) for _, hi in brackets], F.lit(None).cast("double"))
    counted = joined.select("_group", F.when(inside, F.col("x")).otherwise(before).alias("x"), (~inside).alias("between"))
    counted = counted.groupBy("_group", "x", "between").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("_group")
    return counted.select("_group", "x", "between", "n", F.sum("n").over(group).alias("total"), F.sum("n").over(group.orderBy("x", "between")).alias("upto"))


def _with_quantiles(base: DataFrame, df: DataFrame, column: str, points: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``base``, which has one row for each group, with ``_q``."""
    return base.withColumn("_group", _group(by)).join(quantiles(df, column, points, by).withColumnRenamed("q", "_q"), "_group", "left").drop("_group")


def describe(df: DataFrame, column: str, by: Sequence[str] = (), population: bool = False) -> DataFrame:
    """Mean, extremes, median, deviation and variance; sample or population forms."""
    x = F.col(column)
    std, var = (F.stddev_pop, F.var_pop) if population else (F.stddev_samp, F.var_samp)
    base = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), std(x).alias("std"), var(x).alias("var"))
    return _with_quantiles(base, df, column, [0.5], by).select(*by, "n", "mean", "min", "max", F.get("_q", F.lit(0)).alias("median"), "std", "var")


def percentiles(df: DataFrame, column: str, points: Sequence[float] = (0.25, 0.5, 0.75, 0.95), by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, as p25, p50 ..."""
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return _with_quantiles(groups, df, column, points, by).select(*by, *[F.get("_q", F.lit(i)).alias(f"p{round(100 * p)}") for i, p in enumerate(points)])


def mean_difference(df: DataFrame, column: str, flag: str) -> DataFrame:
    """Means of the flagged and the other rows, their difference and the flagged share."""
    yes, x = F.col(flag), F.col(column)
    return df.agg(F.avg(F.when(yes, x)).alias("mean_flagged"), F.avg(F.when(~yes, x)).alias("mean_other"), F.avg(yes.cast("double")).alias("share")).withColumn("difference", F.col("mean_other") - F.col("mean_flagged"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n, share): all values, or the most frequent, ties to the smaller value.

    The total is a window over the counts, not over the rows.
    """
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    shared = counted.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_total")).alias("share"))
    return shared.orderBy(F.desc("n"), "value").limit(top) if top else shared


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """Counts by fixed-width bins, named by their lower ends."""
    return df.filter(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def equal_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins between the extremes; the last bin is closed; (bin, low, high, n)."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(column) - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(ends)).select("bin", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), "n")


def right_closed(x: Column, edges: Sequence[float]) -> Column:
    """Label ``(a, b]`` of the interval that holds x; null outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:]):
        out = F.when((x > a) & (x <= b), F.lit(f"({a}, {b}]")).otherwise(out)
    return out


def cut_rates(df: DataFrame, column: str, edges: Sequence[float], member: Column) -> DataFrame:
    """Share in percent of rows with ``member`` in each right-closed interval."""
    return df.withColumn("bucket", right_closed(F.col(column), edges)).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(member.cast("double"))).alias("percent"))


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, tn, fp, fn of two 0/1 columns."""

    def n(t: int, p: int) -> Column:
        return F.coalesce(F.sum(((F.col(truth) == t) & (F.col(predicted) == p)).cast("long")), F.lit(0))

    return df.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))


def classification(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, f1 and specificity, 0 where a denominator is."""

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = counts.withColumns({"accuracy": share(tp + tn, tp + tn + fp + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "specificity": share(tn, tn + fp)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", share(2 * p * r, p + r))


def regression(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """mse, mae and rmse over rows with both values."""
    e = F.col(truth) - F.col(predicted)
    return df.filter(e.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def distinct_count_in(*columns: str) -> Column:
    """Distinct non-blank values over scalar and array columns of a row."""
    parts = [F.array(F.col(c)) for c in columns]
    return distinct_values(F.concat(*parts))


def distinct_values(values: Column) -> Column:
    return F.size(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))))


def reserved_probabilities(df: DataFrame, sql: str, smoothing: float = 1.0) -> DataFrame:
    """(word, n, p) for every keyword: counts over the corpus with ``smoothing`` added.

    Words are exploded only after keywords are picked out of each query.
    """
    spark = df.sparkSession
    words = df.select(F.explode(sqltext.reserved_words(sql)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    all_words = spark.createDataFrame([(w,) for w in sqltext.RESERVED], "word string")
    counted = all_words.join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.withColumn("p", (F.col("n") + smoothing) / F.sum(F.col("n") + smoothing).over(Window.partitionBy()))


def length_distribution(df: DataFrame, sql: str, smoothing: float = 1.0) -> DataFrame:
    """(length, n, p): keywords per query from 0 to the largest number, gaps filled."""
    counted = df.groupBy(sqltext.reserved_count(sql).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    every = counted.agg(F.coalesce(F.max("length"), F.lit(0)).alias("m")).select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("length"))
    filled = every.join(counted, "length", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("p", (F.col("n") + smoothing) / F.sum(F.col("n") + smoothing).over(Window.partitionBy()))


def rates(df: DataFrame, status: str, names: Sequence[str]) -> DataFrame:
    """Counts and shares of a few statuses over all rows."""
    cols = [F.sum((F.col(status) == n).cast("long")).alias(f"n_{n}") for n in names]
    out = df.agg(F.count(F.lit(1)).alias("total"), *cols)
    return out.withColumns({f"{n}_rate": F.when(F.col("total") > 0, F.col(f"n_{n}") / F.col("total")) for n in names})


def cell_metrics(df: DataFrame, truth: str, predicted: str, metrics: Sequence[str]) -> DataFrame:
    """Mean metrics of the kept, discarded, false-negative and true-positive rows, from one aggregation by cell."""
    cell = F.when(F.col(predicted) == 1, F.when(F.col(truth) == 1, "tp").otherwise("fp")).otherwise(F.when(F.col(truth) == 1, "fn").otherwise("tn"))
    by = df.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"sum_{m}") for m in metrics])
    subset = F.explode(F.split(F.when(F.col("cell") == "tp", "kept,true_positive").when(F.col("cell") == "fp", "kept").when(F.col("cell") == "fn", "discarded,false_negative").otherwise("discarded"), ","))
    return by.select("*", subset.alias("subset")).groupBy("subset").agg(F.sum("n").alias("n"), *[(F.sum(f"sum_{m}") / F.sum("n")).alias(f"mean_{m}") for m in metrics])


def flatten(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Fields of a struct column as columns ``prefix_field``, nested ones too."""

    def fields(name: str, path: str, kind) -> list[Column]:
        out = []
        for f in kind.fields:
            at, label = f"{path}.`{f.name}`", f"{name}_{f.name}"
            out += fields(label, at, f.dataType) if hasattr(f.dataType, "fields") else [F.col(at).alias(label)]
        return out

    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *fields(prefix, f"`{column}`", df.schema[column].dataType))


def threshold_sweep(df: DataFrame, truth: str, configs: Sequence[tuple[str, str, float, bool]]) -> DataFrame:
    """Confusion and classification for (method, score column, threshold, strict) configs.

    Every row is exploded over the configs and aggregated by partial sums, so a
    sweep reads the data once.
    """
    tests = [
        F.struct(F.lit(m).alias("method"), F.lit(float(t)).alias("threshold"), (F.coalesce(F.col(c), F.lit(0.0)) > t if strict else F.coalesce(F.col(c), F.lit(0.0)) >= t).cast("int").alias("predicted"))
        for m, c, t, strict in configs
    ]
    tried = df.select(F.col(truth).alias("truth"), F.explode(F.array(*tests)).alias("x")).select("truth", "x.*")
    return classification(confusion(tried, "truth", "predicted", ["method", "threshold"])).withColumn("quality", F.col("accuracy") * F.col("specificity") * F.col("f1"))
