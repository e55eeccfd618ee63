"""Seeded choices: a pure function of (seed, purpose, key), whatever the partitioning.

The uniform number comes from the first 13 hexadecimal digits of an MD5 digest,
so any SQL engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPAN = float(16**13)


def digest(seed: int, purpose: str, *key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in key]))


def uniform(seed: int, purpose: str, *key: Column) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(digest(seed, purpose, *key), 1, 13), 16, 10).cast("double") / _SPAN


def choice(options: Column, seed: int, purpose: str, *key: Column) -> Column:
    """One element of an array column; null for an empty array."""
    at = F.floor(uniform(seed, purpose, *key) * F.size(options)).cast("int")
    return F.get(options, at)


def weighted(options: Sequence[str], weights: Sequence[float], seed: int, purpose: str, *key: Column) -> Column:
    """One of a fixed list of options, by weight: the uniform number against cumulated weights."""
    total, so_far = float(sum(weights)), 0.0
    u, out = uniform(seed, purpose, *key), F.lit(None).cast("string")
    bounds = []
    for option, weight in zip(options, weights, strict=True):
        so_far += weight / total
        bounds.append((option, so_far))
    for i, (option, bound) in enumerate(reversed(bounds)):
        out = F.lit(option) if i == 0 else F.when(u < bound, F.lit(option)).otherwise(out)
    return out


def split_label(parts: Sequence[tuple[str, float]], seed: int, *key: Column) -> Column:
    """Name of a row's part in a random split; sizes are approximate."""
    return weighted([p for p, _ in parts], [w for _, w in parts], seed, "split", *key)


#: Hexadecimal digits of a digest that tell its bucket: 65,536 of them.
BUCKET_DIGITS = 4


def exact_split(df: DataFrame, parts: Sequence[tuple[str, float]], seed: int, *key: str) -> DataFrame:
    """Add ``split`` with sizes that are exact up to rounding.

    Rows stand in the order of their digest, but are never put in that order: the
    counts of the digests' buckets, of which there is a fixed number, tell in which
    bucket each cut falls, all other buckets are on one side of it, and only the
    rows of the cuts' own buckets are ordered. ``key`` should identify rows; rows of
    one key share a bucket.
    """
    bucket = F.conv(F.substring(digest(seed, "split", *[F.col(k) for k in key]), 1, BUCKET_DIGITS), 16, 10).cast("int")
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("_high", F.expr("_bucket >> 8"))
    # rows before a bucket: those of the 256 buckets around it by a window, those of the other 256 stretches from one short array
    here = counts.withColumn("_upto", F.sum("n").over(Window.partitionBy("_high").orderBy("_bucket")))
    stretches = counts.groupBy("_high").agg(F.sum("n").alias("m")).agg(F.collect_list(F.struct("_high", "m")).alias("_all"))
    lower = F.aggregate(F.filter("_all", lambda x: x["_high"] < F.col("_high")), F.lit(0).cast("bigint"), lambda a, x: a + x["m"])
    everything = F.aggregate("_all", F.lit(0).cast("bigint"), lambda a, x: a + x["m"])
    plan = here.crossJoin(F.broadcast(stretches)).select("_bucket", "n", everything.alias("_total"), (lower + F.col("_upto") - F.col("n")).alias("_first"))
    shares, so_far = [], 0.0
    for name, share in parts[:-1]:
        so_far += share
        shares.append((name, so_far))

    cut_up = F.lit(False)  # whether a cut falls between two rows of a bucket
    for _, cut in shares:
        cut_up = cut_up | ((F.col("_first") / F.col("_total") < cut) & ((F.col("_first") + F.col("n") - 1) / F.col("_total") >= cut))
    plan = F.broadcast(plan.select("_bucket", "_total", "_first", cut_up.alias("_cut")))
    placed = rows.join(plan, "_bucket")

    def labelled(rows: DataFrame, at: Column) -> DataFrame:
        out = F.lit(parts[-1][0])
        for name, cut in reversed(shares):
            out = F.when(at / F.col("_total") < cut, F.lit(name)).otherwise(out)
        return rows.select(*[f"`{c}`" for c in df.columns], out.alias("split"))

    order = Window.partitionBy("_bucket").orderBy(digest(seed, "split", *[F.col(k) for k in key]), *key)
    ranked = placed.filter("_cut").withColumn("_rank", F.row_number().over(order) - 1)
    return labelled(placed.filter("not _cut"), F.col("_first")).union(labelled(ranked, F.col("_first") + F.col("_rank")))


def cyclic(row_id: Column, first: int, last: int) -> Column:
    """first .. last in turn by row number."""
    return F.lit(first) + F.pmod(row_id, F.lit(last - first + 1))
