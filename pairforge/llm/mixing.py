"""Mixing sources to target weights by Sainte-Laguë apportionment.

All of it is DataFrame expressions. Each source's documents are dealt by a
seeded hash into shards of a bounded number of words, so that a source with a
third of all rows is many shards. The words of the mix are equal blocks of
``block`` words; Sainte-Laguë (highest quotients ``target / (2 seats + 1)``)
gives every source, and then every shard of a source, an integer quota of
blocks. In a shard the documents stand in seeded order on one line of words that
is cut into blocks; a quota above the shard's blocks takes each block several
times over, and the rest is a seeded choice of blocks, spaced evenly. Which
blocks are taken is a formula of their number, so a document's share follows
from its two ends without making a row for each block.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own, the last; rows that are repeated or tie in the
seeded order are taken independently, ties going by text; an empty table gives an
empty result; other columns are ignored by :func:`plan_mix` and kept by
:func:`mix`, whose results have the input's columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.storage import lookup, written

#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block; words in a shard, at about.
BLOCK, SHARD = 16, 1 << 18
#: No source is taken more than so many times over.
MOST = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``target`` from (source, source_size) rows.

    Sources in order of code points, null last, weigh 1, 2, 3 and so on again.
    A target stops at three times its source; what is over goes to the others
    by weight. In order of ``cap / weight`` the capped sources come first, so
    running sums find the level ``words per weight`` at which all is shared.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sizes.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
        .withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("is_capped", F.col("ratio") <= F.col("level"))
        # the level of the first source that stays below its cap holds for all such
        .withColumn("share", F.min(F.when(~F.col("is_capped"), F.struct("ratio", "level"))).over(whole)["level"])
    )
    return ranked.select("source", "source_size", F.when(F.col("is_capped"), F.col("cap")).otherwise(F.col("share") * F.col("weight")).alias("target"))


def sainte_lague(cells: DataFrame, group: list[str], votes: str, seats: str, tie: list[str]) -> DataFrame:
    """Add ``quota``: of ``seats`` (one number for each group) those of each cell.

    With S cells, V votes and N seats, all quotients of at least V / (2N - S)
    win and none below V / (2N + S) does. Counts at these two bounds are
    formulas; only the seats between them, 2 S at most, are ranked.
    """
    per = Window.partitionBy(*group)
    half = F.col("_v") / 2
    bounded = (
        cells.withColumn("_v", F.greatest(F.col(votes).cast("double"), F.lit(0.0)))
        .withColumn("_sum", F.sum("_v").over(per))
        .withColumn("_cells", F.count(F.lit(1)).over(per))
        .withColumn("_sure", F.when((F.col(seats) * 2 > F.col("_cells")) & (F.col("_sum") > 0), F.floor(half * (2 * F.col(seats) - F.col("_cells")) / F.col("_sum") + 0.5)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_most", F.when(F.col("_sum") > 0, F.floor(half * (2 * F.col(seats) + F.col("_cells")) / F.col("_sum") + 0.5)).otherwise(F.lit(0)).cast("long") + 1)
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(per))
    )
    keys = [*dict.fromkeys([*group, *tie])]
    ranked = Window.partitionBy(*group).orderBy(F.desc("_quotient"), *tie)
    extra = (
        bounded.filter(F.col("_v") > 0)
        .select(*keys, "_v", "_open", F.explode(F.expr("sequence(_sure, _most)")).alias("_seat"))
        .withColumn("_quotient", F.col("_v") / (2 * F.col("_seat") + 1))
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= F.col("_open"))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_extra"))
    )
    left, right = bounded.alias("l"), extra.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = left.join(right, same, "left")
    return joined.select(*[F.col(f"l.{c}") for c in cells.columns], (F.col("l._sure") + F.coalesce(F.col("r._extra"), F.lit(0))).alias("quota"))


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))


def _number(digest: Column, begin: int) -> Column:
    """A number below 2^28 from seven hexadecimal digits."""
    return F.conv(F.substring(digest, begin, 7), 16, 10).cast("long")


def plan_mix(df: DataFrame, seed: int = 42, block: int = BLOCK, shard: int = SHARD, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source_size, target, taken, times`` of each document.

    ``taken`` is the words of the mix that come from the document, repeats
    counted; ``times`` is how often the block with its first word is taken,
    which is what a mix of whole documents uses.
    """
    kept = [F.col(c).alias(f"_carry_{c}") for c in carry]
    docs = df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text"), *kept)
    # texts are read once for all sums, and once more only where they are carried along
    narrow = written(docs.drop(*[f"_carry_{c}" for c in carry]), "mix_sizes")
    docs = docs if carry else narrow
    sized = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sized)
    all_blocks = F.round(F.sum("source_size").over(Window.partitionBy()) / block).cast("long")
    quotas = sainte_lague(targets.withColumn("_one", F.lit(0)).withColumn("_seats", all_blocks), ["_one"], "target", "_seats", ["source"])
    quotas = quotas.select("source", "source_size", "target", F.col("quota").alias("source_quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long").alias("shards"))

    quotas = lookup(quotas, "mix_quotas")

    def in_shards(rows: DataFrame) -> DataFrame:
        return _same_source(rows, quotas).withColumn("_key", _hash(F.lit(seed), F.col("doc_id"))).withColumn("_shard", F.pmod(_number(F.col("_key"), 1), F.col("shards")))

    placed = in_shards(docs)
    cells = in_shards(narrow).groupBy("source", "_shard").agg(F.sum("size").alias("cell_size"), F.first("source_quota").alias("source_quota"))
    cells = sainte_lague(cells, ["source"], "cell_size", "source_quota", ["_shard"])
    cells = cells.select(F.col("source").alias("_s"), F.col("_shard").alias("_h"), F.greatest(F.lit(1), F.ceil(F.col("cell_size") / block)).cast("long").alias("blocks"), "quota")
    lined = placed.join(lookup(cells, "mix_cells"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))

    line = Window.partitionBy("source", "_shard").orderBy("_key", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, 0)
    quota = F.least(F.col("quota"), MOST * F.col("blocks"))
    cut = (
        lined.withColumn("_end", F.sum("size").over(line))
        .withColumn("_begin", F.col("_end") - F.col("size"))
        .withColumn("_whole", F.floor(quota / F.col("blocks")).cast("long"))
        .withColumn("_rest", quota - F.col("_whole") * F.col("blocks"))
        .withColumn("_phase", F.pmod(_number(_hash(F.lit(seed), F.col("source"), F.col("_shard")), 8), F.col("blocks")))
    )

    def chosen_before(k: Column) -> Column:
        """Of the blocks below ``k`` those in the seeded choice of ``_rest`` blocks."""
        upto = F.floor((k + F.col("_phase") - 1) * F.col("_rest") / F.col("blocks").cast("decimal(20,0)"))
        first = F.floor((F.col("_phase") - 1) * F.col("_rest") / F.col("blocks").cast("decimal(20,0)"))
        return (upto - first).cast("long")

    def words_before(x: Column) -> Column:
        k = F.floor(x / block).cast("long")
        one = chosen_before(k + 1) - chosen_before(k)
        return F.col("_whole") * x + chosen_before(k) * block + one * (x - k * block)

    first = F.floor(F.col("_begin") / block).cast("long")
    return cut.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (words_before(F.col("_end")) - words_before(F.col("_begin"))).alias("taken"),
        F.when(F.col("size") > 0, F.col("_whole") + chosen_before(first + 1) - chosen_before(first)).otherwise(0).cast("int").alias("times"),
        *[f"_carry_{c}" for c in carry],
    )


def _same_source(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    named = by_source.withColumnRenamed("source", "_source")
    return docs.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(df: DataFrame, seed: int = 42, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mixed documents, whole: each appears as often as the block of its first word is taken.

    A document without words belongs to no block and is kept once, as it costs nothing.
    """
    planned = plan_mix(df, seed, block, shard, carry=tuple(df.columns))
    taken = planned.filter((F.col("size") == 0) | (F.col("times") > 0))
    copies = taken.withColumn("_copy", F.explode(F.expr("sequence(1, if(size = 0, 1, times))")))
    return copies.select(*[F.col(f"_carry_{c}").alias(c) for c in df.columns])
