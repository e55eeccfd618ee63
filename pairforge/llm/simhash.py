"""SimHash near-duplicates by multi-index hashing.

Fingerprints are taken once for each document; what follows works on distinct
fingerprints, so that a group of copies is a single row. A 64-bit fingerprint
has two 32-bit segments, each with a table from the segment's value to the
fingerprints that have it. Two fingerprints that differ in two bits or fewer
differ in one or none in the first segment, or else in none in the second. So
each fingerprint enumerates the ball of radius one in its first segment and the
ball of radius zero in its second, fetches the table's entries for these values,
and verifies complete distances.

A segment value that more than ``BUCKET`` fingerprints have is hot: fetching it
would pair all of them. There the ball is enumerated in the other segment as
well: entries and probes of a hot value meet at whole 64-bit points that both
are within one bit of. A point is met by 65 fingerprints at most, all within two
bits of one another, and the others are linked to its smallest; links that this
leaves out lie between fingerprints linked through that one.

Components are found by alternating large-star and small-star steps over the
links, written after each round; only their count comes to the driver. A centre
that many links share, and a fingerprint that many rows share, are the skewed side
of a join by sort with one row for each key on the other side, which adaptive
execution splits.

Defined cases: a text without words (null, empty, white space) has fingerprint
zero and is linked as any other; fewer words than a shingle are one shingle;
very long texts are taken whole; repeated rows share fingerprint and component;
rows with a null id are fingerprinted and never name a component (a component
of such rows alone has a null id); an empty table gives an empty result; other
columns are ignored by :func:`near_duplicates` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.storage import lookup, working, written

#: Words in a shingle; bits by which linked fingerprints differ at most; seed of the shingle hash.
SHINGLE, DISTANCE, SEED = 3, 2, 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes split at ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = ends - [len(w) + 1 for w in words]
    spans = zip(begins[: len(words) - width + 1].tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)
    return np.array([hashed(line[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The bits that are set in over half of the shingle hashes, unsigned."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin : begin + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("simhash")
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col(text)).mapInArrow(mapped, f"doc_id {kind}, fp long")


#: Fingerprints of one segment value up to which its probes fetch all of them.
BUCKET = 32
_LOW = 0xFFFFFFFF


def _ball(x: Column, first_bit: int, bits: int) -> Column:
    """The values that differ from ``x`` in at most one of ``bits`` bits."""
    flips = [F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(first_bit, first_bit + bits)]]
    return F.transform(F.array(*flips), lambda m: x.bitwiseXOR(m))


def _segments(distinct: DataFrame) -> DataFrame:
    """The segment tables, as (segment, key, fp)."""
    parts = F.array(F.struct(F.lit(1).alias("segment"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(2).alias("segment"), F.col("fp").bitwiseAND(F.lit(_LOW)).alias("key")))
    return distinct.select("fp", F.explode(parts).alias("p")).select("p.segment", "p.key", "fp")


def _probes(distinct: DataFrame) -> DataFrame:
    """The segment values that each fingerprint looks up, as (segment, key, fp)."""
    own = F.col("fp").bitwiseAND(F.lit(_LOW))
    ball = F.transform(_ball(F.shiftrightunsigned("fp", 32), 0, 32), lambda k: F.struct(F.lit(1).alias("segment"), k.alias("key")))
    return distinct.select("fp", F.explode(F.concat(ball, F.array(F.struct(F.lit(2).alias("segment"), own.alias("key"))))).alias("p")).select("p.segment", "p.key", "fp")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a < b: links among distinct fingerprints ``fp`` that keep every component whole."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(n, F.xxhash64("fp"))  # a row becomes 34, so few rows still need many tasks
    table, probes, at = _segments(spread), _probes(spread), ["segment", "key"]
    hot = lookup(table.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).select(*at), "hot_segments")

    entries = table.join(hot, at, "left_anti").withColumnRenamed("fp", "b")
    fetched = probes.withColumnRenamed("fp", "a").join(entries, at).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cold = fetched.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)

    # the points of hot values: in the other segment, entries have the ball of radius one and visitors of the
    # first segment's ball stand at themselves, having spent their bit
    own = F.when(F.col("segment") == 1, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(_LOW))) == F.col("key")
    moved = F.col("fp").bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft("key", 32))
    points = F.when(~own, F.array(moved)).when(F.col("segment") == 1, _ball(F.col("fp"), 0, 32)).otherwise(_ball(F.col("fp"), 32, 32))
    met = probes.join(hot, at, "left_semi").select("segment", "fp", F.explode(points).alias("point"))
    groups = met.groupBy("segment", "point").agg(F.array_sort(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    dense = groups.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 64)).alias("b"))
    return cold.union(dense.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of an edge.

    One round links each node's larger neighbours, then its smaller ones, to the
    smallest of its neighbourhood. Rounds grow with the logarithm of the longest
    path; a round's edges are written, so a lost executor repeats that round only.
    """
    pairs = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    before = None
    while True:
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        pairs = written(small, "links")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        before = now


def near_duplicates(df: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id that links reach."""
    prints = written(fingerprints(df, text, width), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    named = distinct.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """The rows of one document of each component, the one with the smallest id, with all columns.

    Rows with a null id name no document and are all kept.
    """
    found = near_duplicates(df, text, width)
    first = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = df.join(first, "doc_id", "left_semi")
    return kept.unionByName(df.filter(F.col("doc_id").isNull()))
