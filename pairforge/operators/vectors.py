"""Word vectors of a corpus, and whether a text mentions an entity by them.

Words that stand near each other are counted, turned into positive pointwise mutual
information, and factored by a randomised SVD. No matrix is ever in one place.

Known words get numbers, the frequent ones small. Texts are dealt into chunks, and a chunk
meets the numbers of its own words only, so that texts travel once and not word by word.
Pairs are counted within a task before they travel, each under its two numbers, one way
round; they stay in square blocks (number of one word, number of the other, both modulo
the grid's side) of bounded size. A product of the symmetric matrix and a thin one brings a
block the rows of its words and adds up what the blocks return. The only matrices that
reach the driver are ``width`` by ``width`` Gram matrices, summed by partition. Signs of
the random start come from a hash of the word, so vectors do not depend on partitions.

Words are lower-case runs of letters and digits. Words below ``least`` occurrences have no
vector; null texts have no words; a corpus without pairs has no vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.session import bucketed, removed, shuffles_dropped, written

#: Words of a text, as Java's and RE2's expressions read it.
WORD = r"[\p{L}\p{N}]+"
WINDOW, WIDTH, EXTRA, POWERS, LEAST = 4, 32, 8, 2, 2
#: Characters of the texts that meet their words together; words whose pairs are counted together; pairs of a block, before equal ones are added up; parts
#: of a block that are added up by themselves, to a side; columns of a thin matrix that travel together.
CHUNK, PIECE, BLOCK, PARTS, TOGETHER = 24_000_000, 1 << 20, 24_000_000, 2, 24


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(WORD), F.lit(0))


def _in_chunks(df: DataFrame, *texts: str) -> DataFrame:
    """The rows with ``_chunk``, the words of each text joined by blanks in ``_0``, ``_1`` ..., and their other columns."""
    size = df.agg(F.sum(sum((F.coalesce(F.length(f"`{t}`"), F.lit(0)) for t in texts), F.lit(0)))).first()[0] or 0
    hashed = F.xxhash64(*[f"`{c}`" for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])
    joined = [F.array_join(words_of(t), " ").alias(f"_{i}") for i, t in enumerate(texts)]
    return df.select(F.pmod(hashed, F.lit(size // CHUNK + 1)).cast("int").alias("_chunk"), *[f"`{c}`" for c in df.columns if c not in texts], *joined)


def _with_words(rows: DataFrame, words: DataFrame, texts: int, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``f`` makes of each chunk's rows and those of its own words."""
    # dealt by chunk first: a word counts once in a chunk before it travels
    dealt = rows.select("_chunk", F.concat_ws(" ", *[f"_{i}" for i in range(texts)]).alias("w")).repartition("_chunk")
    own = written(dealt.select("_chunk", F.explode(F.array_distinct(F.split("w", " "))).alias("word")).distinct(), "chunk_words")
    return rows.groupBy("_chunk").cogroup(own.join(words, "word").groupBy("_chunk")).applyInArrow(f, schema)


def _found(joined: pa.ChunkedArray, words: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of each row its place among the words, -1 for none, and where rows begin and end."""
    if not len(joined):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    listed = pc.split_pattern(joined.cast(pa.large_string()), " ").combine_chunks()
    listed = listed.combine_chunks() if isinstance(listed, pa.ChunkedArray) else listed
    at = pc.fill_null(pc.index_in(listed.flatten(), value_set=words.cast(pa.large_string())), -1)
    return at.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy(zero_copy_only=False))]).astype(np.int64)


def vocabulary(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``word, id, c``: the words of at least so many occurrences, numbered from the most frequent, written."""
    counted = df.select(F.explode(words_of(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    ordered = written(counted.orderBy(F.desc("c"), "word").select("word", "c", F.monotonically_increasing_id().alias("at")), "vocabulary")
    part, first, before = F.shiftright("at", 33), 0, []
    for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        before += [F.lit(r.part), F.lit(first)]
        first += r.n
    number = F.create_map(*before)[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) if before else F.col("at")
    out = ordered.select("word", number.cast("int").alias("id"), "c")
    out._written_at = ordered._written_at
    return out


def _numbers(df: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """``ids``: the numbers of each text's words in their order, -1 for words without one."""

    def numbered(rows: pa.Table, words: pa.Table) -> pa.Table:
        at, ends = _found(rows["_0"], words["word"])
        numbers = np.append(words["id"].to_numpy(), -1).astype(np.int32)[at]
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(numbers))})

    return _with_words(_in_chunks(df, text).select("_chunk", "_0"), known.select("word", "id"), 1, numbered, "ids array<int>")


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _block(i, j):
    """The number of the block of two rests, whichever comes first."""
    high, low = np.maximum(i, j), np.minimum(i, j)
    return high * (high + 1) // 2 + low


_PAIRS = "block int, a array<int>, b array<int>, n array<bigint>"


def _lists(block: Sequence[int], ends: Sequence[int], a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.asarray(ends, np.int32))
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(block, np.int32)), *[pa.ListArray.from_arrays(at, pa.array(x)) for x in (a.astype(np.int32), b.astype(np.int32), n.astype(np.int64))]], names=["block", "a", "b", "n"])


def _counted(numbers: DataFrame, window: int, side: int) -> DataFrame:
    """``block, a, b, n``: lists of pairs, ``a >= b``, and how often they stand within the window, each pair in one place.

    They are added up in a grid ``PARTS`` times as fine as the blocks.
    """
    fine = side * PARTS

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Numbers of many texts, with a window's width of none behind each."""
        held, size = [], 0
        for batch in batches:
            for ids in batch.column(0):
                held += [ids.values.to_numpy(), np.full(window, -1, np.int32)]
                size += len(held[-2]) + window
                if size >= PIECE:
                    yield np.concatenate(held)
                    held, size = [], 0
        if held:
            yield np.concatenate(held)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in pieces(batches):
            for begin in range(0, len(ids), PIECE):
                keys = []
                for d in range(1, window + 1):
                    b = ids[begin + d : begin + PIECE + d]
                    a = ids[begin : begin + len(b)]
                    both = (a >= 0) & (b >= 0)
                    a, b = a[both].astype(np.int64), b[both].astype(np.int64)
                    keys.append(np.maximum(a, b) << 32 | np.minimum(a, b))
                found, n = np.unique(np.concatenate(keys), return_counts=True)
                a, b = found >> 32, found & 0xFFFFFFFF
                block = _block(a % fine, b % fine)
                order = np.argsort(block, kind="stable")
                which, first = np.unique(block[order], return_index=True)
                if len(which):
                    yield _lists(which, [*first, len(block)], a[order], b[order], n[order])

    def merged(table: pa.Table) -> pa.Table:
        a, b, n = (np.concatenate([c.flatten().to_numpy() for c in table[name].chunks]) for name in "abn")
        keys, n = _added(a.astype(np.int64) << 32 | b, n)
        ends = [*range(0, len(keys), PIECE // 4), len(keys)]
        a, b = keys >> 32, keys & 0xFFFFFFFF
        return pa.Table.from_batches([_lists([_block(a[0] % side, b[0] % side)] * (len(ends) - 1), ends, a, b, n)])

    return numbers.mapInArrow(paired, _PAIRS).groupBy("block").applyInArrow(merged, _PAIRS)


def _pair_counts(df: DataFrame, text: str, window: int, least: int) -> tuple[DataFrame, DataFrame, int]:
    """The vocabulary, the pairs of its numbers in blocks, and the side of the grid."""
    known = vocabulary(df, text, least)
    words = known.agg(F.sum("c")).first()[0] or 0
    side = math.ceil(math.sqrt(2 * window * words / BLOCK)) or 1
    numbers = written(_numbers(df, known, text), "numbers")
    # each product groups the pairs by block: they are dealt out once, and stay there
    counted = bucketed(_counted(numbers, window, side), "cooccurrences", "block", min(side * (side + 1), 1000))
    removed(numbers)
    return known, counted, side


def cooccurrences(df: DataFrame, text: str = "text", window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``a, b, n``: how often two words stand within ``window`` words of each other, counted both ways."""
    known, counted, _ = _pair_counts(df, text, window, least)
    pairs = counted.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
    both = pairs.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))).otherwise(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))).alias("p")).select("p.*")
    names = [known.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}")) for c in "ab"]
    return both.join(names[0], "a").join(names[1], "b").select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n")


def ppmi(counts: DataFrame) -> DataFrame:
    """``a, b, v`` with positive pointwise mutual information; the counts are symmetric."""
    sums = counts.groupBy("a").agg(F.sum("n").alias("m"))
    total = sums.agg(F.sum("m").alias("total"))
    out = counts.join(sums.withColumnRenamed("m", "ma"), "a").join(sums.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").crossJoin(F.broadcast(total))
    return out.select("a", "b", F.log(F.col("n").cast("double") * F.col("total") / (F.col("ma").cast("double") * F.col("mb"))).alias("v")).filter("v > 0")


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def _product(matrix: DataFrame, thin: DataFrame, n: int) -> DataFrame:
    """Rows (word, x) of the symmetric matrix times a thin one."""
    summed = matrix.join(thin.withColumnRenamed("word", "b"), "b").groupBy(F.col("a").alias("word")).agg(*[F.sum(F.col("v") * F.col("x")[k]).alias(f"x{k}") for k in range(n)])
    return summed.select("word", F.array(*[f"x{k}" for k in range(n)]).alias("x"))


def _gram(thin: DataFrame, n: int) -> np.ndarray:
    """The small matrix of all products of columns: partitions send their sums, Spark adds them up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            rows = _rows(batch.column(0)) if batch.num_rows else np.zeros((0, n))
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], names=["i", "v"])

    out = np.zeros(n * n)
    for r in thin.select("x").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return (out.reshape(n, n) + out.reshape(n, n).T) / 2


def _times(thin: DataFrame, small: np.ndarray) -> DataFrame:
    """Each row times a small matrix."""
    others = [f for f in thin.schema.fields if f.name != "x"]
    at = [thin.columns.index(f.name) for f in others]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _rows(batch.column("x")) @ small
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * small.shape[1])
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in at], pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=[*[f.name for f in others], "x"])

    return thin.mapInArrow(mapped, ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in others], "x array<double>"]))


def _orthonormal(thin: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Columns that span the same; directions without weight go."""
    values, directions = np.linalg.eigh(_gram(thin, n))
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-12
    if not keep.any():
        return thin.filter("false"), 0
    return _times(thin, directions[:, keep] / np.sqrt(values[keep])), int(keep.sum())


def _signs(n: int) -> Column:
    return F.array(*[(1 - 2 * F.pmod(F.xxhash64("word", F.lit(k)), F.lit(2))).cast("double") for k in range(n)])


def _strongest(thin: DataFrame, times_matrix: Callable[[DataFrame, int], DataFrame], width: int, extra: int, powers: int) -> DataFrame:
    """The thin rows ``x`` turned into the strongest directions of a symmetric matrix, each by the root of its weight.

    ``times_matrix`` returns written rows.
    """
    n, last = width + extra, None
    for _ in range(powers + 1):
        product = times_matrix(thin, n)
        if last is not None:
            removed(last)
        last = product
        thin, n = _orthonormal(product, n)
        if not n:
            return thin
    # the matrix within the span: eigenvectors of the products' Gram matrix, as it is symmetric
    within = times_matrix(thin, n)
    values, directions = np.linalg.eigh(_gram(within, n))
    removed(within)
    best = np.argsort(-values)[:width]
    weights = np.maximum(values[best], 0.0) ** 0.25  # the Gram matrix has squares, and a vector the root
    keep = weights > 0
    return _times(thin, directions[:, best[keep]] * weights[keep])


def factored(matrix: DataFrame, width: int = WIDTH, extra: int = EXTRA, powers: int = POWERS) -> DataFrame:
    """``word, vector``: the strongest directions of a symmetric matrix ``a, b, v``, each by the root of its weight."""
    thin = matrix.select(F.col("b").alias("word")).distinct().select("word", _signs(width + extra).alias("x"))
    return _strongest(thin, lambda rows, n: written(_product(matrix, rows, n), "product"), width, extra, powers).select("word", F.col("x").alias("vector"))


def _sums(counted: DataFrame) -> DataFrame:
    """``id, m``: how many pairs a word is in, counted both ways."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").flatten().to_numpy()
            ids, m = _added(np.concatenate([batch.column(c).flatten().to_numpy() for c in "ab"]), np.concatenate([n, n]))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(m)], names=["id", "m"])

    return counted.mapInArrow(parts, "id int, m bigint").groupBy("id").agg(F.sum("m").alias("m"))


def _block_product(counted: DataFrame, thin: DataFrame, columns: range, side: int, total: int) -> DataFrame:
    """Rows (id, m, x0 ...): the matrix of positive pointwise mutual information times some columns of a thin one."""
    names = [f"x{k}" for k in columns]
    n = len(names)

    def multiplied(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        order = np.argsort(ids)
        ids, m = ids[order], rows["m"].to_numpy()[order].astype(float)
        x = [rows[name].to_numpy()[order] for name in names]
        out, met = np.zeros((n, len(ids))), np.zeros(len(ids), bool)
        for batch in pairs.select(["a", "b", "n"]).to_batches(max_chunksize=1) if len(ids) else ():
            a, b, count = (c.flatten().to_numpy() for c in batch.columns)
            at, bt = (np.minimum(np.searchsorted(ids, c), len(ids) - 1) for c in (a, b))
            # words whose values are all 0 have no row any more
            here = (ids[at] == a) & (ids[bt] == b)
            at, bt, v, same = at[here], bt[here], count[here].astype(float), (a == b)[here]
            v = np.log(np.where(same, 2 * v, v) * total / (m[at] * m[bt]))
            up = v > 0
            at, bt, v, other = at[up], bt[up], v[up], np.where(same[up], 0.0, v[up])
            met[at] = met[bt] = True
            for k in range(n):
                out[k] += np.bincount(at, v * x[k][bt], len(ids)) + np.bincount(bt, other * x[k][at], len(ids))
        return pa.table([pa.array(ids[met]), pa.array(m[met].astype(np.int64)), *[pa.array(y[met]) for y in out]], names=["id", "m", *names])

    i = F.col("id") % side
    blocks = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda j: (F.greatest(i, j) * (F.greatest(i, j) + 1) / 2 + F.least(i, j)).cast("int"))
    sent = thin.select(F.explode(blocks).alias("block"), "id", "m", *[F.col("x")[k].alias(f"x{k}") for k in columns])
    made = counted.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(multiplied, "id int, m bigint, " + ", ".join(f"{x} double" for x in names))
    return made.groupBy("id").agg(F.first("m").alias("m"), *[F.sum(x).alias(x) for x in names])


def _whole_product(counted: DataFrame, thin: DataFrame, n: int, side: int, total: int) -> DataFrame:
    """Rows (id, m, x): all columns of the product, some at a time where there are many; written."""
    whole = F.array(*[f"x{k}" for k in range(n)]).alias("x")
    if n <= TOGETHER:
        return written(_block_product(counted, thin, range(n), side, total).select("id", "m", whole), "product")
    parts = [written(_block_product(counted, thin, range(k, min(k + TOGETHER, n)), side, total), f"columns_{k}") for k in range(0, n, TOGETHER)]
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part.drop("m"), "id")
    out = written(joined.select("id", "m", whole), "product")
    for part in parts:
        removed(part)
    return out


def word_vectors(df: DataFrame, text: str = "text", window: int = WINDOW, width: int = WIDTH, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """``word, vector`` of the words of a corpus, written."""
    with shuffles_dropped(df.sparkSession):
        known, counted, side = _pair_counts(df, text, window, least)
        sums = written(_sums(counted), "sums")
        total = sums.agg(F.sum("m")).first()[0] or 0
        start = sums.join(known, "id").select("id", "m", _signs(width + EXTRA).alias("x"))
        thin = _strongest(start, lambda rows, n: _whole_product(counted, rows, n, side, total), width, EXTRA, powers)
        found = written(thin.join(known, "id").select("word", F.col("x").alias("vector")), "word_vectors")
    for made in (counted, sums, known):
        removed(made)
    return found


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def mentions(df: DataFrame, vectors: DataFrame, keys: Sequence[str], text: str = "text", entity: str = "entity") -> DataFrame:
    """``keys`` and ``similarity``: how near a text comes to an entity.

    An entity of one word is held against each word of the text and the nearest counts; one of several words, against the
    text as a whole, both as the sums of their words' vectors. Words without a vector, or none at all, are at 0.
    Texts are dealt into chunks, and a chunk meets the vectors of its own words.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    named = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").alias("text"), F.col(f"`{entity}`").alias("entity"))

    def compared(rows: pa.Table, words: pa.Table) -> pa.Table:
        of = np.append(_rows(words["vector"].combine_chunks()), [[0.0] * width], axis=0) if len(words) else np.zeros((1, width))
        norms = np.sqrt((of * of).sum(1))
        (t, t_ends), (e, e_ends) = (_found(rows[c], words["word"]) for c in ("_0", "_1"))
        out = np.zeros(len(rows))
        many = pc.match_substring(rows["_1"], " ").to_numpy(zero_copy_only=False) if len(rows) else ()
        for i in range(len(rows)):
            a, b = t[t_ends[i] : t_ends[i + 1]], e[e_ends[i] : e_ends[i + 1]]
            a, b = a[a >= 0], b[b >= 0]
            if not len(a) or not len(b):
                continue
            if many[i]:
                ids, n = np.unique(a, return_counts=True)
                x, y = n @ of[ids], of[b].sum(0)
                size = np.sqrt(x @ x) * np.sqrt(y @ y)
                out[i] = round(x @ y / size, 12) if size else 0.0
            else:
                a = np.unique(a)
                a = a[norms[a] > 0]
                if len(a) and norms[b[0]]:
                    out[i] = round((of[a] @ of[b[0]] / norms[a]).max() / norms[b[0]], 12)
        return pa.table([*[rows[f"k{i}"] for i in range(len(keys))], pa.array(out)], names=[*[f"k{i}" for i in range(len(keys))], "similarity"])

    first = vectors.select(F.size("vector")).first()
    width = first[0] if first else 0
    schema = ", ".join([*[f"k{i} {types[k]}" for i, k in enumerate(keys)], "similarity double"])
    with shuffles_dropped(df.sparkSession):
        found = _with_words(_in_chunks(named, "text", "entity"), vectors, 2, compared, schema)
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "similarity")
