"""Vector code compression: product quantisation fitted by the filtering form of Lloyd's algorithm.

Vectors of whole numbers are cut into parts; each part has a codebook, and a vector
becomes the indexes of its parts' nearest entries. Partitions pack their vectors
into shards of bounded size and build one kd-tree over each part of a shard. Trees
are built once and written, as the points in tree order; boxes, sums and counts of
all nodes follow from that order by reductions. A round starts with all entries at
the root. At each node, entries that are nowhere in its box nearer than the entry
next to the box's middle are eliminated; a node with one entry left is assigned as a
whole, by its cached sum and count, and points of leaves meet the few entries that are left.
All nodes of a level, of all parts, are one numpy operation. Partitions send their
sums for each entry; these are added up by Spark and only the sums, whose
number is that of the codebooks' components, reach the driver.

All of it is in whole numbers and exact, so neither partitions nor trees change a
result: 64-bit where products fit, else Python's own (as 32-bit limbs in the sums).

Defined cases: vectors that are null or hold null or non-finite components
(quantised ones included) are dropped; null ids come last in the order of ids, equal ids are ordered by their
vectors; repeated rows are rows of their own; with fewer vectors than entries a
codebook has as many entries as there are vectors; vectors of each length have their
own codebooks; where the parts do not divide a length, its parts differ by one
component, and parts without components are at distance zero; an error beyond 64
bits is given as the largest number of 64 bits; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.storage import lookup, written

PARTS, ENTRIES, ROUNDS, FACTOR = 16, 64, 2, 256
#: Points of a leaf; vectors of a shard, and components of a shard, at most.
LEAF, SHARD, COMPONENTS = 16, 8192, 1 << 20
#: Below this size of components, and up to this length of a part, squared distances with an index fit 64 bits.
_SMALL, _LENGTH = 1 << 24, 64
_MOST = (1 << 63) - 1
_LIMB = 32


def cuts(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [dim * i // parts for i in range(parts + 1)]


def cut_up(rows: np.ndarray, parts: int) -> np.ndarray:
    """(parts, vectors, longest part); shorter parts end in zeros."""
    at = cuts(rows.shape[1], parts)
    out = np.zeros((parts, len(rows), max(1, *(b - a for a, b in zip(at, at[1:], strict=False)))), rows.dtype)
    for i in range(parts):
        out[i, :, : at[i + 1] - at[i]] = rows[:, at[i] : at[i + 1]]
    return out


def whole(values: np.ndarray) -> np.ndarray:
    """Floats that are whole numbers, as 64-bit numbers where squares are safe and as Python's otherwise."""
    if not values.size or np.abs(values).max() < _SMALL:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def tree_order(points: np.ndarray, leaves: int) -> np.ndarray:
    """(parts, points) places in the order of kd-trees with ``leaves`` leaves: each level halves all nodes along their widest side."""
    parts, n, _ = points.shape
    order = np.broadcast_to(np.arange(n), (parts, n)).copy()
    nodes = 1
    while nodes < leaves:
        held = np.take_along_axis(points, order[:, :, None], 1).reshape(parts, nodes, n // nodes, -1)
        widest = (held.max(2) - held.min(2)).argmax(-1)
        values = np.take_along_axis(held, widest[:, :, None, None], 3)[..., 0]
        halves = np.argpartition(values, n // nodes // 2, axis=2)
        order = np.take_along_axis(order.reshape(parts, nodes, -1), halves, 2).reshape(parts, n)
        nodes *= 2
    return order


class Forest:
    """The kd-trees over all parts of a shard: points in tree order, and each level's boxes, sums and counts."""

    def __init__(self, points: np.ndarray, real: np.ndarray, leaves: int):
        """``real``: whether a place holds a vector; others hold copies that fill the tree up."""
        parts, n, length = points.shape
        self.points, self.real = points, real
        held = points.reshape(parts, leaves, n // leaves, length)
        kept = held * real.reshape(parts, leaves, -1, 1)
        levels = [(held.min(2), held.max(2), kept.sum(2), real.reshape(parts, leaves, -1).sum(2))]
        while levels[-1][0].shape[1] > 1:
            levels.append(tuple(f(x[:, 0::2], x[:, 1::2]) for f, x in zip((np.minimum, np.maximum, np.add, np.add), levels[-1], strict=True)))
        self.levels = levels[::-1]

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all points, and the sums and counts of each entry; ``book`` is (parts, entries, length)."""
        parts, n, length = self.points.shape
        entries = book.shape[1]
        codes = np.zeros((parts, n), np.int64)
        sums, counts = np.zeros((parts, entries, length), self.points.dtype), np.zeros((parts, entries), np.int64)
        norms = (book * book).sum(-1)
        part, node = np.arange(parts), np.zeros(parts, np.int64)
        left = np.ones((parts, entries), bool)
        for depth, (low, high, total, many) in enumerate(self.levels):
            a, b = low[part, node], high[part, node]
            own = book[part]
            # twice the middle, to stay with whole numbers
            far = ((2 * own - (a + b)[:, None]) ** 2).sum(-1)
            if far.dtype == object:  # the choice is free, so the leading bits will do
                far >>= max(0, int(far.max()).bit_length() - 1000)
            best = np.where(left, far.astype(float), np.inf).argmin(1)
            every = np.arange(len(part))
            apart = own - own[every, best][:, None]
            reach = 2 * np.maximum(apart * a[:, None], apart * b[:, None]).sum(-1)
            least = norms[part] - norms[part, best][:, None] - reach  # how much farther an entry is, where the box favours it most
            left &= (least < 0) | ((least == 0) & (np.arange(entries) <= best[:, None]))
            left[every, best] = True
            done = left.sum(1) == 1
            p, i, z = part[done], node[done], best[done]
            np.add.at(sums, (p, z), total[p, i])
            np.add.at(counts, (p, z), many[p, i])
            codes.reshape(parts, 1 << depth, -1)[p, i] = z[:, None]
            part, node, left = part[~done], node[~done], left[~done]
            if depth < len(self.levels) - 1:
                part, node, left = np.repeat(part, 2), np.repeat(2 * node, 2) + np.tile([0, 1], len(node)), np.repeat(left, 2, 0)
        if len(part):
            self._leaves(book, part, node, left, codes, sums, counts)
        return codes, sums, counts

    def _leaves(self, book: np.ndarray, part: np.ndarray, node: np.ndarray, left: np.ndarray, codes: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
        parts, _, length = self.points.shape
        leaves = self.levels[-1][0].shape[1]
        held = self.points.reshape(parts, leaves, -1, length)
        real = self.real.reshape(parts, leaves, -1)
        for begin in range(0, len(part), 2048):
            p, i, some = part[begin : begin + 2048], node[begin : begin + 2048], left[begin : begin + 2048]
            at, z = np.nonzero(some)
            distance = ((held[p[at], i[at]] - book[p[at], z][:, None]) ** 2).sum(-1)
            # the index makes ties go to the lower one
            nearest = np.minimum.reduceat(distance * book.shape[1] + z[:, None], np.flatnonzero(np.r_[True, at[1:] != at[:-1]]))
            found = (nearest % book.shape[1]).astype(np.int64)
            codes.reshape(parts, leaves, -1)[p, i] = found
            keep = real[p, i].astype(bool)
            to = np.broadcast_to(p[:, None], found.shape)[keep], found[keep]
            np.add.at(sums, to, held[p, i][keep])
            np.add.at(counts, to, 1)


@dataclass
class Books:
    """Codebooks by length of vectors: (parts, entries, longest part) whole numbers."""

    parts: int
    of: dict[int, np.ndarray]

    def digest(self, dim: int) -> str:
        at = cuts(dim, self.parts)
        listed = (str(int(x)) for p, book in enumerate(self.of[dim]) for entry in book for x in entry[: at[p + 1] - at[p]])
        return hashlib.sha256(",".join(listed).encode()).hexdigest()

    def decode(self, dim: int, code: str) -> list[int]:
        """The vector that a code stands for."""
        at = cuts(dim, self.parts)
        return [int(x) for p in range(self.parts) for x in self.of[dim][p, int(code[2 * p : 2 * p + 2], 16)][: at[p + 1] - at[p]]]


def kept(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", factor: int = FACTOR) -> DataFrame:
    """``vec_id``, ``label`` and ``q``, the components as whole numbers (in doubles), of the vectors that take part."""
    keys = [F.col(f"`{c}`").cast("string" if df.schema[c].dataType.typeName() == "void" else df.schema[c].dataType).alias(name) for c, name in ((vec_id, "vec_id"), (label, "label"))]
    named = df.select(*keys, F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x * factor) < float("inf"), F.lit(False)))
    # a double that is beyond 2^53 is whole already, and floor() gives 64-bit numbers
    scaled = F.transform("v", lambda x: F.when(F.abs(x * factor) < 2.0**53, F.floor(x * factor).cast("double")).otherwise(x * factor))
    return named.filter(F.col("v").isNotNull() & finite).select("vec_id", "label", scaled.alias("q"))


def packed(rows: DataFrame, parts: int = PARTS, shard: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """Shards of vectors of one length: their keys, and their parts in the order of kd-trees."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.RecordBatch, np.ndarray]]] = defaultdict(list)
        sizes: dict[int, int] = defaultdict(int)

        def row(dim: int) -> pa.RecordBatch:
            found = held.pop(dim)
            sizes.pop(dim)
            values = np.concatenate([v for _, v in found])
            n, leaves = len(values), 1
            while leaves * leaf < n:
                leaves *= 2
            size = -(-n // leaves) * leaves
            points = cut_up(values[np.minimum(np.arange(size), n - 1)], parts)
            order = tree_order(points, leaves).astype("<i4")
            small = not values.size or np.abs(values).max() < _SMALL
            ordered = np.take_along_axis(points, order[:, :, None], 1).astype("<i4" if small else "<f8")
            arrays = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([k.column(i) for k, _ in found])) for i in range(2)]
            arrays += [pa.array([x], t) for x, t in ((dim, pa.int32()), (n, pa.int32()), (leaves, pa.int32()), (small, pa.bool_()), (order.tobytes(), pa.binary()), (ordered.tobytes(), pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "dim", "n", "leaves", "small", "places", "points"])

        for batch in batches:
            lengths = np.diff(np.asarray(batch.column(2).offsets))
            values = np.asarray(batch.column(2).flatten())
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                if len(at) == batch.num_rows:
                    some = values.reshape(len(at), dim)
                else:
                    begins = np.asarray(batch.column(2).offsets)[at] - batch.column(2).offsets[0].as_py()
                    some = values[begins[:, None] + np.arange(dim)]
                most = max(1, min(shard, COMPONENTS // max(dim, 1)))
                begin = 0
                while begin < len(at):
                    end = min(len(at), begin + most - sizes[dim])
                    held[dim].append((batch.select([0, 1]).take(pa.array(at[begin:end])), some[begin:end]))
                    sizes[dim] += end - begin
                    begin = end
                    if sizes[dim] >= most:
                        yield row(dim)
        for dim in list(held):
            yield row(dim)

    return rows.mapInArrow(mapped, f"vec_id array<{kinds[0]}>, label array<{kinds[1]}>, dim int, n int, leaves int, small boolean, places binary, points binary")


def _forest(r: dict, parts: int, book: np.ndarray) -> tuple[Forest, np.ndarray, np.ndarray]:
    """Trees of a shard, its places, and the codebook in the same kind of numbers."""
    places = np.frombuffer(r["places"], "<i4").reshape(parts, -1)
    points = whole(np.frombuffer(r["points"], "<i4" if r["small"] else "<f8").astype(float)).reshape(parts, places.shape[1], -1)
    narrow = points.dtype != object and np.abs(book).max(initial=0) < _SMALL and points.shape[2] <= _LENGTH
    kind = np.int64 if narrow else object
    return Forest(points.astype(kind), places < r["n"], r["leaves"]), places, book.astype(kind)


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """A whole number as (place, value) limbs that add up one by one."""
    sign, x, k = (-1 if x < 0 else 1), abs(x), 0
    while x:
        yield k, sign * (x & ((1 << _LIMB) - 1))
        x, k = x >> _LIMB, k + 1


def _summed(shards: DataFrame, books: Books) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The sums and counts of all entries, by length of vectors."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                trees, _, book = _forest(r, books.parts, books.of[r["dim"]])
                _, sums, counts = trees.assign(book)
                both = np.concatenate([sums.astype(object), counts[:, :, None].astype(object)], 2)
                total[r["dim"]] = total[r["dim"]] + both if r["dim"] in total else both
        found = [(dim, at, k, v) for dim, both in total.items() for at, x in enumerate(both.ravel().tolist()) for k, v in _limbs(int(x))]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)] if found else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())], names=["dim", "at", "k", "v"])

    out = {dim: np.zeros((*book.shape[:2], book.shape[2] + 1), object) for dim, book in books.of.items()}
    summed = shards.select("dim", "n", "leaves", "small", "places", "points").mapInArrow(mapped, "dim int, at int, k int, v long").groupBy("dim", "at", "k").agg(F.sum("v").alias("v"))
    for r in summed.collect():
        out[r.dim].reshape(-1)[r.at] += r.v << (_LIMB * r.k) if r.v >= 0 else -(-r.v << (_LIMB * r.k))
    return {dim: (both[:, :, :-1], both[:, :, -1]) for dim, both in out.items()}


def fit(rows: DataFrame, shards: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks from the vectors with the smallest ids, moved to their parts' means round by round."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hexadecimal digits: 1 to 256 entries")
    books = Books(parts, {})
    for (dim,) in shards.select("dim").distinct().collect():
        first = rows.filter(F.size("q") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
        books.of[dim] = cut_up(np.array([[int(x) for x in r.q] for r in first], object).reshape(len(first), dim), parts)
    for _ in range(rounds):
        for dim, (sums, counts) in _summed(shards, books).items():
            book = books.of[dim]
            for p, z in zip(*np.nonzero(counts), strict=True):
                book[p, z] = [int(x) // int(counts[p, z]) for x in sums[p, z]]
    return books


def encode(shards: DataFrame, books: Books) -> DataFrame:
    """``vec_id``, ``label``, ``dim``, ``code`` and ``error`` of every vector."""
    digits = np.array([f"{i:02x}" for i in range(256)], "S2")
    kinds = [shards.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label")]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(batch.select([2, 3, 4, 5, 6, 7]).to_pylist()):
                trees, places, book = _forest(r, books.parts, books.of[r["dim"]])
                found, _, _ = trees.assign(book)
                n = r["n"]
                codes, error = np.zeros((n, books.parts), np.int64), np.zeros(n, trees.points.dtype)
                for p in range(books.parts):
                    own = places[p] < n
                    codes[places[p, own], p] = found[p, own]
                    error[places[p, own]] += ((trees.points[p, own] - book[p, found[p, own]]) ** 2).sum(1)
                text = np.ascontiguousarray(digits[codes]).view(f"S{2 * books.parts}")[:, 0]
                errors = pa.array(error if error.dtype != object else [min(int(x), _MOST) for x in error], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten(), pa.array(np.full(n, r["dim"], np.int32)), pa.array(text.astype(str)), errors], names=["vec_id", "label", "dim", "code", "error"])

    return shards.mapInArrow(mapped, f"vec_id {kinds[0]}, label {kinds[1]}, dim int, code string, error long")


def compress(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", shard: int = SHARD
) -> tuple[DataFrame, Books]:
    """``vec_id``, ``label``, ``dim``, ``code``, ``error`` and ``label_error`` of every vector, and the codebooks.

    ``label_error`` is the error summed over equal labels, nulls together.
    """
    rows = kept(df, vec_id, vector, label, factor)
    shards = written(packed(rows, parts, shard), "code_shards")
    books = fit(rows, shards, parts, entries, rounds)
    coded = written(encode(shards, books), "codes")
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST)).cast("long").alias("label_error"))
    by_label = lookup(sums.withColumnRenamed("label", "_label"), "label_errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label"), books


def report(coded: DataFrame, books: Books) -> DataFrame:
    """The results with the digest of the codebooks of their length."""
    digests = F.create_map(*[F.lit(x) for dim in books.of for x in (dim, books.digest(dim))]) if books.of else F.create_map(F.lit(-1), F.lit(""))
    return coded.select("vec_id", "code", "error", "label_error", F.element_at(digests, F.col("dim")).alias("codebooks_sha256"))
