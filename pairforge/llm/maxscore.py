"""Exact top-k inner-product search by MaxScore.

Components are quantised to integers. Vectors are packed once into shards of a
bounded number of rows; a shard keeps one posting list for each dimension, in
row order, and its least and largest value. Measured from its least possible
value, every term (dimension) of a query adds between nothing and its bound.
Terms are ordered by bound; the least ones whose bounds together cannot lift a
row over the k-th best score so far are non-essential. Essential postings are
traversed for all rows; the others are probed one after another for the rows that
stay competitive. Shards give each query at most k rows, which are then merged.

Queries travel in blocks. Each block first meets the shard that it comes from,
which gives every query a first threshold; then each block meets each other
shard, so no row of the search is made for a pair of vectors. The two sides are
joined as a Cartesian product of partitions, never by broadcast: a task has some
shards, those with large values first, and some blocks, and holds k scores for
each query of its blocks, which it returns once at its end.

Scores are exact 64-bit integers. Where sums are not exact in double precision,
thresholds give way by the rounding error and the rows that stay competitive are
scored in whole numbers. A score beyond 64 bits is given, and ranks, as the
nearest one that fits.

Defined cases: vectors that are null, hold null or non-finite components, or whose
quantised components are not finite, take no part; vectors without components
score zero; vectors of different lengths do not meet; repeated rows are rows of
their own, and only the query's own row is left out; ties go to the smaller id,
null ids last; ids are cast to 64-bit integers; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.storage import written

#: Rows of a shard, queries of a block, factor of the quantisation, blocks that a task meets at once.
SHARD, BLOCK, FACTOR, BLOCKS = 8192, 256, 1024, 64
#: Sums of products below this are exact in double precision.
_EXACT = float(1 << 53)
_NO_ID = np.iinfo(np.int64).max
#: Beyond this, products in double precision may not be finite; the least and the largest score.
_HUGE = 1e290
_SMALLEST, _LARGEST = -(1 << 63), (1 << 63) - 1
_PACKED = "part int, shard int, dim int, rows int, size double, ids binary, missing binary, terms binary"


def quantised(vectors: list, factor: int = FACTOR) -> list[np.ndarray | None]:
    """floor(factor * x) of each component in double precision; None for vectors that take no part."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            x = None if x is None else np.floor(factor * x)
            out.append(x if x is not None and np.isfinite(x).all() else None)
    return out


def packed(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", factor: int = FACTOR, shard: int = SHARD) -> DataFrame:
    """Shards of vectors of one length: ids, and the values dimension by dimension."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))

        def row(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, rows = held.pop(dim)
            made += 1
            values = np.array([_NO_ID if i is None else i for i in ids], "<i8")
            terms = np.stack(rows).T if dim else np.empty((0, len(ids)))
            with np.errstate(over="ignore"):
                size = max((float(x @ x) for x in rows), default=0.0)
            columns = [[part], [made], [dim], [len(ids)], [size], [values.tobytes()], [bytes(i is None for i in ids)], [np.ascontiguousarray(terms, "<f8").tobytes()]]
            kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "shard", "dim", "rows", "size", "ids", "missing", "terms"])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), quantised(batch.column(1).to_pylist(), factor), strict=True):
                if x is not None:
                    held[len(x)][0].append(i)
                    held[len(x)][1].append(x)
                    if len(held[len(x)][0]) >= shard:
                        yield row(len(x))
        for dim in list(held):
            yield row(dim)

    return df.select(F.col(vec_id).cast("long"), F.col(vector)).mapInArrow(mapped, _PACKED)


def _blocks(shards: DataFrame, k: int, divisor: int, block: int) -> DataFrame:
    """The rows whose id the divisor divides, in blocks, with their best scores in the shard that they come from."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                home = _shard(r)
                at = np.flatnonzero((home.ids % divisor == 0) & (np.frombuffer(r["missing"], "u1") == 0))
                for begin in range(0, len(at), block):
                    own = at[begin : begin + block]
                    best = Best(k)
                    for i in own.tolist():
                        best.meet(i, home.terms[:, i], home, i)
                    found = best.rows()
                    columns = {"q_part": r["part"], "q_shard": r["shard"], "q_dim": r["dim"], "q_at": own.astype("<i8").tobytes(), "q_ids": home.ids[own].tobytes(), "q_terms": home.terms[:, own].T.astype("<f8").tobytes()}
                    columns |= {c: np.array([x[j] for x in found], "<i8").tobytes() for j, c in enumerate(("q_of", "q_found", "q_scores"))}
                    yield pa.RecordBatch.from_pydict({c: [v] for c, v in columns.items()}, schema=schema)

    kinds = [(c, pa.int32()) for c in ("q_part", "q_shard", "q_dim")] + [(c, pa.binary()) for c in ("q_at", "q_ids", "q_terms", "q_of", "q_found", "q_scores")]
    schema = pa.schema(kinds)
    return shards.mapInArrow(mapped, ", ".join(f"{c} {'int' if t == pa.int32() else 'binary'}" for c, t in kinds))


class Shard:
    """Posting lists of one shard and their bounds."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray):
        self.ids, self.terms = ids, terms
        self.low, self.high = (terms.min(1), terms.max(1)) if terms.size else (np.zeros(len(terms)), np.zeros(len(terms)))
        self.most = float(np.abs(terms).max(initial=0))

    def whole(self, query: np.ndarray, rows: list[int]) -> list[int]:
        """Scores in whole numbers, as near as 64 bits come to them."""
        q = list(map(int, query.tolist()))
        sums = (sum(x * int(y) for x, y in zip(q, self.terms[:, i].tolist(), strict=True)) for i in rows)
        return [min(max(x, _SMALLEST), _LARGEST) for x in sums]

    def top(self, query: np.ndarray, k: int, skip: int = -1, floor: float = -np.inf) -> list[tuple[int, int]]:
        """(row, score) of the k best rows, by score and then id; rows below ``floor`` may be missing."""
        n = len(self.ids)
        if not n:
            return []
        size = self.most * float(np.abs(query).max(initial=0)) * max(len(query), 1)
        exact = size < _EXACT
        if size >= _HUGE:
            return self._best([i for i in range(n) if i != skip], self.whole(query, [i for i in range(n) if i != skip]), k)
        # the most and the least that each term can add
        a, b = query * self.low, query * self.high
        most, bound = np.maximum(a, b), np.abs(b - a)
        order = np.argsort(-bound, kind="stable")
        left = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])  # of the terms from i on
        slack = 0.0 if exact else 1e-9 * (1 + float(np.abs(a).sum() + np.abs(b).sum()))
        if n > 8 * k:  # a few scores give a first threshold
            some = query @ self.terms[:, : 4 * k + 1]
            if 0 <= skip <= 4 * k:
                some[skip] = -np.inf
            floor = max(floor, float(np.partition(some, -k)[-k]) - slack)
        floor = -np.inf if floor <= _SMALLEST else min(floor, float(_LARGEST)) - slack
        # with all essential terms at their least, the others do not lift a row to the threshold
        below = float((most - bound).sum()) + np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]]) < floor
        essential = int(np.argmax(below)) if below.any() else len(order)
        total = np.zeros(n)
        for t in order[:essential].tolist():
            total += query[t] * self.terms[t]
        rows = np.flatnonzero(total + left[essential] >= floor)
        total = total[rows]
        for i, t in enumerate(order[essential:].tolist(), essential):
            total += query[t] * self.terms[t, rows]
            if i % 4 == 3:
                stay = total + left[i + 1] >= floor
                rows, total = rows[stay], total[stay]
        keep = rows != skip
        rows, total = rows[keep], total[keep]
        if len(rows) > k:
            total = total if exact else np.clip(total, _SMALLEST, _LARGEST)
            keep = total >= np.partition(total, -k)[-k] - 2 * slack
            rows, total = rows[keep], total[keep]
        return self._best(rows.tolist(), total.astype(np.int64).tolist() if exact else self.whole(query, rows.tolist()), k)

    def _best(self, rows: list[int], scores: list[int], k: int) -> list[tuple[int, int]]:
        best = sorted((-score, int(self.ids[row]), row) for row, score in zip(rows, scores, strict=True))[:k]
        return [(row, -score) for score, _, row in best]


def _shard(r: dict) -> Shard:
    return Shard(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["terms"], "<f8").reshape(r["dim"], r["rows"]))


class Best:
    """The k best rows of each of some queries so far, by score and then id."""

    def __init__(self, k: int):
        self.k, self.found = k, defaultdict(list)

    def seed(self, name, ids: list[int], scores: list[int]) -> None:
        """Rows found elsewhere: they raise the threshold and are not returned here."""
        self.found[name] = [(-score, i, True) for i, score in zip(ids, scores, strict=True)]

    def meet(self, name, query: np.ndarray, shard: Shard, skip: int = -1) -> None:
        held = self.found[name]
        floor = -held[-1][0] if len(held) >= self.k else -np.inf
        new = [(-score, int(shard.ids[row]), False) for row, score in shard.top(query, self.k, skip, floor)]
        if new:
            self.found[name] = sorted(held + new)[: self.k]

    def rows(self) -> list[tuple]:
        """(name, id, score) of each row found here."""
        return [(name, i, -score) for name, held in self.found.items() for score, i, elsewhere in held if not elsewhere]


def search(df: DataFrame, k: int = 10, divisor: int = 100, vec_id: str = "vec_id", vector: str = "embedding", factor: int = FACTOR, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best rows; queries have ids that ``divisor`` divides."""
    shards = written(packed(df, vec_id, vector, factor, shard), "vector_shards")
    blocks = written(_blocks(shards, k, divisor, block), "query_blocks")

    def results(found: list[tuple]) -> pa.RecordBatch:
        """Of ((query, query's id), id, score) rows."""
        ids = np.array([i for _, i, _ in found], np.int64)
        columns = [pa.array([q for (q, _), _, _ in found], pa.string()), pa.array([i for (_, i), _, _ in found], pa.int64()), pa.array(ids, mask=ids == _NO_ID), pa.array([x for _, _, x in found], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "vec_id", "score"])

    def named(r: dict) -> dict[int, tuple[str, int]]:
        """The queries of a block by their place in its shard."""
        return {at: (f"{r['q_part']}:{r['q_shard']}:{r['q_dim']}:{at}", i) for at, i in zip(*(np.frombuffer(r[c], "<i8").tolist() for c in ("q_at", "q_ids")), strict=True)}

    def at_home(r: dict) -> Iterator[tuple[int, int, int]]:
        return zip(*(np.frombuffer(r[c], "<i8").tolist() for c in ("q_of", "q_found", "q_scores")), strict=True)

    def from_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names = named(r)
                yield results([(names[at], i, score) for at, i, score in at_home(r)])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        best = Best(k)
        for batch in batches:
            for r in batch.to_pylist():
                here = r["part"], r["shard"], r["dim"]
                if r["dim"] != r["q_dim"] or here == (r["q_part"], r["q_shard"], r["q_dim"]):
                    continue
                if at != here:
                    at, shard = here, _shard(r)
                names = named(r)
                if not best.found.keys() & names.values():
                    seeds: dict[int, list] = {place: [] for place in names}
                    for place, i, score in at_home(r):
                        seeds[place].append((i, score))
                    for place, held in seeds.items():
                        best.seed(names[place], [i for i, _ in held], [x for _, x in held])
                for name, query in zip(names.values(), np.frombuffer(r["q_terms"], "<f8").reshape(len(names), r["q_dim"]), strict=True):
                    best.meet(name, query, shard)
        yield results(best.rows())

    kinds = "query string, query_id long, vec_id long, score long"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = shards.repartition(n, "part", "shard", "dim").sortWithinPartitions(F.desc("size"))
    some = blocks.coalesce(max(1, -(-blocks.count() // BLOCKS)))
    found = placed.hint("shuffle_replicate_nl").crossJoin(some).mapInArrow(mapped, kinds).union(blocks.mapInArrow(from_home, kinds))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
