"""Substring deduplication with a log-structured fingerprint index.

The index is a list of sorted immutable runs of window hashes. A run holds for
each window of fifty words of one batch of documents two independent 64-bit
hashes of all its words and its owner, the smallest document that has it. A run
is bucketed and sorted by the hashes, so a new batch is merge-joined with the
runs where they lie: only the batch is shuffled, no text of earlier batches is
read, and a match of the first hash is verified by the second. Compaction merges
a few runs of like size into one of the next tier. A document gives up its windows except those it owns; the owned
ones are gathered by document, so a passage that a third of all documents share
is only ever aggregated, with partial sums before the shuffle.

A whole table (:func:`deduplicate_table`) is a first batch, indexed as history,
and a second one merge-joined with it. As no batch follows, windows that cannot
repeat stay out: the anchor of a window is the least hash of the ten-word pieces
in it, equal windows have equal anchors, a text has a new one in about every
twenty words, and a window whose anchor one document alone has is its own. For
an index that later batches meet (:func:`increment`) every window enters.

Words are runs of bytes other than ASCII white space. Defined cases: a null text
has no words; fewer words than a window never repeat; very long texts are taken
whole; rows with equal ids count as one document and do not remove each other's
words; rows with a null id neither lose words nor cause losses; ids may have any type with
an order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pairforge.llm.storage import scratch_path, working, written

#: Words in a window and in the pieces whose least hash is its anchor.
WINDOW, PIECE = 50, 10
#: Texts are hashed in slices of about so many bytes; word hashes that a worker keeps.
SLICE, WORDS = 1_500_000, 100_000
#: Of so many parts of a whole table one is indexed first, as history.
PARTS = 4
#: Batches of a whole table's history.
HISTORY = 2
#: Runs of one tier that are merged into one of the next.
RUNS = 4


class _Hashes(dict):
    """Word hashes of a worker, made when a word is first seen."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = _Hashes()
_POWERS: dict[int, np.ndarray] = {}
#: Odd bases of the two window hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at ASCII white space alone


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORDS) > WORDS:
        _WORDS.clear()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        steps = np.full(max(n, SLICE // 4), base, np.uint64)
        steps[0] = 1
        got = _POWERS[base] = np.multiply.accumulate(steps)
    return got[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _sums(words: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(base, len(words)), out=out[1:])
    return out


def _rolling(sums: np.ndarray, base: int, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words; the place drops out by the inverse power."""
    n = len(sums) - width
    inverse = pow(base, -1, 1 << 64)
    return _mixed((sums[width:] - sums[:n]) * _powers(inverse, n))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1])


class Hashed:
    """The windows of some texts: their document's number, place and anchor."""

    def __init__(self, texts: list[list[bytes]]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self._words = _word_hashes([w for t in texts for w in t])
        begins = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        self._at = np.repeat(begins, counts) + self.place
        self.anchor = np.empty(0, np.int64)
        if len(self._at):
            self._sums = _sums(self._words, _BASES[0])
            self.anchor = _least(_rolling(self._sums, _BASES[0], PIECE), WINDOW - PIECE + 1)[self._at].view(np.int64)

    def key(self, number: int, which: np.ndarray) -> np.ndarray:
        """One of the two hashes of the whole windows that ``which`` marks."""
        at = self._at[which]
        if not len(at):
            return np.empty(0, np.int64)
        base = _BASES[number]
        sums = _sums(_mixed(self._words), base) if number else self._sums
        inverse = _powers(pow(base, -1, 1 << 64), len(self._words))
        return _mixed((sums[at + WINDOW] - sums[at]) * inverse[at]).view(np.int64)


def _sliced(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Parts of a batch of about ``SLICE`` bytes of text, each with its rows' words; only one is split up at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= SLICE or i == len(sizes) - 1:
            part = batch.slice(begin, i + 1 - begin)
            yield part, [split_words(t) for t in part.column(text).to_pylist()]
            begin, held = i + 1, 0


def _kind(df: DataFrame) -> str:
    """The type that ids have here: 64-bit for whole numbers, their own for others."""
    kind = df.schema["doc_id"].dataType
    return "bigint" if isinstance(kind, IntegralType) else kind.simpleString()


def _documents(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col("doc_id").cast(_kind(df)).alias("doc_id"), F.col(text).alias("text"))


def anchors(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, anchor): the window anchors of each row, without repeats."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("substring", _WORDS.clear)
        for batch in batches:
            for part, words in _sliced(batch):
                h = Hashed(words)
                new = np.ones(len(h.doc), bool)
                new[1:] = (h.anchor[1:] != h.anchor[:-1]) | (h.doc[1:] != h.doc[:-1])
                doc, found = h.doc[new], h.anchor[new]
                order = np.lexsort((found, doc))
                doc, found = doc[order], found[order]
                new = np.ones(len(doc), bool)
                new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[new])), pa.array(found[new])], names=["doc_id", "anchor"])

    return _documents(df, text).filter("doc_id is not null").mapInArrow(mapped, f"doc_id {_kind(df)}, anchor long")


def _marked(df: DataFrame, own: DataFrame | None, text: str) -> DataFrame:
    """``doc_id, text, own``: the anchors whose windows need no look; null where no window does."""
    docs = _documents(df, text)
    if own is None:
        return docs.withColumn("own", F.array().cast("array<long>"))
    return docs.join(own, "doc_id", "left").select("doc_id", "text", "own")


def _own(df: DataFrame, text: str) -> DataFrame:
    """``doc_id, own``: the anchors that no other document has, of documents that have others as well."""
    found = written(anchors(df, text), "anchors")
    alone = found.groupBy("anchor").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last")).filter("doc_id = last")
    own = alone.groupBy("doc_id").agg(F.collect_list("anchor").alias("own"))
    # repeated rows of one document count an anchor once for each row, so ``n`` may be above the anchors but never below
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    some = n.join(own, "doc_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<long>")))
    return written(some.filter(F.col("n") > F.size("own")).select("doc_id", "own"), "own_anchors")


def _values(scalar: pa.Scalar) -> np.ndarray:
    return np.asarray(scalar.values) if scalar.is_valid else np.empty(0, np.int64)


def _open(h: Hashed, part: pa.RecordBatch, own: int) -> np.ndarray:
    """Which windows are to be looked at: none of rows without id or mark, of others those whose anchor is not their own."""
    out = np.zeros(len(h.doc), bool)
    bounds = np.searchsorted(h.doc, np.arange(part.num_rows + 1))
    ids, marks = part.column(0), part.column(own)
    for i in range(part.num_rows):
        a, b = bounds[i], bounds[i + 1]
        if b > a and ids[i].is_valid and marks[i].is_valid:
            mine = _values(marks[i])
            out[a:b] = ~np.isin(h.anchor[a:b], mine) if len(mine) else True
    return out


def _windows(marked: DataFrame) -> DataFrame:
    """(key1, key2, owner) of the windows to be looked at, once for each distinct window."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("substring", _WORDS.clear)
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(1)), pc.is_valid(batch.column(2))))
            for part, words in _sliced(batch):
                h = Hashed(words)
                which = _open(h, part, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h.key(0, which)), pa.array(h.key(1, which)), part.column(0).take(pa.array(h.doc[which]))], names=["key1", "key2", "doc_id"])

    rows = marked.mapInArrow(mapped, f"key1 long, key2 long, doc_id {_kind(marked)}")
    return rows.groupBy("key1", "key2").agg(F.min("doc_id").alias("owner"))


class FingerprintIndex:
    """Sorted immutable runs of (key1, key2, owner) in one folder.

    ``runs`` lists the live ones, the oldest first; to open an index again, pass its path and what
    they were, and the ids' type where they are no whole numbers. A run's name ends in its tier and
    its number of buckets, that of the shuffle partitions when it was written, so a batch shuffled alike
    is joined in place. Batches enter at tier 0; :meth:`settle` merges ``fanout`` runs of one
    tier into one of the next, so a window is written again once for each tier, which is
    a logarithm of the number of batches.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, runs: list[str] | None = None, kind: str = "bigint", fanout: int = RUNS):
        self.spark, self.path, self.kind, self.fanout = spark, path or scratch_path(spark, "fingerprint_index"), kind, fanout
        self.runs = list(runs or [])

    @staticmethod
    def tier(run: str) -> int:
        return int(run.split("_")[2].removeprefix("t"))

    def write(self, rows: DataFrame, tier: int = 0) -> str:
        """One run's files; it is not yet part of the index."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        run = f"run_{uuid.uuid4().hex}_t{tier}_{n}"
        rows.write.format("parquet").option("path", f"{self.path}/{run}").bucketBy(n, "key1", "key2").sortBy("key1", "key2").saveAsTable(f"pairforge_{run}")
        return run

    def read(self, run: str) -> DataFrame:
        """A run as a bucketed table, which another session may have written."""
        n = run.rpartition("_")[2]
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS pairforge_{run} (key1 BIGINT, key2 BIGINT, owner {self.kind}) USING parquet "
            f"CLUSTERED BY (key1, key2) SORTED BY (key1, key2) INTO {n} BUCKETS LOCATION '{self.path}/{run}'"
        )
        return self.spark.table(f"pairforge_{run}")

    def append(self, df: DataFrame, text: str = "text", own: DataFrame | None = None) -> str:
        """Add the windows of a batch of documents as a run."""
        self.kind = _kind(df)
        self.runs.append(self.write(_windows(_marked(df, own, text))))
        return self.runs[-1]

    @staticmethod
    def met(new: DataFrame, run: DataFrame, how: str) -> DataFrame:
        """Merge-join windows with a run: the owner of each is the smaller of the two."""
        same = (F.col("n.key1") == F.col("r.key1")) & (F.col("n.key2") == F.col("r.key2"))
        joined = new.alias("n").join(run.alias("r").hint("merge"), same, how)
        return joined.select(F.coalesce("n.key1", "r.key1").alias("key1"), F.coalesce("n.key2", "r.key2").alias("key2"), F.least("n.owner", "r.owner").alias("owner"))

    def _merged(self, runs: list[str]) -> str:
        rows = self.read(runs[0])
        for run in runs[1:]:
            rows = self.met(rows, self.read(run), "full_outer")
        return self.write(rows, 1 + max(map(self.tier, runs)))

    def settle(self) -> None:
        """Merge the runs of each tier that has ``fanout`` of them, from the lowest on; the index is as large as before."""
        tier = 0
        while any(self.tier(r) >= tier for r in self.runs):
            full = [r for r in self.runs if self.tier(r) == tier]
            if len(full) >= self.fanout:
                at = self.runs.index(full[0])
                merged = self._merged(full)
                self.runs = [*self.runs[:at], merged, *[r for r in self.runs[at:] if r not in full]]
            tier += 1

    def compact(self) -> DataFrame:
        """Merge all runs into one, which takes their place; returns it."""
        if len(self.runs) > 1:
            self.runs = [self._merged(self.runs)]
        return self.read(self.runs[0])


def _judged(marked: DataFrame, owners: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``; ``owners`` has every window to be looked at that a row of ``marked`` owns."""
    owned = owners.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("key1").alias("owned"))
    told = marked.join(owned, "doc_id", "left").select("doc_id", "text", "own", "owned")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("substring", _WORDS.clear)
        for batch in batches:
            for part, rows in _sliced(batch):
                n_removed, lost = [0] * len(rows), {}
                looked_at = pc.and_(pc.is_valid(part.column(0)), pc.is_valid(part.column(2)))
                some = part.select([0, 2, 3]).filter(looked_at)
                if some.num_rows:
                    which = np.flatnonzero(np.asarray(looked_at)).tolist()
                    h = Hashed([rows[i] for i in which])
                    open_ = _open(h, some, 1)
                    bounds = np.searchsorted(h.doc, np.arange(len(which) + 1))
                    keys = np.zeros(len(h.doc), np.int64)
                    keys[open_] = h.key(0, open_)
                    for j, i in enumerate(which):
                        a, b = bounds[j], bounds[j + 1]
                        if open_[a:b].any():
                            lost[i] = open_[a:b] & ~np.isin(keys[a:b], _values(some.column(2)[j]))
                kept = []
                for i, words in enumerate(rows):
                    if i in lost and lost[i].any():
                        edges = np.zeros(len(words) + 1, np.int64)
                        edges[: len(lost[i])] += lost[i]
                        edges[WINDOW : WINDOW + len(lost[i])] -= lost[i]
                        gone = np.cumsum(edges[:-1]) > 0
                        n_removed[i] = int(gone.sum())
                        words = [words[j] for j in np.flatnonzero(~gone).tolist()]
                    kept.append(b" ".join(words).decode())
                columns = [part.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    return told.mapInArrow(mapped, f"doc_id {_kind(marked)}, n_words long, n_removed long, kept string")


def increment(df: DataFrame, index: FingerprintIndex, text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of each row of a new batch, which becomes part of the index.

    A window is lost where a smaller document of the batch or of any earlier
    one has it. Earlier results stay as they were given; a later document with
    a smaller id is judged, and owns, as any other.
    """
    earlier, run = list(index.runs), index.append(df, text)
    new = index.read(run)
    owners = new
    for old in earlier:
        owners = index.met(owners, index.read(old), "left")
    index.settle()
    return _judged(_marked(df, None, text), owners)


def deduplicate_table(df: DataFrame, parts: int = PARTS, text: str = "text") -> DataFrame:
    """A whole table: one of ``parts`` hash parts of its documents is history, the others are merge-joined with it.

    History comes as ``HISTORY`` batches, each a run, which are then merged into one of the next tier.
    """
    spark = df.sparkSession
    own = _own(df, text)
    index = FingerprintIndex(spark, fanout=HISTORY)
    dealt = F.pmod(F.xxhash64(F.col("doc_id").cast(_kind(df))), F.lit(parts * HISTORY))
    first = dealt < HISTORY
    for batch in range(HISTORY):
        index.append(df.filter(dealt == batch), text, own)
    index.settle()
    marked = _marked(df, own, text)
    # the same join as in the judgement, so that its shuffle of the texts is reused
    later = marked.select("doc_id", F.when(F.col("own").isNotNull() & ~first, F.col("text")).alias("text"), "own")
    owners = index.met(_windows(later), index.read(index.runs[0]), "full_outer")
    return _judged(marked, owners)
