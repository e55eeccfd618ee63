"""Token-id files compressed by Re-Pair grammars.

Documents are put in ascending id order by a range partitioning; every task
encodes its own, appends the end id to each and cuts them into shards of a
bounded number of ids. A shard is compressed on its own by Re-Pair: frequent id
pairs become nonterminals, which may be paired again, until no pair occurs
``LEAST`` times. A round replaces all frequent pairs at once; where two overlap
the more frequent one goes first. Pairs never cross the end of a document, and
the stored expansion lengths lead to the symbols of any stretch of ids, so that
documents and parts of them are expanded alone.

File format (one shard, little-endian):
    magic ``RPR1``, then uint32 counts: documents, rules, symbols, base
    rules     uint32 left, uint32 right each; rule ``i`` is symbol ``base + i``
    lengths   uint32 expansion length of each rule
    ids       int64 document id each; then one byte each, 1 where it is null
    symbols   uint32 first symbol of each document
    starts    uint32 first id of each document within the shard
    payload   symbols as uint24 (uint32 in a shard with 2^24 symbols or more)

Shards travel as rows ``(part, shard, part_start, docs, tokens, blob)`` of a
Parquet table: Spark's committed writes need no file system of their own on the
executors. ``part`` is the range partition, ``part_start`` the ids before the
shard in it; only the sums by ``part`` (one row for each partition) are needed
to give each document its place in the whole.

Defined cases: a null text is empty and so holds the end id alone; null ids
come first; equal ids follow one another in the order of their texts; very long
texts are kept whole, a shard then being longer than its bound by one document;
an empty table gives no shards; whole numbers as ids are 64-bit, others keep their type; further columns
are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, _parse_datatype_string

from pairforge.llm.storage import keep_freed, scratch_path, working

MAGIC = b"RPR1"
#: Columns of the files.
FILE = "part int, shard int, part_start long, docs long, tokens long, blob binary"
#: A shard is closed once it holds so many ids.
SHARD_IDS = 500_000
#: A pair becomes a rule while it occurs so often; most bits of the hash by which pairs are counted.
LEAST = 8
_BUCKET_BITS = 18


def _without_overlaps(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``at`` without the pairs of equal symbols that overlap the one before, so that no pair overlaps itself."""
    twins = np.flatnonzero(left == right)
    if len(twins) < 2:
        return at
    begins = np.ones(len(twins), bool)
    begins[1:] = np.diff(at[twins]) > 1
    order = np.arange(len(twins))
    odd = (order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 1
    return np.delete(at, twins[odd])


def _candidates(left: np.ndarray, right: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a list of pairs: those that occur ``LEAST`` times, the number of each one's pair, its count; and those that surely do not.

    Pairs are counted by hash bucket, and a full bucket stands for the pair seen
    last in it, whose own count then has to do. ``exact`` sorts the pairs
    instead, so that none is overlooked.
    """
    if exact:
        _, number, often = np.unique(left.astype(np.uint64) << np.uint64(32) | right, return_inverse=True, return_counts=True)
        enough = often[number] >= LEAST
        return np.flatnonzero(enough), number[enough], often[number[enough]], ~enough
    bits = min(_BUCKET_BITS, len(left).bit_length())
    bucket = ((left * np.uint32(2654435761)) ^ (right * np.uint32(2246822519))) >> np.uint32(32 - bits)
    rare = (np.bincount(bucket, minlength=1 << bits) < LEAST)[bucket]
    which = np.flatnonzero(~rare)
    bucket = bucket[which]
    pair = left[which].astype(np.uint64) << np.uint64(32) | right[which]
    offered = np.zeros(1 << bits, np.uint64)
    offered[bucket] = pair
    same = offered[bucket] == pair
    counts = np.bincount(bucket[same], minlength=1 << bits)
    enough = same & (counts >= LEAST)[bucket]
    rare[which[same & ~enough]] = True
    bucket = bucket[enough]
    return which[enough], bucket, counts[bucket], rare


def _round(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places to replace, the number of each one's rule, the rules, and the places of ``at`` that never will be.

    Of pairs that overlap the more frequent one is replaced. The most frequent
    pair of all so keeps all of its places, and a round with candidates has a rule.
    """
    at = _without_overlaps(seq[at], seq[at + 1], at)
    left, right = seq[at], seq[at + 1]
    for exact in (False, True):
        which, number, often, rare = _candidates(left, right, exact)
        if len(which):
            break
    else:
        return at[:0], number, np.empty((0, 2), np.uint32), at
    chosen = at[which]
    strength = often * (int(number.max()) + 1) + number  # no two pairs are equal
    beside = np.diff(chosen) == 1
    wins = np.ones(len(chosen), bool)
    wins[1:] &= ~beside | (strength[1:] > strength[:-1])
    wins[:-1] &= ~beside | (strength[:-1] > strength[1:])
    chosen, number = chosen[wins], number[wins]
    enough = np.bincount(number) >= LEAST
    kept = enough[number]
    chosen, number = chosen[kept], number[kept]
    names = np.flatnonzero(enough)
    rule = np.zeros(len(enough), np.int64)
    rule[names] = np.arange(len(names))
    number = rule[number]
    rules = np.empty((len(names), 2), np.uint32)
    rules[number, 0], rules[number, 1] = seq[chosen], seq[chosen + 1]
    return chosen, number, rules, at[rare]


def compress(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair one shard, until no pair occurs ``LEAST`` times.

    ``ends`` marks each document's last id. Returns the symbols, the rules
    (left, right) and the mark of each document's last symbol. A pair's count
    only ever falls, so places of rare pairs are left out of later rounds until
    a new symbol comes beside them.
    """
    seq, last = ids.astype(np.uint32), ends.astype(bool)
    rules: list[np.ndarray] = []
    n_rules = 0
    active = np.ones(len(seq), bool)
    while True:
        active[-1:] = False
        active &= ~last
        at, number, new, rare = _round(seq, np.flatnonzero(active))
        if not len(at):
            return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32), last
        rules.append(new)
        active[rare] = False
        seq[at] = base + n_rules + number
        last[at] = last[at + 1]
        active[at] = True
        active[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        # the new left neighbour of a symbol may itself be one that goes
        active[np.maximum(at - 2, 0)] |= ~keep[np.maximum(at - 1, 0)]
        left = np.flatnonzero(keep)
        seq, last, active = seq.take(left), last.take(left), active.take(left)
        n_rules += len(new)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; a rule's parts are ids or earlier rules."""
    lengths = np.ones(base + len(rules), np.int64)
    while True:  # as often as rules stand within rules
        longer = lengths[rules].sum(1)
        if (longer == lengths[base:]).all():
            return longer
        lengths[base:] = longer


def _expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol below ``base + rules``: place and length in a flat table, and the table."""
    flat = rules.ravel()
    while (inner := flat >= base).any():  # as often as rules stand within rules
        begins = np.cumsum(1 + inner) - 1 - inner
        longer = np.repeat(flat, 1 + inner)
        longer[begins[inner]], longer[begins[inner] + 1] = rules[flat[inner] - base].T
        flat = longer
    lengths = np.concatenate([np.ones(base, np.int64), rule_lengths(rules, base)])
    return np.cumsum(lengths) - lengths, lengths, np.concatenate([np.arange(base, dtype=np.uint32), flat])


def expand(symbols: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids that a run of symbols stands for."""
    where, lengths, table = tables
    n = lengths[symbols]
    out = np.cumsum(n)
    shift = np.repeat(where[symbols] - (out - n), n)
    return table[shift + np.arange(len(shift))]


def _width(symbols: int) -> int:
    """Bytes of a symbol."""
    return 3 if symbols <= 1 << 24 else 4


def _narrowed(symbols: np.ndarray, width: int) -> bytes:
    """The first ``width`` bytes of each symbol; byte by byte, as numpy is slow at copying rows of three."""
    wide, out = symbols.astype("<u4").view(np.uint8).reshape(-1, 4), np.empty((len(symbols), width), np.uint8)
    for i in range(width):
        out[:, i] = wide[:, i]
    return out.tobytes()


def _widened(packed: np.ndarray, width: int) -> np.ndarray:
    """The symbols of ``width`` bytes each."""
    rows = packed.reshape(-1, width)
    wide = np.zeros((len(rows), 4), np.uint8)
    for i in range(width):
        wide[:, i] = rows[:, i]
    return wide.view("<u4").ravel()


def pack(doc_ids: list[int | None], ids: list[np.ndarray], base: int) -> bytes:
    """One shard's bytes; ``ids`` has each document's ids, the end id included."""
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids).astype(np.uint32)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(sizes) - 1] = True
    symbols, rules, last = compress(flat, ends, base)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]).astype("<u4")
    return b"".join(
        [
            MAGIC,
            struct.pack("<4I", len(doc_ids), len(rules), len(symbols), base),
            rules.astype("<u4").tobytes(),
            rule_lengths(rules, base).astype("<u4").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            bytes(x is None for x in doc_ids),
            first.tobytes(),
            (np.cumsum(sizes) - sizes).astype("<u4").tobytes(),
            _narrowed(symbols, _width(base + len(rules))),
        ]
    )


class Shard:
    """Random access to one shard's documents."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, n_rules, n_symbols, base = struct.unpack_from("<4I", blob, 4)
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self._base, self._rules = base, take("<u4", 2 * n_rules).reshape(-1, 2)
        self.rule_lengths = take("<u4", n_rules)
        numbers, missing = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if m else n for n, m in zip(numbers.tolist(), missing.tolist(), strict=True)]
        self._first, self.starts = take("<u4", docs), take("<u4", docs)
        width = _width(base + n_rules)
        self._symbols = _widened(take("u1", width * n_symbols), width)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _symbols_of(self, i: int) -> np.ndarray:
        end = self._first[i + 1] if i + 1 < len(self) else len(self._symbols)
        return self._symbols[self._first[i] : end]

    def _lengths(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for, from the stored lengths."""
        out = np.ones(len(symbols), np.int64)
        rules = symbols >= self._base
        out[rules] = self.rule_lengths[symbols[rules] - self._base]
        return out

    def ids(self, i: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids of the ``i``-th document from ``begin`` to ``end``, all with the end id if these are left out.

        The lengths tell which symbols the stretch begins and ends in; only
        these are expanded, and what lies outside is dropped level by level.
        """
        symbols = self._symbols_of(i)
        while True:
            ends = np.cumsum(self._lengths(symbols))
            stop = int(ends[-1]) if end is None and len(ends) else end or 0
            if stop <= begin or not len(ends):
                return symbols[:0]
            first, beyond = int(np.searchsorted(ends, begin, "right")), int(np.searchsorted(ends, stop, "left")) + 1
            skipped = int(ends[first - 1]) if first else 0
            symbols, begin, end = symbols[first:beyond], begin - skipped, stop - skipped
            inner = symbols >= self._base
            if not inner.any():
                return symbols
            at = np.cumsum(1 + inner) - 1 - inner
            longer = np.repeat(symbols, 1 + inner)
            longer[at[inner]], longer[at[inner] + 1] = self._rules[symbols[inner] - self._base].T
            symbols = longer

    def all_ids(self) -> np.ndarray:
        """The ids of all documents, by one flat table of all expansions."""
        return expand(self._symbols, _expansions(self._rules, self._base))


#: How patterns of this kind end: white space, which looks ahead.
_SPACES = r"|\s+(?!\S)|\s+"


def _grouped(pattern: str) -> str:
    """The same pattern, with the alternatives before its white space as one group.

    The regex engine goes step by step through a pattern that looks ahead, each
    alternative by itself; a group that does not look ahead is matched at once.
    """
    words = pattern.removesuffix(_SPACES)
    if words == pattern or words.endswith("\\"):
        return pattern
    return f"(?:{words}){_SPACES}"


_ENCODERS: dict[int, object] = {}


def _encoder(ranks: bytes, pattern: str):
    """The worker's encoder of a rank file, by the size of that file."""
    import tiktoken

    key = zlib.crc32(ranks)
    if key not in _ENCODERS:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=_grouped(pattern), mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})
    return _ENCODERS[key]


#: White space as the vocabulary's pattern has it, in runs beyond which its regex engine may give up.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


def _encode(encoder, text: str) -> np.ndarray:
    """A text's ids, whatever its runs of white space.

    The pattern takes a run as one piece, without its last character where
    another piece follows; the engine stops at about a million characters, so
    such runs are then cut out and encoded as the pieces that they are.
    """
    try:
        return encoder.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        if not _LONG_SPACE.search(text):
            raise
    found: list[np.ndarray] = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(encoder.special_tokens_set))) + ")", text):
        at = 0
        for run in _LONG_SPACE.finditer(part):
            end = run.end() if run.end() == len(part) else run.end() - 1
            found.append(encoder.encode_to_numpy(part[at : run.start()], allowed_special="all"))
            found.append(np.array(encoder._core_bpe.encode_single_piece(part[run.start() : end].encode()), np.uint32))
            at = end
        found.append(encoder.encode_to_numpy(part[at:], allowed_special="all"))
    return np.concatenate(found)


def write(df: DataFrame, ranks_path: str, pattern: str, path: str | None = None, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> str:
    """Encode every whole text and write the shards; returns their folder.

    ``ranks_path`` is the rank form of the vocabulary; its encoder gives the
    same ids as the tokenizer file at several times the speed.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "token_shards")
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    whole = isinstance(df.schema[doc_id].dataType, IntegralType)
    kind = "bigint" if whole else df.schema[doc_id].dataType.simpleString()
    narrow = df.select(df[doc_id].cast(kind).alias("doc_id"), df[text].alias("text"))
    placed = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("tokenfile", _ENCODERS.clear)
        keep_freed()
        encoder = _encoder(shared.value, pattern)
        base, part = encoder.max_token_value + 1, TaskContext.get().partitionId()
        names: list = []
        ids: list[np.ndarray] = []
        held, before, shard = 0, 0, 0

        def row() -> pa.RecordBatch:
            # ids that are no whole numbers stand beside the blob
            own, beside = (names, {}) if whole else ([None] * len(names), {"doc_ids": [names]})
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "part_start": [before], "docs": [len(names)], "tokens": [held], "blob": [pack(own, ids, base)]} | beside, schema=arrow)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                ids.append(np.append(_encode(encoder, value or ""), np.uint32(end_id)))
                held += len(ids[-1])
                if held >= SHARD_IDS:
                    yield row()
                    before, shard = before + held, shard + 1
                    names, ids, held = [], [], 0
        if names:
            yield row()

    schema = _parse_datatype_string(FILE if whole else f"{FILE}, doc_ids array<{kind}>")
    arrow = to_arrow_schema(schema)
    placed.mapInArrow(shards, schema).write.mode("overwrite").parquet(path)
    return path


def _ids_beside(rows: DataFrame) -> tuple[str, list[str]]:
    """The ids' type, and the column that has them where the blobs do not."""
    if "doc_ids" not in rows.columns:
        return "bigint", []
    return rows.schema["doc_ids"].dataType.elementType.simpleString(), ["doc_ids"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document in the files.

    The offsets of the parts are a running sum over one row for each range
    partition, so their broadcast is bounded by the number of partitions.
    """
    rows = spark.read.parquet(path)
    kind, beside = _ids_beside(rows)
    sums = rows.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    begins = sums.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    placed = rows.join(F.broadcast(begins), "part").select((F.col("base") + F.col("part_start")).alias("start"), "blob", *beside)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (start, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                shard = Shard(blob.as_py())
                flat = shard.all_ids().astype("<u4")
                begins = shard.starts.astype(np.int64)
                sizes = np.diff(np.append(begins, len(flat)))
                view = memoryview(flat).cast("B")
                sums = [zlib.crc32(view[4 * b : 4 * (b + n)]) for b, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
                names = batch.column(2).slice(i, 1).flatten() if beside else pa.array(shard.doc_ids, pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array(start + begins), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(documents, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and ``ids array<long>`` of each document in the files."""

    rows = spark.read.parquet(path)
    kind, beside = _ids_beside(rows)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, blob in enumerate(batch.column(0)):
                shard = Shard(blob.as_py())
                names = batch.column(1).slice(k, 1).flatten() if beside else pa.array(shard.doc_ids, pa.int64())
                for i in range(len(shard)):
                    yield pa.RecordBatch.from_arrays([names.slice(i, 1), pa.array([shard.ids(i).tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return rows.select("blob", *beside).mapInArrow(documents, f"doc_id {kind}, ids array<long>")
