"""Media columns: content-defined payload chunking.

A payload is stored as a wave file of 8-bit samples. A rolling gear hash over the
file's bytes sets its cuts, so equal stretches of different files give equal
chunks wherever they stand. Every file is stored as an ordered chunk list: the
digest and length of each chunk, and the digest of the whole. Chunk digests that
occur more than once are found by an aggregation; a bit table of bounded size
tells (with few false alarms and no omissions) which chunks these are. Chunks of
the table are deduplicated by digest into a chunk store that all files share; the
other chunks are a file's own and stand, in order, in a container beside its
list, so they are never shuffled. Reading walks each chunk list, takes chunks
from the container or, by a join on the digest, from the store, and verifies
every chunk and the whole file.

Defined cases: a null text is empty, and an empty payload is 64 zero bytes; very
long texts are stored whole; repeated rows are rows of their own with equal
values; an empty table gives an empty result; other columns are ignored. A chunk
or file that does not match its digest when read stops the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.storage import scratch_path, small, working, written

#: Payloads are filled with zero bytes to a multiple of this; samples a second.
UNIT, RATE = 64, 16_000
#: Chunk bytes: least, average (a power of two, beyond the least), most.
LEAST, AVERAGE, MOST = 256, 1024, 8192
#: Bits of the table of repeated digests: so many for each of them, and at most; bits that one digest sets.
BITS, MOST_BITS, PROBES = 16, 1 << 28, 4
#: The gear table, by rule: a pseudo-random 32-bit number for each byte.
_GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Unpadded length, and the padded payload."""
    raw = (text or "").encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return len(raw), raw + bytes(size - len(raw))


def wave(payload: bytes) -> bytes:
    """A wave file of 8-bit mono samples."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples_of(media: bytes) -> bytes:
    """The samples of a wave file made by :func:`wave`."""
    riff, _, kind, _, _, form, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, kind, form, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(media) != 44 + n:
        raise ValueError("not an 8-bit mono wave file")
    return media[44:]


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks. The gear hash of 16 bytes is built by doubling."""
    hashed = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8):
        rolled = hashed.copy()
        rolled[step:] += hashed[:-step] << np.uint32(step)
        hashed = rolled
    # the top bits of a 16-bit window have been mixed by all of its bytes
    mask = np.uint32((AVERAGE - 1) << 6)
    ends, begin = [], 0
    for at in (np.flatnonzero((hashed & mask) == 0) + 1).tolist():
        while at - begin > MOST:
            begin += MOST
            ends.append(begin)
        if at - begin >= LEAST:
            ends.append(at)
            begin = at
    while len(data) - begin > MOST:
        begin += MOST
        ends.append(begin)
    if begin < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def feature(payload: bytes) -> str:
    """Mean, root mean square about the middle, crossings of it and byte entropy."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float((counts * values).sum()) / len(x)
    rms = float(np.sqrt((counts * (values - 128.0) ** 2).sum() / len(x)))
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    entropy = float(-(share * np.log2(share)).sum())
    return f"mean={mean:.4f};rms={rms:.4f};crossings={crossings};entropy={abs(entropy):.4f}"


def _digests(df: DataFrame, text: str) -> DataFrame:
    """(digest, n): the chunks of all files, added up within a few hundred rows."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("media")
        for batch in small(batches):
            counts: Counter[bytes] = Counter()
            for t in batch.column(0).to_pylist():
                counts.update(digest(c) for c in chunks(wave(payload_of(t)[1])))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    return df.select(F.col(text)).mapInArrow(mapped, "digest binary, n long")


def _repeated(digests: DataFrame) -> bytes:
    """The bit table of repeated digests: ``BITS`` bits for each, 32 MB at most."""
    seen = written(digests.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest"), "repeated")
    slots = min(MOST_BITS, 1 << max(16, (BITS * seen.count()).bit_length()))
    places = F.array(*[F.pmod(F.conv(F.hex(F.substring("digest", 1 + 4 * k, 4)), 16, 10).cast("long"), F.lit(slots)) for k in range(PROBES)])
    words = seen.select(F.explode(places).alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    table = np.zeros(slots // 64, np.int64)
    for batch in words.toArrow().to_batches():
        table[np.asarray(batch.column(0))] = np.asarray(batch.column(1))
    return table.astype("<i8").tobytes()


def _in_store(table: np.ndarray, digests: bytes) -> np.ndarray:
    """Which of a chunk list's digests are in the bit table, and so in the chunk store."""
    at = np.frombuffer(digests, ">u4").reshape(-1, PROBES).astype(np.int64) % (8 * len(table))
    return (table[at >> 3] >> (at & 7) & 1).all(1)


_FILES = "file long, n_bytes long, whole binary, digests binary, lengths binary, own binary, stored int"


def store(df: DataFrame, path: str | None = None, text: str = "text") -> str:
    """Write the files' chunk lists with their own chunks, and the chunk store; returns their folder."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "media")
    kind = df.schema["doc_id"].dataType.simpleString()
    docs = df.select("doc_id", F.col(text))
    shared = spark.sparkContext.broadcast(_repeated(_digests(docs, text)))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("media")
        table, coder = np.frombuffer(shared.value, np.uint8), zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 40
        for batch in small(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                n, payload = payload_of(t)
                media = wave(payload)
                pieces = chunks(media)
                listed = b"".join(map(digest, pieces))
                kept = _in_store(table, listed)
                own = b"".join([c for c, k in zip(pieces, kept.tolist(), strict=True) if not k])
                lengths = np.array([len(c) for c in pieces], "<u4").tobytes()
                rows.append((number, n, hashlib.sha256(media).digest(), listed, lengths, coder.compress(own) if own else b"", int(kept.sum())))
                number += 1
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]], names=["doc_id", *_LISTED])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("media")
        table, coder = np.frombuffer(shared.value, np.uint8), zstandard.ZstdCompressor(level=3)
        for batch in small(batches):
            found: dict[bytes, bytes] = {}
            for t in batch.column(1).to_pylist():
                pieces = chunks(wave(payload_of(t)[1]))
                named = list(map(digest, pieces))
                kept = _in_store(table, b"".join(named)).tolist()
                found.update((d, coder.compress(c)) for d, c, k in zip(named, pieces, kept, strict=True) if k and d not in found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "body"])

    # a store of two tables; both writes are committed whole or not at all
    docs.mapInArrow(files, f"doc_id {kind}, {_FILES}").write.mode("overwrite").options(**_AS_IS).parquet(f"{path}/files")
    docs.mapInArrow(parts, "digest binary, body binary").groupBy("digest").agg(F.first("body").alias("body")).write.mode("overwrite").options(**_AS_IS).parquet(f"{path}/chunks")
    return path


def rebuilt(digests: bytes, lengths: bytes, own: bytes, bodies: dict[int, bytes]) -> bytes:
    """A file from its chunk list: the chunks at the places of ``bodies`` are from the store, the others its own, one after another."""
    pieces, at = [], 0
    for i, n in enumerate(np.frombuffer(lengths, "<u4").tolist()):
        chunk = bodies.get(i)
        if chunk is None:
            chunk, at = own[at : at + n], at + n
        if digest(chunk) != digests[16 * i : 16 * i + 16]:
            raise ValueError("a stored chunk does not match its digest")
        pieces.append(chunk)
    return b"".join(pieces)


def _read_back(doc_ids: pa.Array, sizes: pa.Array, whole: list[bytes], files: Iterator[bytes]) -> pa.RecordBatch:
    out: list[tuple] = []
    for expected, media in zip(whole, files, strict=True):
        found = hashlib.sha256(media)
        if found.digest() != expected:
            raise ValueError("a stored file does not match its digest")
        payload = samples_of(media)
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), found.hexdigest(), feature(payload)))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([doc_ids, sizes, *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]], names=["doc_id", "n_bytes", *_FEATURES])


#: Bodies are compressed already; small row groups keep a writer's memory low.
_AS_IS = {"compression": "none", "parquet.block.size": str(16 << 20)}
_FEATURES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_LISTED = ("file", "n_bytes", "whole", "digests", "lengths", "own", "stored")


def read(spark, path: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` and what is computed from each stored file's bytes."""
    files = spark.read.parquet(f"{path}/files")
    kind = files.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def from_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("media")
        coder = zstandard.ZstdDecompressor()

        def file(digests: pa.Scalar, lengths: pa.Scalar, own: pa.Scalar, parts: pa.Scalar | None) -> bytes:
            bodies = {p["pos"]: coder.decompress(p["body"]) for p in (parts.as_py() if parts is not None else ())}
            return rebuilt(digests.as_py(), lengths.as_py(), coder.decompress(own.as_py()) if len(own.as_py()) else b"", bodies)

        for batch in small(batches):
            more = batch.column(6) if batch.num_columns > 6 else [None] * batch.num_rows
            yield _read_back(batch.column(0), batch.column(1), batch.column(2).to_pylist(), map(file, batch.column(3), batch.column(4), batch.column(5), more))

    alone = files.filter("stored = 0").select("doc_id", "n_bytes", "whole", "digests", "lengths", "own")
    # a file with a shared chunk looks up its whole list: its own chunks are not in the store and find nothing
    mixed = files.filter("stored > 0")
    places = F.expr("transform(sequence(0, cast(length(lengths) / 4 as int) - 1), i -> struct(i as pos, substring(digests, 16 * i + 1, 16) as digest))")
    refs = mixed.select("file", F.explode(places).alias("p")).select("file", "p.pos", "p.digest")
    bodies = refs.join(spark.read.parquet(f"{path}/chunks"), "digest").groupBy("file").agg(F.collect_list(F.struct("pos", "body")).alias("parts"))
    joined = mixed.join(bodies, "file").select("doc_id", "n_bytes", "whole", "digests", "lengths", "own", "parts")
    return alone.mapInArrow(from_lists, result).union(joined.mapInArrow(from_lists, result))
