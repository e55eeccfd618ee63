"""Byte-level BPE by prefix-sharing trie traversal.

Distinct words form a trie over their bytes, kept as the sorted list of words.
A depth-first walk gives every node its *last-token state*: the last token of
the encoding of the prefix that ends there. That token is the one suffix of the
prefix that is a vocabulary token and may follow the state found at the place
where the suffix begins, so each node costs a few look-ups and words with a
common prefix share all of its states. A word's ids are read off by stepping
back from its end node, token by token.

Whether token ``b`` may follow token ``a`` is decided by undoing the merges of
the two tokens from the latest to the earliest: the pair is stable unless some
merge across the boundary would have come first.

Defined cases: a null text is encoded as the empty text (no ids); very long
texts are encoded whole; repeated rows are encoded alike; an empty table gives
an empty table; columns other than the id and text columns are ignored, so
clashing names do no harm. Special tokens of the tokenizer file that occur in a
text become their ids, as in the file's own library.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairforge.llm.storage import working

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts are handled in slices of about so many characters, which bounds a trie.
SLICE_CHARS = 4_500_000
#: Each of the two generations of a worker's chunk cache holds so many entries.
CACHE_CHUNKS = 180_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in byte order.
    """
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for one tokenizer file, given as its JSON text."""

    def __init__(self, spec: str | bytes):
        data = json.loads(spec)
        model = data["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        self.token_of: dict[bytes, int] = {}
        size = 1 + max([*vocab.values(), *(t["id"] for t in data.get("added_tokens", []))])
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            raw = bytes(letters[c] for c in word)
            self.token_of[raw] = i
            self.bytes_of[i] = raw
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for word, i in self.special.items():
            self.bytes_of[i] = word.encode()
            self.token_of.pop(word.encode(), None)
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merge_rank[a, b] = rank
            self.parts.setdefault(c, (a, b, rank))
        self._lengths = [len(x) for x in self.bytes_of]
        self._begins = {x[:i] for x in self.token_of for i in range(len(x) + 1)}
        self._state_of, self._suffix = {b"": 0}, [b""]
        self._goto: list[dict[int, int]] = [{}]
        self._ends: list[tuple[tuple[int, int], ...]] = [()]
        self._pair: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._words = regex.compile(WORDS)
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._young: dict[str | bytes, bytes | None] = {}
        self._old: dict[str | bytes, bytes | None] = {}

    # -- stable pairs ------------------------------------------------------
    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._pair.get(key)
        if known is None:
            if len(self._pair) > 300_000:
                self._pair.clear()
            known = self._pair[key] = self._stable(a, b)
        return known

    def _stable(self, a: int, b: int) -> bool:
        rank, parts = self.merge_rank, self.parts
        limit, from_left = len(rank) + 1, True
        while True:
            across = rank.get((a, b))
            # At equal rank the merge further left comes first.
            if across is not None and (across < limit or across == limit and not from_left):
                return False
            pa_, pb = parts.get(a), parts.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or pa_ is not None and pa_[2] > pb[2]:
                limit, from_left, a = pa_[2], True, pa_[1]
            else:
                limit, from_left, b = pb[2], False, pb[0]

    def is_whole(self, t: int) -> bool:
        """Whether the token's own bytes are encoded as that single token."""
        known = self._whole.get(t)
        if known is None:
            parts = self.parts.get(t)
            known = self._whole[t] = parts is None or (self.is_whole(parts[0]) and self.is_whole(parts[1]) and self._joins(parts))
        return known

    def _joins(self, parts: tuple[int, int, int]) -> bool:
        """Whether the two halves meet unmerged until the merge that joins them."""
        a, b, final = parts
        rank, tree = self.merge_rank, self.parts
        limit, from_left = final, True
        while True:
            pa_, pb = tree.get(a), tree.get(b)
            if pa_ is None and pb is None:
                return True
            if pb is None or pa_ is not None and pa_[2] > pb[2]:
                limit, from_left, a = pa_[2], True, pa_[1]
            else:
                limit, from_left, b = pb[2], False, pb[0]
            across = rank.get((a, b))
            if across is not None and (across < limit or across == limit and not from_left):
                return False

    # -- the trie ----------------------------------------------------------
    def _step(self, state: int, byte: int) -> int:
        """The state for the longest suffix that begins some token, one byte on.

        States are made when they are first reached; ``_ends[state]`` lists the
        tokens (with their lengths) that are suffixes there, longest first.
        """
        suffix = self._suffix[state] + bytes((byte,))
        while suffix not in self._begins:
            suffix = suffix[1:]
        to = self._state_of.get(suffix)
        if to is None:
            to = self._state_of[suffix] = len(self._suffix)
            self._suffix.append(suffix)
            self._goto.append({})
            tokens = ((self.token_of.get(suffix[i:]), len(suffix) - i) for i in range(len(suffix)))
            self._ends.append(tuple((t, n) for t, n in tokens if t is not None))
        self._goto[state][byte] = to
        return to

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as little-endian unsigned 32-bit integers.

        Sorted words are their trie in depth-first order: going from one word
        to the next goes back to the node of their common prefix, whose states
        are kept, and down again.
        """
        found: dict[str, bytes] = {}
        path, deep = b"", 0
        last, state = [-1], [0]
        goto, ends, pairs, lengths = self._goto, self._ends, self._pair, self._lengths
        for raw, word in sorted([(w.encode(), w) for w in words]):
            depth, deep = 0, min(deep, len(raw))
            while depth < deep and raw[depth] == path[depth]:
                depth += 1
            del last[depth + 1 :], state[depth + 1 :]
            at = state[depth]
            for byte in raw[depth:]:
                depth += 1
                to = goto[at].get(byte)
                at = self._step(at, byte) if to is None else to
                state.append(at)
                for token, n in ends[at]:
                    before = last[depth - n]
                    if before < 0:
                        if self.is_whole(token):
                            break
                    else:
                        stable = pairs.get(before << 20 | token)
                        if self.may_follow(before, token) if stable is None else stable:
                            break
                else:
                    raise ValueError(f"no encoding of {raw!r}")
                last.append(token)
            path, deep = raw, depth
            ids = []
            while depth:
                token = last[depth]
                ids.append(token)
                depth -= lengths[token]
            ids.reverse()
            packed = array("I", ids)
            if sys.byteorder == "big":
                packed.byteswap()
            found[word] = packed.tobytes()
        return found

    # -- texts -------------------------------------------------------------
    def encode_texts(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text, packed; the texts are handled in bounded slices."""
        out: list[bytes] = []
        begin, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text or "")
            if chars >= SLICE_CHARS or i == len(texts) - 1:
                out += self._encode_slice([t or "" for t in texts[begin : i + 1]])
                begin, chars = i + 1, 0
        return out

    def _encode_slice(self, texts: list[str]) -> list[bytes]:
        # No word spans the place before a space that follows a non-space, so
        # a text may be cut there; the chunk at the start has no space and so
        # has a key of another type.
        cut = []
        for text in texts:
            chunks = text.split(" ")
            chunks[0] = chunks[0].encode()
            cut.append(chunks)
        self._learn(set().union(*cut))
        known, out = self._young, []
        for text, chunks in zip(texts, cut, strict=True):
            if any(name in text for name in self.special):
                out.append(self._encode_apart(text))
                continue
            try:
                out.append(b"".join(map(known.__getitem__, chunks)))
            except TypeError:  # a chunk that a longer run of white space may cross
                out.append(self._encode_whole(text))
        return out

    def _learn(self, chunks: set[str | bytes]) -> None:
        if len(self._young) > CACHE_CHUNKS:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        fresh = chunks.difference(young)
        for chunk in fresh.intersection(old):
            young[chunk] = old[chunk]
        fresh.difference_update(old)
        plain, new = [], {}
        for chunk in fresh:
            if isinstance(chunk, bytes):
                text = chunk.decode()
                if text[-1:].isspace():
                    young[chunk] = None
                else:
                    new[chunk] = self._words.findall(text)
            elif chunk.isalpha():
                plain.append(chunk)
            elif not chunk or chunk[-1].isspace():
                young[chunk] = None
            else:
                new[chunk] = self._words.findall(" " + chunk)
        words = {" " + chunk for chunk in plain}
        words.update(*new.values())
        ids = self.encode_words(words)
        for chunk in plain:
            young[chunk] = ids[" " + chunk]
        for chunk, parts in new.items():
            young[chunk] = b"".join([ids[w] for w in parts])

    def _encode_whole(self, text: str) -> bytes:
        words = self._words.findall(text)
        ids = self.encode_words(set(words))
        return b"".join([ids[w] for w in words])

    def _encode_apart(self, text: str) -> bytes:
        out = []
        for part in self._split.split(text):
            out.append(struct.pack("<I", self.special[part]) if part in self.special else self._encode_whole(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included."""
        tokens = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, tokens)).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(spec: bytes) -> Bpe:
    """The encoder of a worker; its caches last as long as the worker does."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def read_spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about a slice of bytes: larger slices repeat fewer words."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.columns[-1].nbytes
        if size >= SLICE_CHARS:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _run(df: DataFrame, spec: bytes, keep: Sequence[str], source: str, added: list[T.StructField], work) -> DataFrame:
    """Map (kept columns, source column) through ``work(bpe, values) -> arrays``.

    The tokenizer file travels as a broadcast: its size is that of a vocabulary.
    """
    shared = df.sparkSession.sparkContext.broadcast(spec)
    narrow = df.select(*keep, df[source].alias("__source"))
    kept = narrow.drop("__source")
    schema = T.StructType([*kept.schema.fields, *added])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("bpe", _LOADED.clear)
        bpe = loaded(shared.value)
        for batch in _grouped(batches):
            values = batch.column(batch.num_columns - 1).to_pylist()
            arrays = work(bpe, values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    return narrow.mapInArrow(mapped, schema)


def _n_tokens(ids: list[bytes]) -> pa.Array:
    return pa.array([len(x) // 4 for x in ids], pa.int64())


def encode(df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` and ``ids`` (packed little-endian uint32) of every whole text."""

    def work(bpe: Bpe, texts: list[str | None]) -> list[pa.Array]:
        ids = bpe.encode_texts(texts)
        return [_n_tokens(ids), pa.array(ids, pa.binary())]

    return _run(df, read_spec(path), keep, text, [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())], work)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the text of packed ids (null: empty)."""

    def work(bpe: Bpe, packed: list[bytes | None]) -> list[pa.Array]:
        return [pa.array([bpe.decode(x or b"") for x in packed], pa.string())]

    return _run(df, read_spec(path), keep, ids, [T.StructField("decoded", T.StringType())], work)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """:func:`encode` and :func:`decode` of its ids in one pass: ``n_tokens``, ``ids``, ``decoded``."""

    def work(bpe: Bpe, texts: list[str | None]) -> list[pa.Array]:
        ids = bpe.encode_texts(texts)
        return [_n_tokens(ids), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
    return _run(df, read_spec(path), keep, text, added, work)
