"""Language-model scores from an Elias-Fano n-gram trie.

The model is an interpolated word trigram model with absolute discounting: the shares
of the discounted counts of three orders, each weighed by what the next higher order
leaves over, down to a unigram share with a tenth added to each count. All counts are
over all training tokens; nothing is pruned.

No worker ever needs the whole model. Texts are gathered into blocks of a bounded number of
tokens. A block asks each question once: its distinct words, then its distinct n-grams,
go as packed messages to the shards of a hash of the word, or of the n-gram's context.
They carry how often the block's training texts have them, so one shuffle both counts
and asks. A shard adds up the counts, builds its part of the trie, looks up every
distinct n-gram it was asked for, and answers each block with codes in the order of its
questions. Words get ids that are small for frequent words of their shard. However often
a word or pair occurs, a block sends it once, and shards grow in number with the tokens.

A trie has a level for each word of a context and one for followers.
A level is monotone: each range of siblings is lifted above the range before it; pieces of
some thousand values are Elias-Fano coded (low bits packed, high bits in unary). The
pointers to the ranges are such sequences too. A follower is stored as its rank among
all followers below the context's first word in the shard, which keeps the numbers small, and a query
finds that rank, then searches for it within the range of its context. Probabilities and
left-over weights are quantised to 1/16 of an octave (2.2% at most). All levels lie in one flat
buffer, which is mapped in place: pieces are decoded as a search gets to them.

Defined cases: a null text is empty and has its end only; a null id is not held out;
equal ids are rows of their own; words that no training text has share one unknown word in
contexts; without training texts the unigram share is one for every word; texts of any
length are whole (a block has one text at least); an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count as counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.storage import working, written

#: Tokens of a block; tokens of the corpus for each shard.
BLOCK, SHARD = 1 << 21, 1 << 20
DISCOUNT, ADDED = 0.75, 0.1
#: Values of an Elias-Fano piece; steps of an octave.
PIECE, STEPS = 4096, 16
#: The end of a text; no word has white space in it.
END = b"\n"
#: Ids before those of words: the place before a text, and words without a training token.
BEFORE, UNKNOWN, FIRST = 0, 1, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# -- Elias-Fano levels ---------------------------------------------------------------------------
def _piece(values: np.ndarray) -> tuple[int, bytes]:
    """Width of the low bits, and low and high bits of values from 0 on."""
    n = len(values)
    width = max(0, (int(values[-1]) // n).bit_length() - 1)
    low = np.packbits(((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(bool), axis=None).tobytes()
    high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, bool)
    bits[high] = True
    return width, low + np.packbits(bits).tobytes()


def level(values: np.ndarray) -> bytes:
    """A monotone sequence: a directory of pieces, then the pieces."""
    values = values.astype(np.uint64)
    firsts, offsets, widths, body = values[::PIECE], [0], [], []
    for i, first in enumerate(firsts):
        width, coded = _piece(values[i * PIECE : (i + 1) * PIECE] - first)
        widths.append(width)
        body.append(coded)
        offsets.append(offsets[-1] + len(coded))
    head = [np.array([len(values), len(firsts)], "<u8"), firsts.astype("<u8"), np.array(offsets, "<u8"), np.array(widths, "u1")]
    return b"".join([*(x.tobytes() for x in head), *body])


class Level:
    """A mapped sequence; ``at`` gets values by place and ``find`` places by value."""

    def __init__(self, raw: memoryview):
        self.n, pieces = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        self.firsts = np.frombuffer(raw, "<u8", pieces, 16)
        self.offsets = np.frombuffer(raw, "<u8", pieces + 1, 16 + 8 * pieces).astype(np.int64)
        self.widths = np.frombuffer(raw, "u1", pieces, 24 + 16 * pieces)
        self.body = np.frombuffer(raw, "u1")[24 + 17 * pieces :]

    def piece(self, i: int) -> np.ndarray:
        n, width = min(PIECE, self.n - i * PIECE), int(self.widths[i])
        raw = self.body[self.offsets[i] : self.offsets[i + 1]]
        cut = (n * width + 7) // 8
        values = (np.flatnonzero(np.unpackbits(raw[cut:]))[:n] - np.arange(n)) << width
        if width:
            low = np.unpackbits(raw[:cut], count=n * width).reshape(n, width)
            for k in range(width):
                values |= low[:, k].astype(np.int64) << k
        return values.astype(np.uint64) + self.firsts[i]

    def _each(self, of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, piece) for each piece that queries are for."""
        order = None if (of[1:] >= of[:-1]).all() else np.argsort(of, kind="stable")
        sorted_of = of if order is None else of[order]
        ends = [0, *(np.flatnonzero(np.diff(sorted_of)) + 1).tolist(), len(of)]
        for begin, end in zip(ends, ends[1:], strict=False):
            if end > begin:
                yield slice(begin, end) if order is None else order[begin:end], self.piece(int(sorted_of[begin]))

    def at(self, places: np.ndarray) -> np.ndarray:
        out = np.zeros(len(places), np.uint64)
        for own, values in self._each(places // PIECE):
            out[own] = values[places[own] % PIECE]
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        out = np.full(len(values), -1)
        of = np.searchsorted(self.firsts, values, "right") - 1
        known = np.flatnonzero(of >= 0)
        for some, held in self._each(of[known]):
            own = known[some]
            wanted = values[own]
            at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
            out[own] = np.where(held[at] == wanted, at + int(of[own[0]]) * PIECE, -1)
        return out


def lifted(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ranges of ascending values (from each of ``begins`` on), each lifted above the one before it."""
    last = values[np.append(begins[1:], len(values)) - 1].astype(np.uint64) + np.uint64(1)
    lift = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.uint64)
    return values.astype(np.uint64) + np.repeat(lift, np.diff(np.append(begins, len(values))))


def codes(values: np.ndarray) -> np.ndarray:
    """Numbers up to 1 as steps below it; 0 stands for nothing at all."""
    return (1 + np.clip(np.rint(-STEPS * np.log2(values)), 0, 65534)).astype("<u2")


def values_of(coded: np.ndarray, nothing: float) -> np.ndarray:
    return np.where(coded == 0, nothing, np.exp2(-(coded.astype(float) - 1) / STEPS))


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def trie(root: np.ndarray, middle: np.ndarray, last: np.ndarray, many: np.ndarray, discount: float = DISCOUNT) -> bytes:
    """The trie of distinct n-grams, sorted by all three words, with their counts."""
    roots, contexts = _begins(root), _begins(root, middle)
    total = np.add.reduceat(many, contexts)
    size = np.diff(np.append(contexts, len(last)))
    share = codes((many - discount) / np.repeat(total, size))
    left = codes(discount * size / total)
    # words that follow a root, and each follower's rank among them
    by_root = np.repeat(np.arange(len(roots)), np.diff(np.append(roots, len(root))))
    order = np.lexsort((last, by_root))
    new = _begins(by_root[order], last[order])
    group = np.zeros(len(order), np.int64)
    group[new] = 1
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(group) - 1
    follow_root, follow = by_root[order][new], last[order][new]
    follows = np.searchsorted(follow_root, np.arange(len(roots)))
    parts = [
        level(root[roots]),
        level(np.append(np.searchsorted(contexts, roots), len(contexts))),
        level(lifted(middle[contexts], np.searchsorted(contexts, roots))),
        level(np.append(follows, len(follow))),
        level(lifted(follow, follows)),
        level(np.append(contexts, len(last))),
        level(lifted(place - follows[by_root], contexts)),
        left.tobytes(),
        share.tobytes(),
    ]
    return np.array([len(p) for p in parts], "<u8").tobytes() + b"".join(parts)


class Trie:
    def __init__(self, raw: bytes):
        sizes = np.frombuffer(raw, "<u8", 9).astype(int)
        ends = 72 + np.cumsum(sizes)
        parts = [memoryview(raw)[e - s : e] for s, e in zip(sizes, ends, strict=True)]
        self.roots, self.to_middle, self.middle, self.to_follow, self.follow, self.to_last, self.last = map(Level, parts[:7])
        self.left, self.share = (np.frombuffer(p, "<u2") for p in parts[7:])

    @staticmethod
    def _ranges(level: Level, pointers: Level, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where ranges of siblings begin and end, and by how much they are lifted."""
        begin, end = pointers.at(of).astype(np.int64), pointers.at(of + 1).astype(np.int64)
        return begin, end, np.where(begin > 0, level.at(np.maximum(begin - 1, 0)) + np.uint64(1), np.uint64(0))

    @staticmethod
    def _places(level: Level, begin: np.ndarray, end: np.ndarray, lift: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Places of values within their ranges, or -1."""
        place = level.find(values.astype(np.uint64) + lift)
        return np.where((place >= begin) & (place < end), place, -1)

    def ask(self, root: np.ndarray, middle: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the shares and of the left-over weights; 0 where the n-gram or the context is not there.

        Neighbours of one context share its search.
        """
        share = np.zeros(len(root), "<u2")
        heads = _begins(root, middle)
        size = np.diff(np.append(heads, len(root)))
        at = self.roots.find(root[heads].astype(np.uint64))
        context = np.full(len(heads), -1)
        know = np.flatnonzero(at >= 0)
        context[know] = self._places(self.middle, *self._ranges(self.middle, self.to_middle, at[know]), middle[heads[know]])
        know = np.flatnonzero(context >= 0)
        left = np.zeros(len(heads), "<u2")
        left[know] = self.left[context[know]]
        asked = np.flatnonzero(np.repeat(context >= 0, size))
        of = np.repeat(np.arange(len(know)), size[know])
        begin, end, lift = self._ranges(self.follow, self.to_follow, at[know])
        follow = self._places(self.follow, begin[of], end[of], lift[of], last[asked])
        some = np.flatnonzero(follow >= 0)
        asked, of, rank = asked[some], of[some], follow[some] - begin[of[some]]
        begin, end, lift = self._ranges(self.last, self.to_last, context[know])
        place = self._places(self.last, begin[of], end[of], lift[of], rank)
        share[asked[place >= 0]] = self.share[place[place >= 0]]
        return share, np.repeat(left, size)


# -- packed numbers ------------------------------------------------------------------------------
def pack(values: np.ndarray) -> bytes:
    """32-bit numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b"")


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    if not n:
        return np.zeros(0, "<u4")
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * n, "zstd"), "u1").reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def _steps(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Differences of ascending values; ranges begin anew at ``begins``."""
    out = np.diff(values, prepend=0)
    out[begins] = values[begins]
    return out


def _unsteps(steps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    sums = np.cumsum(steps, dtype=np.uint32)  # modulo 2^32, and so is what is taken off
    return sums - np.repeat(sums[begins] - steps[begins], np.diff(np.append(begins, len(steps))))


def pack_grams(root: np.ndarray, middle: np.ndarray, last: np.ndarray, many: np.ndarray) -> list[bytes]:
    """Sorted n-grams: each root and context once."""
    roots, contexts = _begins(root), _begins(root, middle)
    of_root = np.searchsorted(contexts, roots)
    sizes = [np.diff(np.append(of_root, len(contexts))), np.diff(np.append(contexts, len(last)))]
    columns = [_steps(root[roots], roots[:1]), sizes[0], _steps(middle[contexts], of_root), sizes[1], _steps(last, contexts), many]
    return [pack(c) for c in columns]


def unpack_grams(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    roots, middles, middle, lasts, last, many = map(unpack, raw)
    roots = np.cumsum(roots, dtype=np.uint32)
    middle = _unsteps(middle, np.cumsum(middles, dtype=np.int64) - middles)
    last = _unsteps(last, np.cumsum(lasts, dtype=np.int64) - lasts)
    return np.repeat(np.repeat(roots, middles), lasts), np.repeat(middle, lasts), last, many.astype(np.int64)


# -- blocks --------------------------------------------------------------------------------------
def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def blocks(df: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of whole texts: ids, ends, tokens as places in the block's list of words, and the list with its training counts."""
    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select("doc_id", F.col(f"`{text}`").cast("string").alias("_text")).select("doc_id", "_text", held_out().alias("_held"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("ngrams")
        part, made = TaskContext.get().partitionId() << 32, counter()
        ids: list[pa.Array] = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        index: dict[bytes, int] = {}
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal index, size
            ends = np.cumsum([len(t) for t in tokens])
            joined = np.concatenate(tokens)
            learnt = np.repeat(~np.array(held), np.diff(ends, prepend=0))
            trained = np.bincount(joined[learnt], minlength=len(index))
            columns = [
                pa.array([part + next(made)]), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(ids)), pa.array([held]), pa.array([pack(ends)], pa.binary()),
                pa.array([pack(joined)], pa.binary()), pa.array([len(joined)], pa.int64()), pa.array([int(learnt.sum())], pa.int64()), pa.array([pack_words(index)], pa.binary()), pa.array([pack(trained)], pa.binary()),
            ]
            for x in (ids, held, tokens):
                x.clear()
            index, size = fresh(), 0
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "held", "ends", "tokens", "size", "learnt", "words", "trained"])

        def fresh() -> dict[bytes, int]:
            return defaultdict(counter().__next__)

        index = fresh()
        for batch in batches:
            flags = batch.column(2).to_pylist()
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = (t or "").encode().translate(_LOWER).split()
                words.append(END)
                tokens.append(np.fromiter(map(index.__getitem__, words), "<u4", len(words)))
                ids.append(batch.column(0).slice(i, 1))
                held.append(flags[i])
                size += len(words)
                if size >= block:
                    yield row()
        if held:
            yield row()

    return rows.mapInArrow(mapped, f"block long, doc_id array<{kind}>, held array<boolean>, ends binary, tokens binary, size long, learnt long, words binary, trained binary")


def pack_words(words: Iterable[bytes]) -> bytes:
    """Words that hold no space (the end is other white space)."""
    raw = b" ".join(words)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack_words(raw: bytes) -> list[bytes]:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True).split(b" ")


_MESSAGE = "n int, shard int, block long, body array<binary>"


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("n", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("body", pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[c for c, _ in kinds])


def _split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in order) of each shard that occurs."""
    order = np.argsort(shard, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(shard) else []:
        yield int(shard[own[0]]), own


def word_shards(words: list[bytes], shards: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) % shards for w in words), np.int64, len(words))


def gram_shards(root: np.ndarray, middle: np.ndarray, shards: int) -> np.ndarray:
    x = (root.astype(np.uint64) << np.uint64(32) | middle) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # the splitmix64 finaliser
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x % np.uint64(shards)).astype(np.int64)


def ask_words(made: DataFrame, shards: int) -> DataFrame:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, many = unpack_words(raw), unpack(trained)
                yield _message([(1, s, block, [pack_words(words[i] for i in own.tolist()), pack(many[own]), pack(_steps(own, own[:0]))]) for s, own in _split(word_shards(words, shards))])

    return made.select("block", "words", "trained").mapInArrow(mapped, _MESSAGE)


def answer_words(messages: DataFrame, shards: int) -> DataFrame:
    """Ids and counts of each block's words, with their places in its list; a row without a block has the number of a shard's known words."""

    def answered(key: tuple, table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = defaultdict(int)
        asked = [(block.as_py(), unpack_words(body[0].as_py()), unpack(body[1].as_py()), body[2].as_py()) for block, body in zip(table["block"], table["body"], strict=True)]
        for _, words, many, _ in asked:
            for w, m in zip(words, many.tolist(), strict=True):
                total[w] += m
        shard = key[1].as_py()
        known = sorted((w for w, m in total.items() if m), key=lambda w: (-total[w], w))
        ids = {w: FIRST + i * shards + shard for i, w in enumerate(known)}
        rows = []
        for block, words, _, places in asked:
            sums = np.array([total[w] for w in words])
            rows.append((1, shard, block, [pack(np.array([ids.get(w, UNKNOWN) for w in words])), pack(sums & 0xFFFFFFFF), pack(sums >> 32), places]))
        return pa.Table.from_batches([_message([*rows, (0, shard, -1, [pack(np.array([len(known)]))])])])

    return messages.groupBy("n", "shard").applyInArrow(answered, _MESSAGE)


class Grams:
    """The distinct n-grams of a block and where its tokens have them."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        t = ids[tokens].astype(np.uint64)
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        one = np.roll(t, 1)
        one[first] = BEFORE
        wide, mask = np.uint64(32), np.uint64(0xFFFFFFFF)
        # the pair of places before a text comes first and is no bigram
        pairs, pair = np.unique(np.append(np.uint64(0), one << wide | t), return_inverse=True)
        pair = pair[1:]
        context = np.roll(pair, 1)
        context[first] = 0
        triples, triple = np.unique(context.astype(np.uint64) << wide | t, return_inverse=True)
        own = pairs[(triples >> wide).astype(np.int64)]
        # (root, middle, last): a bigram has no root
        self.of = {
            2: (np.zeros(len(pairs) - 1, np.uint32), (pairs[1:] >> wide).astype(np.uint32), (pairs[1:] & mask).astype(np.uint32)),
            3: ((own >> wide).astype(np.uint32), (own & mask).astype(np.uint32), (triples & mask).astype(np.uint32)),
        }
        self.where = {2: pair - 1, 3: triple}


def _lists(answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of a block's words from the answers to it."""
    bodies = [[unpack(x) for x in r["body"]] for r in answers if r["n"] == 1]
    places = np.concatenate([np.cumsum(b[3], dtype=np.int64) for b in bodies])
    ids, many = np.zeros(len(places), np.uint32), np.zeros(len(places), np.int64)
    ids[places] = np.concatenate([b[0] for b in bodies])
    many[places] = np.concatenate([b[1] + (b[2].astype(np.int64) << 32) for b in bodies])
    return ids, many


#: What both uses of the blocks take: equal exchanges are done once.
_OF_BLOCKS = ("block", "doc_id", "held", "ends", "tokens")


def ask_grams(made: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    def asked(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        working("ngrams")
        raw = block.drop(["doc_id"]).to_pylist()[0]
        ids, _ = _lists(answers.to_pylist())
        ends = unpack(raw["ends"])
        grams = Grams(unpack(raw["tokens"]), ends, ids)
        learnt = np.repeat(~np.array(raw["held"]), np.diff(ends.astype(np.int64), prepend=0))
        rows = []
        for n, (root, middle, last) in grams.of.items():
            many = np.bincount(grams.where[n][learnt], minlength=len(last))
            for s, own in _split(gram_shards(root, middle, shards)):
                rows.append((n, s, raw["block"], pack_grams(root[own], middle[own], last[own], many[own])))
        return pa.Table.from_batches([_message(rows)])

    return made.select(*_OF_BLOCKS).groupBy("block").cogroup(answers.filter("block >= 0").groupBy("block")).applyInArrow(asked, _MESSAGE)


def answer_grams(messages: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """Each shard's trie answers all blocks that asked it."""

    def answered(key: tuple, table: pa.Table) -> pa.Table:
        working("ngrams")
        names = table["block"].to_pylist()
        asked = [unpack_grams(body.as_py()) for body in table["body"]]
        root, middle, last, many = (np.concatenate(c) for c in zip(*asked, strict=True))
        sizes = [len(a[0]) for a in asked]
        del asked
        # each block's n-grams are in order already, which a stable sort makes use of
        if root.any():
            context = root.astype(np.uint64) << np.uint64(32) | middle
            order = np.lexsort((last, context))
            new = _begins(context[order], last[order])
        else:
            gram = middle.astype(np.uint64) << np.uint64(32) | last
            order = np.argsort(gram, kind="stable")
            new = _begins(gram[order])
        group = np.zeros(len(order), np.int64)
        group[new] = 1
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(group) - 1
        root, middle, last = (c[order][new] for c in (root, middle, last))
        total = np.add.reduceat(many[order], new)
        learnt = np.flatnonzero(total)
        share = left = np.zeros(len(last), "<u2")
        if len(learnt):
            share, left = Trie(trie(root[learnt], middle[learnt], last[learnt], total[learnt], discount)).ask(root, middle, last)
        rows, begin = [], 0
        for block, n in zip(names, sizes, strict=True):
            own = inverse[begin : begin + n]
            rows.append((key[0].as_py(), key[1].as_py(), block, [pack(share[own]), pack(left[own])]))
            begin += n
        return pa.Table.from_batches([_message(rows)])

    return messages.groupBy("n", "shard").applyInArrow(answered, _MESSAGE)


def score(df: DataFrame, text: str = "text", block: int = BLOCK, shard: int = SHARD, discount: float = DISCOUNT) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every text."""
    made = written(blocks(df, text, block), "token_blocks")
    size, learnt = made.agg(F.sum("size"), F.sum("learnt")).first()
    shards, learnt = max(1, -(-(size or 0) // shard)), learnt or 0
    answers = written(answer_words(ask_words(made, shards), shards), "word_answers")
    known = sum(int(unpack(r.body[0])[0]) for r in answers.filter("block < 0").select("body").collect())
    replies = answer_grams(ask_grams(made, answers, shards), discount)
    kind = df.schema["doc_id"].dataType.simpleString()
    whole = learnt + ADDED * (known + 1)

    def scored(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        working("ngrams")
        raw, found = block.drop(["doc_id"]).to_pylist()[0], answers.to_pylist()
        ids, many = _lists(found)
        tokens, ends = unpack(raw["tokens"]), unpack(raw["ends"]).astype(np.int64)
        grams = Grams(tokens, ends, ids)
        own = many[tokens]
        uni = (own + ADDED) / whole
        p = uni
        for n in (2, 3):
            root, middle, last = grams.of[n]
            share, left = np.zeros(len(last), "<u2"), np.zeros(len(last), "<u2")
            bodies = {r["shard"]: r["body"] for r in found if r["n"] == n}
            for s, at in _split(gram_shards(root, middle, shards)):
                share[at], left[at] = map(unpack, bodies[s])
            p = (values_of(share, 0.0) + 0.0)[grams.where[n]] + values_of(left, 1.0)[grams.where[n]] * p
        begins = np.concatenate([[0], ends[:-1]])
        columns = [pa.array(np.array(raw["held"], bool)), pa.array(np.diff(ends, prepend=0)), pa.array(np.add.reduceat((own > 0).astype(np.int64), begins)), pa.array(np.full(len(ends), learnt)), *(pa.array(np.add.reduceat(np.log10(x), begins)) for x in (uni, p))]
        return pa.Table.from_arrays([block["doc_id"].combine_chunks().flatten(), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = answers.filter("block >= 0").unionByName(replies)
    return made.select(*_OF_BLOCKS).groupBy("block").cogroup(both.groupBy("block")).applyInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
