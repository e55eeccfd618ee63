"""Parts of speech from a tagged table, and the syntax metrics of a text.

A hidden Markov tagger of the first order: transitions between tags, emissions of known
words, and for words that the table does not have the tags of their endings, the longest
known ending weighed most. All of it is counts, summed by Spark; the driver gets
the counts of tag pairs and endings, of fixed number for a language, and of the most frequent
``LEXICON`` words (others count as unknown words do). Sentences are decoded by Viterbi's
algorithm in Arrow batches.

The syntax metrics need no tree: noun phrases are runs of determiners, adjectives,
numbers and nouns that end in a noun; verbs with another word in their sentence are verb
phrases; adpositions are prepositional phrases.

Tags are the universal ones (NOUN, VERB ...), as far as the table has them. Null texts and
texts without a token have zeros; ties go to the tag that is first by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, MapType, StringType, StructField, StructType

TOKEN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[^\w\s]|_")
ENDS = frozenset(".!?")
#: Words with counts of their own; letters of the longest ending; smoothing of transitions and of unknown tags.
LEXICON, ENDING, ADDED, FLOOR = 500_000, 4, 0.1, 1e-6
#: Texts whose sentences are decoded together; words a task keeps the emissions of; sentences from which a step goes tag by tag.
TOGETHER, KEPT, MANY = 512, 400_000, 48
PHRASE = frozenset(("DET", "ADJ", "NUM", "NOUN", "PROPN"))
NOUNS = frozenset(("NOUN", "PROPN"))


def shape(word: str) -> str:
    """Whether a word has a digit, or else begins with a capital."""
    return "#" if not word.isalpha() and any(c.isdigit() for c in word) else "^" if word[:1].isupper() else ""


def endings(word: str) -> list[str]:
    """A word's endings, the longest first, by its shape."""
    of = shape(word)
    return [f"{of}~{word[-k:].lower()}" for k in range(min(ENDING, len(word)), 0, -1)] + [f"{of}~"]


@dataclass
class Tagger:
    tags: list[str]
    start: np.ndarray
    """(tags) and, below, (tags, tags) log-probabilities."""
    moves: np.ndarray
    share: np.ndarray
    """(tags) log-shares."""
    words: dict[str, np.ndarray] = field(repr=False)
    ends: dict[str, np.ndarray] = field(repr=False)
    """Counts of tags by word and by ending."""
    totals: np.ndarray
    _met: dict[tuple[str, str], np.ndarray] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_met": {}}

    def emission(self, word: str) -> np.ndarray:
        """Log-likelihood of a word for each tag, up to a constant."""
        known = self.words.get(word.lower())
        if known is not None:
            return np.log(np.maximum(known / self.totals, FLOOR / self.totals))
        if "PUNCT" in self.tags and not word.isalnum() and not any(c.isalnum() for c in word):  # signs that the table does not have
            return np.where(np.array(self.tags) == "PUNCT", 0.0, np.log(FLOOR)) - self.share
        key = (shape(word), word[-ENDING:])  # all that its endings depend on
        got = self._met.get(key)
        if got is None:
            if len(self._met) > KEPT:
                self._met.clear()
            got = self._met[key] = self._by_ending(word)
        return got

    def _by_ending(self, word: str) -> np.ndarray:
        chance = np.exp(self.share)
        for ending in reversed(endings(word)):
            counts = self.ends.get(ending)
            if counts is not None:
                chance = (counts + 2 * chance) / (counts.sum() + 2)
        return np.log(np.maximum(chance, FLOOR)) - self.share

    def decode(self, words: Sequence[str]) -> list[str]:
        """The most probable tags."""
        return self.decode_all([words])[0]

    def decode_all(self, sentences: Sequence[Sequence[str]]) -> list[list[str]]:
        """The most probable tags of each sentence."""
        if not self.tags:
            return [["X"] * len(s) for s in sentences]
        met = Met(self)
        lengths = np.array([len(s) for s in sentences], np.int64)
        ids = met.numbers([w for s in sentences for w in s])
        path = self.paths(met.each[ids], lengths)
        names = [self.tags[t] for t in path]
        ends = np.cumsum(lengths)
        return [names[e - n : e] for e, n in zip(ends, lengths, strict=True)]

    def paths(self, each: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The most probable tag of every token, by number; ``each`` has the tokens' emissions, sentence behind sentence.

        All sentences go through Viterbi's steps together, the longest first, so that those still going on are the first rows.
        """
        n = len(self.tags)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        steps = int(lengths[0]) if len(lengths) else 0
        # how many sentences have a token at a step
        going = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), "right")
        back, last = np.zeros((len(each), n), np.int16), np.zeros((len(lengths), n))
        if steps:
            last[: going[0]] = self.start + each[begins[: going[0]]]
        for k in range(1, steps):
            m = going[k]
            best, at = last[:m], begins[:m] + k
            if m < MANY:
                reached = best[:, :, None] + self.moves
                back[at], most = reached.argmax(1), reached.max(1)
            else:
                most, source = best[:, :1] + self.moves[0], np.zeros((m, n), np.int16)
                for a in range(1, n):
                    other = best[:, a : a + 1] + self.moves[a]
                    source[other > most] = a
                    np.maximum(most, other, out=most)
                back[at] = source
            last[:m] = most + each[at]
        out, tag = np.zeros(len(each), np.int64), last.argmax(1)
        for k in range(steps - 1, -1, -1):
            m = going[k]
            at = begins[:m] + k
            out[at] = tag[:m]
            if k:
                tag[:m] = back[at, tag[:m]]
        return out


class Met:
    """The words that a task has met, numbered, with what the steps need of each."""

    def __init__(self, tagger: Tagger):
        self.tagger, self.at = tagger, {}
        self.each, self.solid, self.ends = np.zeros((0, len(tagger.tags))), np.zeros(0, bool), np.zeros(0, bool)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in tokens if w not in self.at))
        if len(self.at) + len(new) > KEPT and self.at:
            self.__init__(self.tagger)
            return self.numbers(tokens)
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            if self.tagger.tags:
                self.each = np.concatenate([self.each, [self.tagger.emission(w) for w in new]])
            self.solid = np.concatenate([self.solid, [w[0].isalnum() for w in new]])
            self.ends = np.concatenate([self.ends, [w in ENDS for w in new]])
        return np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))


def fit(tagged: DataFrame, tokens: str = "tokens", tags: str = "tags", lexicon: int = LEXICON) -> Tagger:
    """A tagger from rows of parallel arrays of tokens and tags."""
    rows = tagged.select(F.filter(F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t")), lambda x: x["w"].isNotNull() & x["t"].isNotNull()).alias("s")).filter("size(s) > 0")
    names = sorted(r.t for r in rows.select(F.explode("s.t").alias("t")).distinct().collect())
    at = {t: i for i, t in enumerate(names)}
    n = len(names)
    pairs = rows.select(F.explode(F.transform("s", lambda x, i: F.struct(F.when(i > 0, F.get("s", i - 1)["t"]).alias("a"), x["t"].alias("b")))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    start, moves = np.zeros(n), np.zeros((n, n))
    for r in pairs.collect():
        if r.a is None:
            start[at[r.b]] += r.n
        else:
            moves[at[r.a], at[r.b]] += r.n
    each = rows.select(F.explode("s").alias("x")).select("x.w", "x.t")
    word = F.lower("w").alias("w")
    counted = each.groupBy(word, "t").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.groupBy("w").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "w").limit(lexicon).select("w")
    words: dict[str, np.ndarray] = {}
    totals = np.zeros(n)
    for r in counted.groupBy("t").agg(F.sum("n").alias("n")).collect():
        totals[at[r.t]] = r.n
    for r in counted.join(frequent, "w").collect():
        words.setdefault(r.w, np.zeros(n))[at[r.t]] += r.n
    ends: dict[str, np.ndarray] = {}
    shape = F.when(F.col("w").rlike(r"\p{N}"), "#").when(F.col("w").rlike(r"^\p{Lu}"), "^").otherwise("")
    lengths = F.sequence(F.lit(0), F.least(F.length("w"), F.lit(ENDING)))
    by_ending = each.select("t", F.explode(F.transform(lengths, lambda k: F.concat(shape, F.lit("~"), F.lower(F.substring(F.col("w"), F.length("w") - k + 1, k))))).alias("e"))
    for r in by_ending.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n")).collect():
        ends.setdefault(r.e, np.zeros(n))[at[r.t]] += r.n
    with np.errstate(divide="ignore"):
        return Tagger(
            names, np.log((start + ADDED) / (start.sum() + ADDED * n)), np.log((moves + ADDED) / (moves.sum(1, keepdims=True) + ADDED * n)), np.log(np.maximum(totals / max(totals.sum(), 1), FLOOR)), words, ends, np.maximum(totals, 1)
        )


_METRICS = ("before_verb", "constituents_per_word", "subordinate", "coordinate")
_ADDED = [StructField("tags", MapType(StringType(), LongType())), StructField("phrases", ArrayType(StringType())), StructField("sentences", LongType()), *(StructField(c, DoubleType()) for c in _METRICS)]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts; an empty part has 0."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])])


def _described(texts: list[str | None], met: Met) -> list[pa.Array]:
    """The added columns of some texts."""
    tagger = met.tagger
    names = tagger.tags or ["X"]
    listed = [TOKEN.findall(t or "") for t in texts]
    tokens = [w for words in listed for w in words]
    ids = met.numbers(tokens)
    size = np.array([len(words) for words in listed], np.int64)
    # a sentence ends behind its sign, and with its text
    closing = met.ends[ids]
    closing[np.cumsum(size)[size > 0] - 1] = True
    ends = np.flatnonzero(closing) + 1
    lengths = np.diff(ends, prepend=0)
    begins = ends - lengths
    per_text = _sums(closing, np.cumsum(size))
    of_text = np.cumsum(per_text)  # the sentences before the end of each text
    tags = tagger.paths(met.each[ids], lengths) if tagger.tags else np.zeros(len(ids), np.int64)

    def is_any(*wanted: str) -> np.ndarray:
        return np.array([t in wanted for t in names])[tags]

    solid = met.solid[ids] & ~is_any("PUNCT")
    verb = is_any("VERB")
    words = _sums(solid, ends)
    # solid words before the first verb of each sentence
    at = np.arange(len(ids))
    first = np.minimum.reduceat(np.where(solid & verb, at, len(ids)), begins) if len(ends) else at
    so_far = np.concatenate([[0], np.cumsum(solid)])
    before = so_far[np.where(first < len(ids), first, ends)] - so_far[begins]
    # runs of phrase tags up to their last noun
    inside = np.flatnonzero(is_any(*PHRASE))
    opening = np.zeros(len(ids), bool)
    opening[begins] = True
    fresh = np.flatnonzero(opening[inside] | (np.diff(inside, prepend=-2) != 1))
    noun = np.maximum.reduceat(np.where(is_any(*NOUNS)[inside], inside, -1), fresh) if len(inside) else inside
    begin, end = inside[fresh][noun >= 0], noun[noun >= 0] + 1
    text_of = np.repeat(np.arange(len(texts)), size)
    found = np.bincount(text_of[begin], minlength=len(texts))
    constituents = np.bincount(text_of[begin[end - begin > 1]], minlength=len(texts)) + _sums(is_any("ADP"), np.cumsum(size)) + _sums(np.where(words > 1, _sums(verb, ends), 0), of_text)
    total, n = _sums(words, of_text), np.maximum(per_text, 1)
    counts = np.bincount(text_of * len(names) + tags, minlength=len(texts) * len(names)).reshape(len(texts), len(names))
    which, tag = np.nonzero(counts)

    def offsets(sizes: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

    return [
        pa.MapArray.from_arrays(offsets((counts > 0).sum(1)), pa.array([names[t] for t in tag], pa.string()), pa.array(counts[which, tag].astype(np.int64))),
        pa.ListArray.from_arrays(offsets(found), pa.array([" ".join(tokens[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)], pa.string())),
        pa.array(per_text.astype(np.int64)),
        pa.array(_sums(before, of_text) / n),
        pa.array(np.where(total > 0, constituents / np.maximum(total, 1), 0.0)),
        *[pa.array(_sums(is_any(t), np.cumsum(size)) / n) for t in ("SCONJ", "CCONJ")],
    ]


def syntax(df: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """Add the counts of each tag, the noun phrases, the number of sentences and the four metrics of a text."""
    kept = df.drop(*[f.name for f in _ADDED])
    at = kept.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Met(shared.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(begin, TOGETHER)
                yield pa.RecordBatch.from_arrays([*batch.columns, *_described(batch.column(at).to_pylist(), met)], names=[*batch.schema.names, *[f.name for f in _ADDED]])

    return kept.mapInArrow(mapped, StructType([*kept.schema.fields, *_ADDED]))
