"""Full-text search by a positional inverted index.

The index is a table of postings: a term, a row's key and the places of the term
in the row's text. It is made in one pass, ordered by term and key over as many
partitions as the data needs (a frequent term takes several), and written, so a
search reads the postings of its own terms alone. A search is one merge: the postings
of its terms come together by key, and the whole expression is an expression over each
key's lists of places.

Expressions: words, ``"phrases"`` (also ``a + b``), ``prefix*``, ``^first``, ``NEAR(a "b c", n)``, brackets, and
``NOT``, ``AND`` (or nothing) and ``OR``, binding in this order. A term is a run of letters, marks and digits
in small letters; accents count. In NEAR at most ``n`` (10) terms lie between the end
of the first phrase and the beginning of the last.

Rows without a key or text are not found; keys should be unique, as a key is what is found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.session import written

TERM = re.compile(r"[^\W_]+")
NEAR = 10
_TOKEN = re.compile(r'\s*(?:(NEAR)\s*\(|(AND|OR|NOT)\b|([()+,^])|"((?:[^"]|"")*)"|([^\s()"+,^*]+))(\s*\*)?', re.S)


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class SearchError(ValueError):
    """An expression that cannot be read."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Both:
    """``kind``: and, or, not."""

    kind: str
    left: object
    right: object


class _Reader:
    def __init__(self, text: str):
        self.toks, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise SearchError(f"cannot read {text[at:].strip()[:20]!r}")
            near, word, sign, quoted, bare, star = m.groups()
            kind = "near" if near else word.lower() if word else sign or "text"
            if star and kind != "text":
                raise SearchError("* stands behind a word")
            self.toks.append((kind, quoted.replace('""', '"') if quoted is not None else bare, bool(star)))
            at = m.end()
        self.i = 0

    def kind(self) -> str | None:
        return self.toks[self.i][0] if self.i < len(self.toks) else None

    def take(self, kind: str) -> bool:
        if self.kind() == kind:
            self.i += 1
            return True
        return False

    def whole(self):
        found = self.either()
        if self.kind():
            raise SearchError(f"unexpected {self.kind()}")
        return found

    def either(self):
        left = self.all()
        while self.take("or"):
            left = Both("or", left, self.all())
        return left

    def all(self):
        left = self.without()
        while self.take("and") or self.kind() in ("text", "near", "(", "^"):
            left = Both("and", left, self.without())
        return left

    def without(self):
        left = self.one()
        while self.take("not"):
            left = Both("not", left, self.one())
        return left

    def one(self):
        if self.take("("):
            found = self.either()
            if not self.take(")"):
                raise SearchError("a bracket is open")
            return found
        if self.take("near"):
            phrases, distance = [], NEAR
            while self.kind() in ("text", "^"):
                phrases.append(self.phrase())
            if self.take(","):
                distance = int(self.toks[self.i][1]) if self.kind() == "text" and self.toks[self.i][1].isdigit() else -1
                self.i += 1
            if not self.take(")") or not phrases or distance < 0:
                raise SearchError("NEAR needs phrases and a number")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        first = self.take("^")
        words: list[str] = []
        while True:
            if self.kind() != "text":
                raise SearchError(f"a word is missing before {self.kind() or 'the end'}")
            _, text, star = self.toks[self.i]
            self.i += 1
            words += terms(text)
            if star or not self.take("+"):
                return Phrase(tuple(words), star, first)


def parse(expression: str):
    return _Reader(expression).whole()


def index(df: DataFrame, key: str, text: str = "text", path: str | None = None) -> DataFrame:
    """Postings ``term, key, places``, written in the order of terms and keys."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).dropna()

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                names, at, places = [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    found = defaultdict(list)
                    for k, word in enumerate(terms(t)):
                        found[word].append(k)
                    names += found
                    at += [i] * len(found)
                    places += found.values()
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), keys, pa.array(places, pa.list_(pa.int32()))], names=["term", "key", "places"])

    posts = rows.mapInArrow(posted, f"term string, key {kind}, places array<int>")
    return written(posts.repartitionByRange("term", "key").sortWithinPartitions("term", "key"), "postings", path)


def _phrases(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    return list(node.phrases) if isinstance(node, Near) else [*_phrases(node.left), *_phrases(node.right)]


def _less(n: int) -> Callable[[Column], Column]:
    return lambda x: x - n


def _within(others: list[Column], reach: int) -> Callable[[Column], Column]:
    """Whether each of the lists has a place from ``s`` on, up to ``reach`` behind it."""

    def near(s: Column) -> Column:
        out = F.lit(True)
        for there in others:
            out = out & F.exists(there, lambda t: (t >= s) & (t - s <= reach))
        return out

    return near


def search(postings: DataFrame, expression: str) -> DataFrame:
    """The keys (as ``key``) of the rows that match."""
    tree = parse(expression)
    asked = {(w, p.prefix and i == len(p.words) - 1) for p in _phrases(tree) for i, w in enumerate(p.words)}
    if not asked:
        return postings.filter("false").select("key")
    names = {a: f"t{i}" for i, a in enumerate(sorted(asked))}

    def is_asked(word: str, prefix: bool) -> Column:
        return F.col("term").startswith(word) if prefix else F.col("term") == word

    wanted = None
    for a in names:
        wanted = is_asked(*a) if wanted is None else wanted | is_asked(*a)
    lists = [F.array_sort(F.flatten(F.collect_list(F.when(is_asked(*a), F.col("places"))))).alias(n) for a, n in names.items()]
    merged = postings.filter(wanted).groupBy("key").agg(*lists)

    def starts(p: Phrase) -> Column:
        """Where a phrase begins; a phrase without words is nowhere."""
        if not p.words:
            return F.array().cast("array<int>")
        own = [F.col(names[(w, p.prefix and i == len(p.words) - 1)]) for i, w in enumerate(p.words)]
        found = own[0]
        for i, other in enumerate(own[1:], 1):
            found = F.array_intersect(found, F.transform(other, _less(i)))
        return F.filter(found, lambda x: x == 0) if p.first else found

    def matches(node) -> Column:
        if isinstance(node, Phrase):
            return F.size(starts(node)) > 0
        if isinstance(node, Near):
            own = [(starts(p), len(p.words)) for p in node.phrases]
            out = F.lit(False)
            for here, length in own:  # the phrase that begins first: all others begin within reach of its end
                out = out | F.exists(here, _within([there for there, _ in own], length + node.distance))
            return out
        left, right = matches(node.left), matches(node.right)
        return left & right if node.kind == "and" else left | right if node.kind == "or" else left & ~right

    return merged.filter(matches(tree)).select("key")
