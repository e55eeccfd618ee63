"""Whole dictionaries matched against texts in one pass.

Names of a dictionary table are found by an Aho-Corasick automaton: one pass over a text
finds every name in it, however many names there are. A match counts where no word
character touches it, without regard to case. Where matches overlap, longer names
win, then those further left, so each place has one name at most.

The dictionary is cut into shards of a bounded number of characters, by a hash of
the name; the size is counted first. Each shard in turn is sent to the tasks, builds its
automaton there once for each worker, and adds its matches to the rows; between
shards the rows are written, so no task holds two automata. Most dictionaries are one
shard and need one pass without a shuffle.

Names that are null or empty match nothing; of equal names (without regard to case)
the one with the smallest spelling and value counts; a null text has no matches.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.session import written

#: Characters of a shard's names: an automaton has a node of some 60 bytes for each at most.
SHARD_CHARS = 2_000_000
#: Rows of a batch.
ROWS = 256

_AUTOMATA: dict[str, tuple] = {}


def lowered(text: str) -> str:
    """Small letters, place by place: a character whose small form is longer stays."""
    small = text.lower()
    return small if len(small) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _automaton(key: str, names: Sequence[str]):
    """The worker's automaton; that of another shard goes."""
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for i, name in enumerate(names):
            made.add_word(name, (i, len(name)))
        made.make_automaton()
        _AUTOMATA[key] = (made,)
    return _AUTOMATA[key][0]


def occurrences(text: str, automaton) -> list[tuple[int, int, int]]:
    """(begin, end, name) of all whole-word occurrences."""
    out = []
    low = lowered(text)
    for last, (i, n) in automaton.iter(low):
        begin, end = last + 1 - n, last + 1
        if not (begin and _word(low[begin - 1])) and not (end < len(low) and _word(low[end])):
            out.append((begin, end, i))
    return out


def longest_first(spans: list[tuple]) -> list[tuple]:
    """Spans that do not overlap, by place: longer ones win, then those further left."""
    taken: list[tuple] = []
    starts: list[int] = []
    for span in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        k = bisect_left(starts, span[0])
        if (k == 0 or taken[k - 1][1] <= span[0]) and (k == len(taken) or taken[k][0] >= span[1]):
            taken.insert(k, span)
            starts.insert(k, span[0])
    return taken


_MATCH = "array<struct<begin:int,end:int,name:string,value:string>>"
_ARROW = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("value", pa.string())]))


def matches(df: DataFrame, dictionary: DataFrame, text: str = "text", name: str = "name", value: str | None = None, column: str = "matches", overlapping: bool = False, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Add ``column``: (begin, end, name, value) of the names in each text, by place; ``value`` comes with the name.

    ``overlapping`` keeps every occurrence.
    """
    spark = df.sparkSession
    named = dictionary.select(F.col(f"`{name}`").cast("string").alias("name"), (F.col(f"`{value}`").cast("string") if value else F.lit(None).cast("string")).alias("value")).filter("name <> ''")
    known = named.groupBy(F.lower("name").alias("_low")).agg(F.min(F.struct("name", "value")).alias("n")).select("n.name", "n.value")
    known = written(known, "dictionary")
    size = known.agg(F.sum(F.length("name"))).first()[0] or 0
    shards = -(-size // shard_chars) or 1
    at = df.columns.index(text)
    out = df.select("*", F.array().cast(_MATCH).alias("_found"))
    for s in range(shards):
        rows = sorted(((r.name, r.value) for r in known.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == s).collect()), key=lambda r: (r[0], r[1] or "")) if size else []
        out = _pass(out, spark.sparkContext.broadcast(rows), at, overlapping or s < shards - 1)
        if s < shards - 1:
            out = written(out, f"matches_{s}")
    return out.select(*[f"`{c}`" for c in df.columns], F.col("_found").alias(column))


def _pass(df: DataFrame, shard, at: int, every: bool) -> DataFrame:
    """One shard's matches added to ``_found``, the last column."""

    made = uuid.uuid4().hex

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shard.value
        low = [lowered(n) for n, _ in rows]
        automaton = _automaton(made, low) if low else None
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                found = []
                for text, before in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    spans = [(b, e, *rows[i]) for b, e, i in occurrences(text, automaton)] if text and automaton else []
                    spans += [(m["begin"], m["end"], m["name"], m["value"]) for m in before]
                    spans = sorted(spans, key=lambda s: (s[0], s[1], s[2])) if every else longest_first(spans)
                    found.append([dict(zip(("begin", "end", "name", "value"), m, strict=True)) for m in spans])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _ARROW)], names=batch.schema.names)

    return df.mapInArrow(mapped, df.schema)


def entities(df: DataFrame, gazetteer: DataFrame, text: str = "text", name: str = "name", label: str = "label", column: str = "entities") -> DataFrame:
    """Add an array of (text, label): what the texts themselves have for the gazetteer's names, by place."""
    found = matches(df, gazetteer, text, name, label, "_matches")
    as_written = F.transform("_matches", lambda m: F.struct(F.substring(F.col(f"`{text}`"), m["begin"] + 1, m["end"] - m["begin"]).alias("text"), m["value"].alias("label")))
    return found.withColumn(column, as_written).drop("_matches")


def substituted(df: DataFrame, dictionary: DataFrame, text: str = "text", name: str = "entity", value: str = "title", column: str = "substituted") -> DataFrame:
    """Add the text with each name replaced by its value; names without one, or whose value is a disambiguation page, stay."""
    good = F.when(~F.lower(F.col(f"`{value}`")).contains("disambiguation"), F.col(f"`{value}`"))
    usable = dictionary.select(F.col(f"`{name}`").alias("name"), good.alias("value")).filter("value is not null")
    found = matches(df, usable, text, "name", "value", "_matches")
    pieces = F.transform(
        "_matches",
        lambda m, i: F.concat(F.substring(F.col(f"`{text}`"), F.when(i == 0, 1).otherwise(F.get("_matches", i - 1)["end"] + 1), m["begin"] - F.when(i == 0, 0).otherwise(F.get("_matches", i - 1)["end"])), m["value"]),
    )
    rest = F.substring(F.col(f"`{text}`"), F.element_at("_matches", -1)["end"] + 1, F.length(f"`{text}`"))
    made = F.when(F.size("_matches") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col(f"`{text}`"))
    return found.withColumn(column, made).drop("_matches")
