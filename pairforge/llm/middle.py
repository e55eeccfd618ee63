"""Fill-in-middle transformation by one numpy kernel for each Arrow batch.

The kernel never looks at a row by itself. A table of byte classes is looked up for
the whole UTF-8 buffer of a batch; a mask of adjacent bytes marks where a unit (line,
word or code point) begins; its cumulative sum, reset at each document, counts the
units; ``searchsorted`` finds the bytes of all rows' cuts at once. The three parts of
each text are then one Arrow array over the same buffer, whose offsets are the
documents' ends and the cuts in turn, so nothing is copied until the output is joined.

Draws come from the digest of seed and id and so do not depend on partitions.
:func:`restore` takes the parts out of an output again by expressions alone.

Defined cases: a null text is empty; empty texts, and texts that hold a mark, stay
plain (lengths of parts are then null); a null id draws as an empty one; equal ids
draw alike; very long texts are one row of a batch of bounded rows; an empty table
gives an empty result; other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm.storage import bounded

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
#: Rows and bytes of text of a kernel's batch; a longer text is a batch of its own.
ROWS, BYTES = 512, 8 << 20

_LEAD, _BREAK, _SPACE = 1, 2, 4
#: Class bits of each byte: begins a code point, ends a line, is white space.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[b for b in range(256) if b & 0xC0 != 0x80]] |= _LEAD
CLASSES[10] |= _BREAK
CLASSES[[9, 10, 11, 12, 13, 32]] |= _SPACE


def _begins(kinds: np.ndarray, first: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte; ``first`` are the documents' first bytes."""
    if unit == "char":
        return (kinds & _LEAD) > 0
    begins = np.zeros(len(kinds), bool)
    if unit == "line":
        np.not_equal(kinds[:-1] & _BREAK, 0, out=begins[1:])
    elif unit == "word":  # a word with the white space behind it
        begins[1:] = ((kinds[:-1] & _SPACE) != 0) & ((kinds[1:] & _SPACE) == 0)
    else:
        raise ValueError(f"unknown unit {unit!r}")
    begins[first] = True
    return begins


class Units:
    """Where the units of a batch of texts begin."""

    def __init__(self, texts: pa.Array, unit: str):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        self.data = raw if raw is not None else pa.py_buffer(b"")
        low = int(offsets[0])
        self.starts, self.ends = offsets[:-1], offsets[1:]
        kinds = CLASSES[np.frombuffer(self.data, np.uint8)[low : int(offsets[-1])]]
        begins = _begins(kinds, (self.starts - low)[self.ends > self.starts], unit)
        self.sums = np.zeros(len(kinds) + 1, np.int32)  # units that begin before each byte
        np.cumsum(begins, out=self.sums[1:])
        self.low = low
        self.before = self.sums[self.starts - low]
        self.counts = self.sums[self.ends - low] - self.before

    def cut(self, units: np.ndarray) -> np.ndarray:
        """The byte behind so many units of each row."""
        at = np.searchsorted(self.sums, (self.before + units).astype(np.int32), "right") - 1 + self.low
        return np.where(units >= self.counts, self.ends, np.maximum(at, self.starts))

    def parts(self, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
        """Prefix, middle and suffix of each row, over the batch's own bytes."""
        offsets = np.empty(3 * len(first) + 1, np.int64)
        offsets[0:-1:3], offsets[1::3], offsets[2::3] = self.starts, first, second
        offsets[-1] = self.ends[-1] if len(first) else self.low
        pieces = pa.Array.from_buffers(pa.large_string(), 3 * len(first), [None, pa.py_buffer(offsets), self.data])
        return [pieces.take(pa.array(np.arange(k, 3 * len(first), 3))) for k in range(3)]


def kernel(texts: pa.Array, draws: Sequence[np.ndarray], unit: str, marks: Sequence[str], rate: int, spm_rate: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of all texts; ``draws`` are h1 to h4."""
    texts = texts.fill_null("")
    units = Units(texts, unit)
    h1, h2, h3, h4 = draws
    one, two = h1 % (units.counts + 1), h2 % (units.counts + 1)
    first, second = units.cut(np.minimum(one, two)), units.cut(np.maximum(one, two))
    plain = (units.ends == units.starts) | (h3 % 100 >= rate)
    for mark in marks:
        plain |= np.asarray(pc.match_substring(texts, mark))
    spm = ~plain & (h4 % 100 < spm_rate)
    prefix, middle, suffix = units.parts(first, second)
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    none = pa.scalar("", pa.large_string())
    psm_form = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm_form = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(pa.array(plain), texts.cast(pa.large_string()), pc.if_else(pa.array(spm), spm_form, psm_form))
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(spm), "spm", "psm"))
    lengths = [pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), pc.utf8_length(x)) for x in (prefix, middle)]
    return [pa.array(units.counts, pa.int64()), form, *lengths, output.cast(pa.string())]


def _draws(doc_id: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def transform(
    df: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, marks: Sequence[str] = MARKS, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns, ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` percent of the texts are cut up, ``spm_rate`` percent of these with the
    suffix first. No mark may end as another begins, or outputs could not be read back.
    """
    for a in marks:
        if not a or any(a.endswith(b[:k]) for b in marks for k in range(1, len(b)) if k < len(a)) or any(a in b for b in marks if a is not b):
            raise ValueError(f"mark {a!r} is empty or overlaps another")
    kept = [df.schema[c] for c in keep]
    names = [f"_k{i}" for i in range(len(kept))]
    rows = df.select(*[F.col(f"`{c.name}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"`{text}`").cast("string").alias("_text"), *_draws(doc_id, seed))
    out = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, len(names), ROWS, BYTES):
            carried = [batch.column(i) for i in range(len(names))]
            draws = [np.asarray(batch.column(len(names) + 1 + k)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*carried, *kernel(batch.column(len(names)), draws, unit, marks, rate, spm_rate)], names=[*names, *out])

    kinds = [f"{n} {c.dataType.simpleString()}" for c, n in zip(kept, names, strict=True)]
    made = rows.mapInArrow(mapped, ", ".join([*kinds, "n long, form string, prefix_chars long, middle_chars long, output string"]))
    return made.select(*[F.col(n).alias(c.name) for c, n in zip(kept, names, strict=True)], *out)


def restore(output: str | Column = "output", form: str | Column = "form", marks: Sequence[str] = MARKS) -> Column:
    """The text that an output was made of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = map(F.lit, marks)

    def between(a: Column, b: Column | None) -> Column:
        """What follows the mark ``a``, up to ``b``."""
        rest = F.split_part(output, a, F.lit(2))
        return rest if b is None else F.split_part(rest, b, F.lit(1))

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
