"""Digests that stand for all rows of a result."""

from __future__ import annotations

import hashlib
import json
import marshal
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from itertools import batched


@dataclass(frozen=True)
class Digests:
    """All rows of a result: their number, and digests of them as multisets (lower-case JSON; canonical) and in order."""

    n_rows: int
    multiset: str
    canonical: str
    sequence: str


def canonical_row(row: Sequence) -> str:
    def value(v):
        if isinstance(v, bytes):
            v = v.decode("utf-8", "replace")
        if isinstance(v, str):
            return v.lower()
        if isinstance(v, Decimal):
            v = float(v)
        if isinstance(v, float) and v.is_integer():
            return int(v)
        return v if v is None or isinstance(v, (int, float, bool)) else str(v).lower()

    return json.dumps([value(v) for v in row], ensure_ascii=False)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=32).digest(), "little")


#: Values that the lower-case JSON of a row has in their canonical form.
_PLAIN = {str, int, type(None)}


def row_digests(r: Sequence) -> tuple[bytes, int, int]:
    """A row's text in a sequence, and its digests in lower case and canonical."""
    text = json.dumps(list(r), ensure_ascii=False, default=str)
    low = canonical_ = _digest(text.lower())
    if not _PLAIN.issuperset(map(type, r)):
        text = json.dumps([int(v) if isinstance(v, float) and v.is_integer() else v for v in r], ensure_ascii=False, default=str)
        canonical_ = _digest(canonical_row(r))
    return text.encode("utf-8", "surrogatepass") + b"\n", low, canonical_


#: Rows whose digests are remembered.
_SEEN = 200_000


def digests(rows: Iterable[Sequence], seen: dict[bytes, tuple[bytes, int, int]] | None = None) -> Digests:
    """One pass over the rows, none of which is held. A multiset's digest is the sum of its rows' digests.

    ``seen`` remembers rows for the next results of the same table (tuples of SQLite's types).
    """
    n, multiset, canonical_, sequence = 0, 0, 0, hashlib.blake2b(digest_size=32)
    for some in batched(rows, 1000):
        if seen is None:
            each = [row_digests(r) for r in some]
        else:
            each = []
            for r in some:
                key = marshal.dumps(r, 2)  # tells 1 from 1.0, and 0.0 from -0.0
                got = seen.get(key)
                if got is None:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    got = seen[key] = row_digests(r)
                each.append(got)
        n += len(each)
        texts, low, canonicals = zip(*each, strict=True)
        sequence.update(b"".join(texts))
        multiset += sum(low)
        canonical_ += sum(canonicals)
    return Digests(n, *(f"{x % (1 << 256):064x}" for x in (multiset, canonical_)), sequence.hexdigest())
