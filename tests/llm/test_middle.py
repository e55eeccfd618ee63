"""Fill-in-middle against plain Python."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairforge.llm import middle
from pairforge.llm import queries as q

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\S+\s*|\s+", "char": r"(?s:.)"}


def brute(doc_id, text, unit="line", seed=7, rate=100, spm_rate=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    # white space of the kernel is ASCII alone
    units = re.findall(UNITS[unit], text, re.A)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in middle.MARKS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


EXTRA = [
    (101, "\n"), (102, "\n\n\na"), (103, "a\nb"), (104, "a\nb\n"), (105, "é\n日本\n😀"), (106, "x<P>y\nz"), (107, "<\n<S"), (108, "<M"), (109, "a <\n S> b\n"),
    (110, "one\ntwo\n" * 40_000), (111, "no line end " * 1000), (112, "\r\n\x0b\x0c \n"), (None, "null\nid"), (113, None), (114, ""), (115, "P>\nM>\nS>\n<"), (116, " \u0085 a b"),
]


@pytest.mark.parametrize("unit,rate,spm_rate", [("line", 100, 50), ("word", 70, 0), ("char", 100, 100)])
def test_kernel(spark, rows, unit, rate, spm_rate):
    cases = [(r[0], r[1]) for r in rows] + EXTRA
    df = spark.createDataFrame([(*c, "clash") for c in cases], "doc_id long, text string, output string").withColumns({c: F.lit(c) for c in ("n", "form", "_text", "_h1", "_k0")}).repartition(3)
    made = middle.transform(df, unit, rate=rate, spm_rate=spm_rate, keep=("doc_id", "text"))
    got = made.withColumn("back", middle.restore()).collect()
    assert len(got) == len(cases)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, unit, 7, rate, spm_rate), r.text
        assert r.back == (r.text or "")
    assert {"psm", "spm", "plain"} >= {r.form for r in got} > {"plain"}


def test_empty_batches_and_slices(spark, empty):
    assert middle.transform(empty).collect() == []
    texts = pa.array(["zz\nzz", None, "a\nb\nc\n", "", "é\nü"]).slice(1)
    units = middle.Units(texts.fill_null(""), "line")
    assert units.counts.tolist() == [0, 3, 0, 2]
    assert middle.Units(pa.array([], pa.string()), "line").counts.tolist() == []


def test_marks_that_overlap(docs):
    for marks in (("<P>", "<P>x", "<M>"), ("aba", "b", "c"), ("", "b", "c"), ("xa", "ay", "c")):
        with pytest.raises(ValueError):
            middle.transform(docs, marks=marks)
    assert middle.transform(docs, marks=("[pre]", "[suf]", "[mid]")).count() == docs.count()


def test_query(spark, data):
    import duckdb

    got = sorted(map(tuple, q.op12_middle(spark, data).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert got == sorted(con.execute(q.ORACLE_SQL["op12_middle"]).fetchall())
