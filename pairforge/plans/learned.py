"""Registered queries of dictionaries and of models that are fitted to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.operators import dictionary, language, metrics, tagging, vectors
from pairforge.plans import runner
from pairforge.plans.battery import query, table
from pairforge.session import scratch_path, spread
from pairforge.sources import once_sink
from pairforge.streaming import attempts

#: Word characters, as both engines have them.
_W = r"[\p{L}\p{N}_]"
_TOKENS = rf"regexp_extract_all(coalesce(text, ''), '{_W}+|[^\p{{L}}\p{{N}}_]+')"


def _documents(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang"))


def _names(spark, d):
    """Words of the benchmark, and pairs of words with one blank between them, as a dictionary."""
    words = F.expr(r"transform(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+', 0), x -> x)")
    listed = table(spark, d, "benchmark").select(words.alias("w"))
    one = listed.select(F.explode("w").alias("name")).filter(r"name rlike '^[\\p{L}\\p{N}_]{6,}$'")
    pair = listed.select(F.explode(F.expr("filter(transform(w, (x, i) -> case when get(w, i + 1) = ' ' then concat(x, ' ', get(w, i + 2)) end), x -> x is not null)")).alias("name"))
    return one.union(pair).distinct()


_NAMES = rf"""
    w AS (SELECT regexp_extract_all(lower(text), '{_W}+|[^\p{{L}}\p{{N}}_]+') AS w FROM benchmark),
    names AS (
        SELECT DISTINCT x AS name FROM w, unnest(w) AS t(x) WHERE regexp_full_match(x, '{_W}{{6,}}')
        UNION SELECT DISTINCT w[i] || ' ' || w[i + 2] FROM w, unnest(range(1, len(w) - 1)) AS t(i) WHERE w[i + 1] = ' '
    )"""


@query(rf"""
    WITH {_NAMES},
    d AS (SELECT doc_id, list_transform({_TOKENS}, lambda x: lower(x)) AS l FROM documents),
    o AS (
        SELECT doc_id, l[i] AS name FROM d, unnest(range(1, len(l) + 1)) AS t(i)
        UNION ALL SELECT doc_id, l[i] || ' ' || l[i + 2] FROM d, unnest(range(1, len(l) - 1)) AS t(i) WHERE l[i + 1] = ' '
    ),
    f AS (SELECT doc_id, count(*) AS n, count(DISTINCT o.name) AS names FROM o SEMI JOIN names ON o.name = names.name GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(names, 0) AS names FROM d LEFT JOIN f ON d.doc_id = f.doc_id
""")
def tr9_dictionary_matches(spark, d):
    found = dictionary.matches(_documents(spark, d), _names(spark, d), column="found", overlapping=True)
    return found.select("doc_id", F.size("found").cast("bigint").alias("n"), F.size(F.array_distinct(F.transform("found", lambda m: m["name"]))).cast("bigint").alias("names"))


def _capitals(x):
    """Capitals letter for letter, as the SQL has them: a letter whose capital is longer stays, and the sharp s has one."""
    return F.array_join(F.transform(F.split(F.translate(x, "ß", "ẞ"), ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


@query(rf"""
    WITH {_NAMES},
    d AS (SELECT doc_id, text, {_TOKENS} AS l FROM documents),
    x AS (SELECT doc_id, l[i] AS x, i FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
    s AS (SELECT doc_id, string_agg(CASE WHEN names.name IS NULL THEN x ELSE '<' || upper(names.name) || '>' END, '' ORDER BY i) AS text FROM x LEFT JOIN names ON lower(x) = names.name GROUP BY doc_id)
    SELECT d.doc_id, sha256(coalesce(s.text, d.text)) AS digest FROM d LEFT JOIN s ON d.doc_id = s.doc_id
""")
def tr12_dictionary_substituted(spark, d):
    """Single words, so that SQL can say it; names of several words are tested by brute force."""
    names = _names(spark, d).filter("name not like '% %'").select(F.col("name").alias("entity"), F.concat(F.lit("<"), _capitals("name"), F.lit(">")).alias("title"))
    return dictionary.substituted(_documents(spark, d), names).select("doc_id", F.sha2(F.col("substituted").cast("binary"), 256).alias("digest"))


@query()
def tr2_trained_language(spark, d):
    """Learns from the rows that are not held out; no SQL, as the tests hold the scores against plain sums."""
    docs = _documents(spark, d)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = language.fit(docs.filter(~held))
    return language.detected(docs, model).select("doc_id", held.alias("held_out"), "language", language.language_match("lang").alias("match"))


_FRAMES = {
    "s1": "sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "s2": "max(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)",
    "s3": "count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW EXCLUDE TIES)",
    "s4": "sum(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW)",
}
_FRAMED = f"SELECT c_custkey, {', '.join(f'{v} AS {k}' for k, v in _FRAMES.items())} FROM customer"


@query(f"SELECT c_custkey, {', '.join(f'cast({k} AS bigint) AS {k}' for k in _FRAMES)} FROM ({_FRAMED})")
def r_groups_frame(spark, d):
    return runner.Runner(spark, {"customer": table(spark, d, "customer")}).query(_FRAMED).selectExpr("c_custkey", *[f"cast({k} AS bigint) AS {k}" for k in _FRAMES])


_TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@query(rf"""
    WITH d AS (SELECT doc_id, ' ' || array_to_string({_TERMS}, ' ') || ' ' AS t FROM documents),
    m AS (
        SELECT doc_id, contains(t, ' the ') AND NOT contains(t, ' that ') AS a, contains(t, ' in the ') OR contains(t, ' the') AND contains(t, ' of ') AS b,
            regexp_matches(t, ' than ([^ ]+ ){{0,3}}in ') OR regexp_matches(t, ' in ([^ ]+ ){{0,3}}than ') AS c FROM d
    )
    SELECT doc_id, a, b, c FROM m WHERE a OR b OR c
""")
def r_match(spark, d):
    r = runner.Runner(spark, {"documents": _documents(spark, d)})
    r.add_index("documents", "text", "doc_id")
    found = {"a": "the NOT that", "b": '"in the" OR the* of', "c": "NEAR(than in, 3)"}
    each = [r.query(f"SELECT doc_id FROM documents WHERE text MATCH '{x}'").select("doc_id", F.lit(name).alias("name")) for name, x in found.items()]
    all_of = each[0].union(each[1]).union(each[2])
    return all_of.groupBy("doc_id").agg(*[F.max(F.col("name") == n).alias(n) for n in found])


@query("SELECT c_custkey, c_nationkey, upper(c_name) AS name FROM customer WHERE c_nationkey < 15")
def io11_io13_once_sink(spark, d):
    """Batches with an id: two of them come again, one with other rows, and add nothing."""
    path = scratch_path(spark, "once")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.upper("c_name").alias("name"))
    for first in (0, 5, 0, 10, 5):
        once_sink.append(c.filter(F.col("c_nationkey").between(first, first + 4)), path, f"nations-{first}")
    once_sink.append(c, path, "nations-0")
    return once_sink.read(spark, path, c.schema)


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn <= 2 AND length(text) >= 90) WHERE k = 1")
def tr8_attempts_stream(spark, d):
    """Turns as attempts, the later ones first, into the exactly-once sink; a row at the end moves the time on."""
    path = scratch_path(spark, "attempts")
    # a state store for each core, as their number stays what it is at the stream's start
    settings = attempts.STATE_STORE | {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    kept = {k: spark.conf.get(k, None) for k in settings}
    schema = "conv_id long, turn int, n int, at timestamp"
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), F.length("text").alias("n"), start.alias("at"))
    once_sink.register(spark)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        last = [(-1, 9, 0, 1_700_010_000 + i) for i in range(2)]
        for part in (turns.filter("turn >= 2"), turns.filter("turn < 2"), *(spark.createDataFrame([r], "conv_id long, turn int, n int, at long").withColumn("at", F.timestamp_seconds("at")) for r in last)):
            part.write.mode("append").parquet(f"{path}/drop")
            stream = spark.readStream.schema(schema).parquet(f"{path}/drop").withColumn("attempt", F.col("turn") + 1).withWatermark("at", "1 minute")
            out = attempts.first_kept(stream, "conv_id", "attempt", F.col("n") >= 90, "at")
            out.writeStream.format("once").option("path", f"{path}/sink").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return once_sink.read(spark, f"{path}/sink", "conv_id long, turn int").select("conv_id", "turn")


_CLOSED = {"DET": "the a an this", "ADP": "of in on at with than", "CCONJ": "and or but", "SCONJ": "that because if while", "AUX": "is was are be"}


def _tagged_by_rule(spark, d):
    """A tagged table to learn from: the benchmark's sentences, by lists of words and endings."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", r"(?<=[.!?])")).alias("s")).select(F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0)).alias("tokens"))

    def tag(w):
        low = F.lower(w)
        out = F.when(~w.rlike(r"[\p{L}\p{N}]"), "PUNCT").when(w.rlike(r"^\p{N}+$"), "NUM")
        for name, listed in _CLOSED.items():
            out = out.when(low.isin(*listed.split()), name)
        return out.when(low.rlike("(ed|ing|ate)$"), "VERB").when(low.rlike("ly$"), "ADV").when(low.rlike("(ous|ive|er|al)$"), "ADJ").otherwise("NOUN")

    return words.select("tokens", F.transform("tokens", tag).alias("tags"))


@query()
def m11_m13_syntax(spark, d):
    """Counts by tag, noun phrases and the composite from the texts themselves; tests have the tagger's brute force."""
    tagger = tagging.fit(_tagged_by_rule(spark, d))
    out = tagging.syntax(_documents(spark, d), tagger)
    counts = [F.coalesce(F.col("tags")[t], F.lit(0)).alias(t.lower()) for t in ("NOUN", "VERB", "ADJ", "PUNCT")]
    return out.select("doc_id", *counts, F.size("phrases").alias("phrases"), "sentences", F.round(metrics.nl_composite(), 8).alias("composite"))


@query()
def cr11_text_mentions(spark, d):
    """How near each text comes to the longest word of the benchmark item of its number; tests have numpy's vectors."""
    docs = _documents(spark, d)
    items = table(spark, d, "benchmark").select("item_id", F.array_max(F.transform(vectors.words_of("text"), lambda w: F.struct(F.length(w), w.alias("w"))))["w"].alias("entity"))
    n = items.agg(F.max("item_id") + 1).first()[0]
    pairs = docs.withColumn("item_id", F.col("doc_id") % n).join(items, "item_id").select("doc_id", "text", "entity")
    return vectors.mentions(pairs, vectors.word_vectors(docs, width=16, powers=1), ["doc_id"]).select("doc_id", F.round("similarity", 6).alias("similarity"))
