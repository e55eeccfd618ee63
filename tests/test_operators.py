"""Evolution, corruption, answers, sources and streams on small cases."""

from __future__ import annotations

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from pairforge.functions import answers, seeded, similarity, text
from pairforge.operators import aggregates, corruption, evolution, filters, rows, translation
from pairforge.plans import sqltree
from pairforge.sources import catalog, fixtures, sqlite_source
from pairforge.streaming import drops


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# -- evolution ----------------------------------------------------------------------------------
def test_merge_repair():
    c = ("Player", "No.")
    assert evolution.repair_merge("SELECT Position FROM t", c, "X") == "SELECT Position FROM t"
    assert evolution.repair_merge("SELECT Position, `Player`, `No.` FROM t", c, "P N") == "SELECT Position, `P N` FROM t"
    assert evolution.repair_merge("SELECT Player FROM t", c, "X") == evolution.UNANSWERABLE
    assert evolution.repair_merge("SELECT Player, `No.` FROM t ORDER BY Player", c, "X") == evolution.UNANSWERABLE
    assert evolution.repair_merge("SELECT CONCAT(`Player`, `No.`) FROM t", c, "X") == "SELECT `X` FROM t"
    assert evolution.repair_merge("SELECT COUNT(Player) FROM t", c, "X") == evolution.UNANSWERABLE


def test_rename_repair_keeps_literals():
    assert evolution.rename_in("SELECT Pos, `Position` FROM t WHERE x = 'Position'", {"position": "Role"}) == "SELECT Pos, `Role` FROM t WHERE x = 'Position'"
    assert evolution.rename_in("SELECT Position FROM t", {"Position": "Field role"}) == "SELECT `Field role` FROM t"


def test_columns_together():
    for sql, want in (
        ("SELECT a, b FROM t", True),
        ("SELECT COUNT(a), AVG(b) FROM t", False),
        ("SELECT a, COUNT(b) FROM t", False),
        ("SELECT COUNT(*) FROM t GROUP BY a, b", True),
        ("SELECT a FROM t WHERE b = 1", False),
        ("SELECT a FROM t WHERE b = 1 AND c = 2", True),
        ("SELECT a + b FROM t", True),
        ("SELECT COUNT(*) FROM t", False),
    ):
        assert evolution.joins_columns(sql) is want, sql


def test_catalog_evolution(spark):
    t = fixtures.tables(spark)
    c = evolution.Change("merge_column", columns=("Player", "No."), new={"Who": ()})
    out = evolution.evolve_catalog(t, c).collect()
    assert [r.parent_table_id for r in out] == ["1-204-7"]
    assert out[0].header[-1] == "Who" and out[0].rows[3][-1] == "Dee Poe, " and " " not in out[0].name
    assert evolution.derived_id("1-2-3", c) == evolution.derived_id("1-2-3", c) != evolution.derived_id("1-2-3", c, 1)
    added = evolution.evolve_catalog(t, evolution.Change("add_column", new={"Grade": ("a", "b")})).collect()
    assert len(added) == 3 and {r[-1] for r in added[0].rows} <= {"a", "b"}


def test_values_kept(spark):
    df = spark.range(5).withColumn("v", F.when(F.col("id") > 2, F.col("id")))
    assert evolution.values_kept(df, df.withColumn("x", F.lit(1)), ["id", "v"])
    assert not evolution.values_kept(df, df.filter("id < 4"), ["id", "v"])


def test_seeded_choice_does_not_depend_on_partitions(spark):
    df = spark.range(200)
    c = seeded.choice(F.array(*map(F.lit, "abc")), 1, "x", F.col("id"))
    assert sorted(one(df.repartition(1), "id", c)) == sorted(one(df.repartition(7), "id", c))
    sizes = {r.split: r.n for r in seeded.exact_split(df, [("a", 0.75), ("b", 0.25)], 3, "id").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"a": 150, "b": 50}


# -- corruption ----------------------------------------------------------------------------------
def test_corruption_chain():
    for n in range(200):
        sql, k = corruption.corrupt("SELECT a, b FROM t WHERE c = 'x' ORDER BY a", str(n))
        assert (k == 0) == (sql == "SELECT a, b FROM t WHERE c = 'x' ORDER BY a") or k > 0
        assert corruption.corrupt("SELECT a, b FROM t WHERE c = 'x' ORDER BY a", str(n)) == (sql, k)
    counts = [corruption.corrupt("SELECT MAX(a), b FROM t WHERE c = 'x'", str(n), rate=1.0)[1] for n in range(2000)]
    assert 0.45 < counts.count(1) / 2000 < 0.65 and 0.02 < counts.count(4) / 2000 < 0.09
    assert corruption.upper_keywords("select `from` from t where a = 'select'") == "SELECT `from` FROM t WHERE a = 'select'"


def test_native_corruption(spark):
    q = corruption.with_plausible(spark.createDataFrame([(1, "SELECT a, b FROM t WHERE c = 1"), (2, "no query"), (3, None)], "k int, sql string").withColumn("db_id", F.lit("x")), None)
    k = F.col("k")
    for f in (corruption.remove_column, corruption.add_column, corruption.swap_columns, corruption.replace_column):
        got = dict(one(q, "k", f("sql", 5, k)))
        assert got[1].endswith("FROM t WHERE c = 1") and got[1] != "SELECT a, b FROM t WHERE c = 1" and got[2] == "no query" and got[3] is None


# -- answers -------------------------------------------------------------------------------------
def test_loose_json():
    assert answers.load_loose('x {"a": "}", "b": [1, 2,],} y') == {"a": "}", "b": [1, 2]}
    assert answers.load_loose("none") is None and answers.load_loose(None) is None and answers.load_loose("{") is None
    assert answers.list_of("['a', ' ', None, 'b']") == ["a", "b"] and answers.list_of(None) == [] and answers.list_of("x") == ["x"]


def test_stored_results(spark):
    df = spark.createDataFrame([("[('a', 1), ('b', None)]",), ('[["a", 1]]',), ('["(1, 2)"]',), ("bad",), (None,)], "x string")
    got = [r[0] for r in df.select(answers.stored_result(F.col("x"))).collect()]
    assert got == ['[["a", 1], ["b", null]]', '[["a", 1]]', "[[1, 2]]", None, None]


def test_similarity():
    assert similarity.best_window_ratio("abc", "xxabcxx") == 1.0 and similarity.best_window_ratio("", "x") == 0.0
    assert similarity.assign(["id", "film_name"], ["name", "ID"]) == {"id": "ID", "film_name": "name"}
    assert similarity.bleu("a b c d e", "a b c d e") == pytest.approx(1.0) and similarity.bleu("a", "b") == 0.0
    assert similarity.replace_longest_first("New York and York", {"York": "Y", "New York": "NY"}) == "NY and Y"


def test_tree():
    assert sqltree.parse("not sql") is None and sqltree.parse("SELECT (1") is None and sqltree.parse(None) is None
    columns, subqueries, operators, splits, nodes, parsed = sqltree.measures("SELECT a FROM t WHERE b > (SELECT MAX(c) FROM u) AND d = 1")
    assert (columns, subqueries, parsed) == (4, 1, True) and operators > 5 and nodes > splits > 0
    assert sqltree.columns(sqltree.parse("SELECT t.a AS x, COUNT(*) FROM t AS y")) == ["a"]


def test_readability_of_blank(spark):
    df = spark.createDataFrame([("",), (None,), ("One two. Three!",)], "x string")
    got = one(df, text.word_count("x"), text.sentence_count("x"), text.syllable_count("x"))
    assert got == [(0, 0, 0), (0, 0, 0), (3, 2, 4)]


# -- translation -------------------------------------------------------------------------------------
def test_suspicious(spark):
    df = spark.createDataFrame([("日本語",), ("123 45",), ("!",), (None,), ("ok",)], "x string")
    assert [r[0] for r in df.select(translation.suspicious("x")).collect()] == [False, True, True, True, False]
    assert [r[0] for r in df.select(translation.suspicious("x", strict_compat=True)).collect()][0] is True


def test_gate_without_scores(spark):
    df = spark.createDataFrame([("hello there", "hola allí", None, None)], "original_text string, translation string, semantic_similarity double, back_translation_similarity double")
    r = translation.gate(df).first()
    assert (r.quality_stage, r.keep) == ("accept", True)


# -- rows ------------------------------------------------------------------------------------------------
def test_rows(spark):
    df = spark.createDataFrame([(1, "A", None), (2, " ", "x")], "id int, Name string, v string")
    assert rows.first_existing(df, ["q", "NAME"]) == "Name" and rows.first_existing(df, ["q"]) is None
    with pytest.raises(ValueError, match="missing columns: z"):
        rows.complete(df, ["id", "z"])
    assert rows.all_present(df, ["Name"]).count() == 1
    assert rows.after_last(df, "id", F.col("id") == 9).count() == 2


def test_scorer(spark):
    def scorer():
        import numpy as np

        return lambda texts: np.array([len(t) for t in texts], dtype="float64")

    df = spark.createDataFrame([("ab",), ("abcd",)], "t string")
    assert sorted(r.score for r in filters.scored(df, "t", scorer).collect()) == [2.0, 4.0]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "x double, y int, p int, s string")
    assert aggregates.classification(aggregates.confusion(empty, "y", "p")).first().accuracy == 0.0
    assert aggregates.histogram(empty, "x", 10).count() == 0
    assert aggregates.length_distribution(empty, "s").count() == 1


# -- sources ----------------------------------------------------------------------------------------------
def test_catalog_files(spark, tmp_path):
    lines = [{"id": i, "name": "n", "header": h, "types": t, "rows": r} for i, h, t, r in fixtures.TABLES]
    path = tmp_path / "tables.jsonl"
    path.write_text("\n".join([json.dumps(x, ensure_ascii=False) for x in lines] + ["{broken"]))
    t = catalog.read_tables(spark, str(path))
    assert t.count() == 3
    assert catalog.find_table(t, "table_1_310_2").first().header[0] == "Pick #"
    bird = tmp_path / "bird.json"
    bird.write_text(json.dumps([{"question": " q ", "SQL": "SELECT 1"}, {"question": None, "SQL": "x"}, {"db_id": "d", "question": "r", "SQL": "SELECT 2"}]))
    assert sorted(one(catalog.read_bird(spark, str(bird)), "db_id", "question")) == [("", "q"), ("d", "r")]
    out = str(tmp_path / "x.csv")
    catalog.write_csv(spark.createDataFrame([("a\nb", 'say "hi", ok')], "x string, y string"), out)
    assert one(catalog.read_any(spark, out), "x", "y") == [("a\nb", 'say "hi", ok')]


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    catalog.append_once(spark.range(3), path, "id")
    catalog.append_once(spark.range(5), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_sqlite_and_dumps(spark, tmp_path):
    db = str(tmp_path / "a b.db")
    con = sqlite3.connect(db)
    con.executescript('CREATE TABLE "t 1"(i INTEGER, r DECIMAL(4,1), s VARCHAR(9)); INSERT INTO "t 1" VALUES (1, 2.5, \'x\'), (NULL, NULL, NULL), (3, 1, \'é\');')
    con.commit()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x_dump.sql").write_text("\n".join(con.iterdump()))
    con.close()
    sqlite_source.register(spark)
    df = spark.read.format("sqlite").option("path", db).option("table", "t 1").load()
    assert df.dtypes == [("i", "bigint"), ("r", "double"), ("s", "string")]
    assert sorted(map(tuple, df.collect()), key=str) == [(1, 2.5, "x"), (3, 1.0, "é"), (None, None, None)]
    rows_ = spark.read.format("sqldump").option("path", str(tmp_path / "d")).load().collect()
    assert [r.table for r in rows_] == ["t 1"] * 3 and json.loads(rows_[0].data) == {"i": 1, "r": 2.5, "s": "x"}
    assert sqlite_source.catalog(db) == {"t 1": [("i", "INTEGER"), ("r", "DECIMAL(4,1)"), ("s", "VARCHAR(9)")]}


# -- streams ------------------------------------------------------------------------------------------------
def test_stream_of_drops(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "t": "one two"}\n{"id": 2, "t": ""}\n')

    def run():
        stream = drops.read_drops(spark, source, "id int, t string")
        drops.write_batches(stream, out, mark, lambda b: b.withColumn("n", text.word_count("t")), lambda b: b.filter("n > 0")).awaitTermination()

    run()
    (tmp_path / "in" / "b.json").write_text('{"id": 3, "t": "x"}\n')
    run()
    assert sorted(one(spark.read.parquet(out), "id", "n", "batch")) == [(1, 2, 0), (3, 1, 1)]


def test_windowed_counts(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:{m:02d}:00", "k": k}) for m, k in ((1, "a"), (2, "a"), (3, "b"), (11, "a"), (55, "b"))))
    stream = drops.read_drops(spark, source, "ts timestamp, k string")
    counted = drops.windowed_counts(stream, "ts", "k").select(F.col("window.start").cast("string").alias("start"), "k", "count")
    counted.writeStream.format("memory").queryName("counted").outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = {(r.start[11:16], r.k, r["count"]) for r in spark.table("counted").collect()}
    assert got >= {("00:00", "a", 2), ("00:00", "b", 1), ("00:10", "a", 1), ("00:50", "b", 1)}


def test_sql_functions(spark):
    from pairforge.functions.register import register

    register(spark)
    fixtures.queries(spark).createOrReplaceTempView("fixture_queries")
    got = spark.sql("SELECT row_id, collect_list(name) AS names FROM fixture_queries, LATERAL sql_names(sql) WHERE row_id IN (2, 8) GROUP BY row_id").collect()
    assert {r.row_id: sorted(r.names) for r in got} == {2: ["table_1_204_7", "years in club"], 8: ["college", "laval", "table_1_310_2", "team", "with"]}
    assert spark.sql("SELECT count(*) FROM sql_tokens('SELECT a, b FROM t')").first()[0] == 6
    assert tuple(spark.sql("SELECT word_count(' a  b '), squeeze(' a  b '), edit_ratio('ab', 'ac'), subquery_count('( SELECT 1)')").first()) == (2, "a b", 0.5, 1)


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_quantiles_by_brute_force(spark, monkeypatch, small):
    """Ties, one row, a null group, nulls, infinities and outliers that put all other values into one cut."""
    import math
    import random

    import numpy as np

    from pairforge.operators import aggregates

    monkeypatch.setattr(aggregates, "SMALL_BYTES", small)
    rng = random.Random(5)
    rows = [(g, rng.choice([float(rng.randrange(20)), rng.random() * 1000, None])) for g in ("a", "b", None) for _ in range(700)]
    rows += [("one", 4.5), ("same", 2.0), ("same", 2.0), ("empty", None), ("far", 1e300), *[("far", rng.random()) for _ in range(101)], ("inf", math.inf), ("inf", 1.0), ("inf", 2.0)]
    points = (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r.g: r for r in aggregates.percentiles(df, "x", points, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = sorted(x for k, x in rows if k == g and x is not None)
        for p in points:
            have, r = got[g][f"p{round(100 * p)}"], p * (len(values) - 1)
            if not values:
                assert have is None
            elif values[math.floor(r)] == values[math.ceil(r)]:
                assert have == values[math.floor(r)]
            elif math.isfinite(values[math.ceil(r)]):
                assert have == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert aggregates.percentiles(df, "x", (0.5,)).first().p50 == pytest.approx(np.quantile([x for _, x in rows if x is not None], 0.5))
    assert aggregates.percentiles(df.limit(0), "x", (0.5,), ["g"]).count() == 0
    plan = aggregates.describe(df, "x", ["g"])._jdf.queryExecution().executedPlan().toString()
    # sketches of fixed size are right, the built-in that gathers a group's values is not
    assert "percentile" not in plan.replace("percentile_approx", "") and "median" not in plan.replace("AS median", "")


def test_stop_words_are_counted_as_one_by_one(spark):
    """Words that several languages have, ties, scripts, marks and nulls: the same as one search for each language."""
    import re as r

    texts = ["the la de que des les", "de la", "la les le des des et", "Der die das und der", "és es en", "la ĺa the", "what? é", "câte sunt și", "мир the", "їжа the", "日本 the", "日本の the", "", None, "THE_the the", "mañana İs is"]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", translation.detected_language("x").alias("a")).orderBy("i").collect()

    def plain(t):
        if t is None:
            return None
        scripts = {"hi": "[ऀ-ॿ]", "ja": "[぀-ヿ]", "zh": "[一-鿿]", "kk": "[әғқңөұүһӘҒҚҢӨҰҮҺ]", "uk": "[іїєґІЇЄҐ]", "ru": "[Ѐ-ӿ]"}
        script = next((k for k, s in scripts.items() if r.search(s, t)), None)
        words = r.findall(r"(?:\w|[̀-ͯ])+", t.lower())
        counts = {k: sum(w in ws for w in words) for k, ws in translation.STOP_WORDS.items()}
        best = max(counts.values())
        return script or (next(k for k, n in counts.items() if n == best) if best else None)

    assert [x.a for x in out] == [plain(t) for t in texts]
    plan = spark.range(1).selectExpr("cast(id as string) as x").repartition(2).select(translation.detected_language("x").alias("l"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") == 1, plan


def test_plain_names_are_replaced_as_by_one_expression():
    """Names that touch, lie within each other, or repeat."""
    import random
    import re as r

    from pairforge.functions.similarity import replace_longest_first

    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("aB _.b") for _ in range(14))
        names = {"".join(draw.choice("abB .") for _ in range(draw.randint(1, 4))): f"<{i}>" for i in range(3)}
        known = {k.lower(): v for k, v in names.items()}
        pattern = "|".join(r.escape(k) for k in sorted(known, key=lambda k: (-len(k), k)))
        want = r.sub(rf"(?i)(?<!\w)(?:{pattern})(?!\w)", lambda m: known[m[0].lower()], text)
        assert replace_longest_first(text, names) == want, (text, names)


def test_names_compile_no_expressions(monkeypatch):
    from pairforge.functions import similarity

    monkeypatch.setattr(similarity.re, "sub", lambda *a: pytest.fail("an expression for each row"))
    assert similarity.replace_longest_first("deal of Customer#1", {"customer#1": "X"}) == "deal of X"


def test_keywords_are_compiled_once(monkeypatch):
    corruption.upper_keywords("select 1")
    monkeypatch.setattr(corruption.re, "sub", lambda *a, **k: pytest.fail("an expression for each row"))
    assert corruption.upper_keywords("select 'from' from t") == "SELECT 'from' FROM t"
    read = []
    monkeypatch.setattr(corruption, "eligible", lambda q: read.append(q) or [])
    assert all(corruption.corrupt("SELECT a FROM t", str(i), rate=0.0) == ("SELECT a FROM t", 0) for i in range(9)) and not read


def test_rows_of_a_large_group_stay_where_they_are(spark, monkeypatch):
    """Brackets come to the rows: no join puts all rows of a group in one task."""
    monkeypatch.setattr(aggregates, "SMALL_BYTES", 0)
    df = spark.range(300_000, numPartitions=4).selectExpr("if(id % 3 = 0, null, id % 2) as g", "pmod(id * 7919, 100003) / 4 as x")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = aggregates.quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], ["g"])
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r._group.g: r.q for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    want = df.groupBy("g").agg(F.expr("percentile(x, array(0.0, 0.25, 0.5, 1.0))").alias("q")).collect()
    assert got == {r.g: pytest.approx(r.q) for r in want}


def test_a_text_is_sent_once(spark):
    """A query's text travels once, whatever number of tables it names; queries without a table keep their row."""
    import random
    import time

    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    many = " ".join(f"table_1_1_{k}" for k in range(60))
    df = spark.createDataFrame([(1, f"{many} {noise}"), (2, "none"), (3, None), (4, "table_9_9_9 table_1_1_7 table_1_1_3")], "row_id int, sql string")
    known = spark.createDataFrame([(f"1-1-{k}", k) for k in range(3, 60)], "id string, item_id int")

    def sent():
        time.sleep(1)
        return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = sent()
    kept = {r.row_id: r for r in rows.with_table(df, known, "sql").collect()}
    assert sent() - before < 2_000_000
    assert {k: r.item_id for k, r in kept.items()} == {1: 3, 2: None, 3: None, 4: 7} and kept[1].sql.endswith(noise)
