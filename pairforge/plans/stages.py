"""The stages of a dataset run: generate, filter, evolve, translate, judge.

Stages are functions of DataFrames; each carries whole rows and joins a row to
its own table by id. Models are injected as functions of text that a worker
makes once (``factory() -> function``); the defaults are rules, so that a run
without models is repeatable.
"""

from __future__ import annotations

import json
import re
import sqlite3
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.functions import answers
from pairforge.functions.udf import vectorised
from pairforge.operators import evolution, filters, rows, translation
from pairforge.operators.corruption import Draw
from pairforge.plans import plain
from pairforge.plans.dialect import rename_table, to_physical
from pairforge.plans.runner import SENT, ExecResult, by_query, correct, load_sqlite, run_plain, run_sqlite, same_result, with_tables

TextModel = Callable[[str], str]

GENERATED = "table_id string, nl string, sql string, db_sql string, db_result array<string>, db_result_truncated boolean, db_result_rows bigint, reasoning string, seeding_type string, seeding_value string, attempts int"
#: Batch experiments: which answer comes first, what seeds the query, or how a judge chooses.
STRATEGIES = ("sql_to_nl", "nl_to_sql", "length", "persona", "judge_select", "judge_score")


def prompt(header: Sequence[str], types: Sequence[str], name: str, seeding: str, value: str, error: str | None) -> str:
    """What a generator reads: the table, the seeding, and the last error."""
    lines = [f"Table: {name}", "Columns:", *[f"  - {h} ({t.upper()})" for h, t in zip(header, types, strict=False)], f"Seeding: {seeding} = {value}"]
    return "\n".join(lines + ([f"The last query failed: {error}"] if error else []))


def rule_generator() -> TextModel:
    """The default: counts rows, grouped by the first text column."""

    def write(text: str) -> str:
        name = re.search(r"^Table: (.*)$", text, re.M)[1]
        column = next((m[0] for m in re.findall(r"^  - (.*) \((\w+)\)$", text, re.M) if m[1] in ("TEXT", "STRING")), None)
        if column is None:
            return json.dumps({"sql_query": f'SELECT COUNT(*) FROM "{name}"', "question": "How many rows are there?"})
        return json.dumps({"sql_query": f'SELECT `{column}`, COUNT(*) FROM "{name}" GROUP BY `{column}` ORDER BY 1', "question": f"How many rows are there for each {column}?"})

    return write


def generate(tables: DataFrame, factory: Callable[[], TextModel] = rule_generator, most: int = 3, personas: Sequence[str] = ("analyst", "student"), lengths: tuple[int, int] = (3, 20), seed: int = 42, seeding: str | None = None) -> DataFrame:
    """One generated row for each table: generate, run, and correct with the error up to ``most`` times.

    Tables alternate between keyword and persona seeding by ``pos``, unless
    ``seeding`` names one kind for all. The query
    that is returned is the one whose result is returned: its first 10,000 rows, and the number of all.
    Tables without a result after all attempts give no row.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                header, types, data = list(t.header), list(t.types), [list(r) for r in t.rows]
                con = sqlite3.connect(":memory:")
                load_sqlite(con, t.name, header, types, data)
                draw = Draw(seed, t.id)
                kind = seeding or ("reserved" if t.pos % 2 == 0 else "persona")
                if kind in ("reserved", "length"):
                    value = str(lengths[0] + int(draw.uniform() * (lengths[1] - lengths[0] + 1)))
                else:
                    value = draw.pick(list(personas)) if kind == "persona" else {"sql_to_nl": "query first", "nl_to_sql": "question first"}[kind]
                said: dict = {}

                def ask(error: str | None) -> str:
                    text = model(prompt(header, types, t.name, kind, value, error))
                    got = answers.load_loose(text)
                    said.clear()
                    said.update(got if isinstance(got, dict) else {})
                    fence = re.search(r"(?s)```(?:sql)?\s*(.*?)```", text)
                    return str(said.get("sql_query") or said.get("query") or (fence[1] if fence else text)).strip()

                sql, result, attempts = correct(ask, lambda q: run_sqlite(con, q), most)
                con.close()
                if result.status == "rows":
                    db = to_physical(sql, header, t.name)
                    out.append((t.id, said.get("question"), sql, db, [json.dumps(r, ensure_ascii=False, default=str) for r in result.rows], result.truncated, result.digests.n_rows if result.digests else len(result.rows), said.get("reasoning"), kind, value, attempts))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in GENERATED.split(", ")])

    return tables.select("id", "name", "header", "types", "rows", "pos").mapInPandas(work, GENERATED)


def experiment(
    tables: DataFrame,
    strategy: str,
    first: int = 100,
    factory: Callable[[], TextModel] = rule_generator,
    judge: Callable[[], Callable[[list[str]], tuple[float, str]]] | None = None,
    tries: int = 3,
    seed: int = 42,
) -> DataFrame:
    """One of the batch experiments over the first tables by ``pos``; rows as of :func:`generate`, with ``strategy``.

    ``judge()`` makes a function of a table's candidate queries. For
    ``judge_select`` it gives the number of the best and its text, which has to
    resemble that candidate; for ``judge_score`` it gives a score of one
    candidate, and the first of ``1 + tries`` with 90 or more is kept.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no strategy {strategy!r}")
    some = rows.top(tables, first, "pos", ascending=True)
    if not strategy.startswith("judge"):
        return generate(some, factory, tries, seed=seed, seeding=strategy).withColumn("strategy", F.lit(strategy))
    if judge is None:
        raise ValueError("a judge is needed")
    made = [generate(some, factory, tries, seed=seed + k).withColumn("attempt", F.lit(k)) for k in range(tries + (strategy == "judge_score"))]
    candidates = made[0]
    for m in made[1:]:
        candidates = candidates.unionByName(m)

    @vectorised("number double, text string")
    def asked(options: pd.Series) -> pd.DataFrame:
        model = judge()
        return pd.DataFrame([model(list(o)) for o in options], columns=["number", "text"])

    if strategy == "judge_score":
        scored = candidates.withColumn("_score", asked(F.array("sql"))["number"])
        kept = filters.first_kept(scored, "table_id", "attempt", filters.judge_gate("_score"), tries + 1)
        return kept.select(*made[0].drop("attempt").columns).withColumn("strategy", F.lit(strategy))
    # a table has a few candidates, so its group is bounded
    whole = F.struct(*made[0].drop("attempt").columns)
    by_table = candidates.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt", whole.alias("row")))), lambda x: x["row"]).alias("_all"))
    said = by_table.withColumn("_options", F.transform("_all", lambda x: x["sql"])).withColumn("_said", asked("_options"))
    picked = said.withColumn("_i", F.col("_said.number").cast("int")).withColumn("_text", F.col("_said.text")).withColumn("_hit", filters.judged("_options", "_i", "_text"))
    best = picked.filter("_hit is not null").select(F.get("_all", F.col("_i")).alias("r"))
    return best.select("r.*").withColumn("strategy", F.lit(strategy))


def choose(df: DataFrame, predicted: str, reward: str, response: str) -> DataFrame:
    """Route by ambiguity, filter by the route's score, keep what passes."""
    routed = df.withColumn("option", filters.route(predicted))
    return filters.filtered(routed, "option", reward, response).filter("keep").drop("keep", "option")


# -- evolution ------------------------------------------------------------------------------------
EVOLVED = "schema_change_type string, new_table_id string, new_sql string, status string, db_result_after_change array<string>, db_result_truncated boolean, db_query_match boolean, accepted boolean"


def rule_change(header: Sequence[str], types: Sequence[str], kind: str, draw: Draw) -> evolution.Change:
    """The default change of a kind, for any table."""
    column = draw.pick(list(header))
    if kind == "add_column":
        return evolution.Change(kind, new={"Note": ("a", "b", "c")})
    if kind == "rename_column":
        return evolution.Change(kind, names={column: f"{column} (renamed)"})
    if kind == "split_column":
        return evolution.Change(kind, columns=(column,), new={f"{column} 1": (), f"{column} 2": ()}, separator=" ")
    if kind == "merge_column" and len(header) > 1:
        pair = tuple(draw.sample(list(header), 2))
        return evolution.Change(kind, columns=pair, new={" and ".join(pair): ()})
    return evolution.Change("remove_column", columns=(column,))


def evolve(df: DataFrame, tables: DataFrame, make=rule_change, kinds: Sequence[str] = evolution.KINDS[:5], seed: int = 42, key: str = "row_id", sql: str = "sql", most: int = 10_000) -> DataFrame:
    """Each row's table changed, its query repaired and run on the changed table.

    ``make(header, types, kind, draw)`` gives the change; the kind is a seeded
    choice for each row. Values of untouched columns are kept by construction
    and checked for the number of rows. Whole results are compared as multisets;
    ``db_result_after_change`` holds the first ``most`` rows. In a group, each changed table is
    made once, and equal queries are run once on each table; plain filters over columns that
    a change leaves as they are have one answer on both tables.
    """
    kept = df.schema.fields
    schema = T.StructType([*kept, *T._parse_datatype_string(EVOLVED).fields])
    names = [f.split()[0] for f in EVOLVED.split(", ")]
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked = by_query(batch.column(0)[i].values, sql)
                name, header, types, data = (c[i].as_py() for c in batch.columns[1:])
                if header is None:
                    for begin in range(0, len(asked), SENT):
                        yield sent((r, (None, None, None, "error", [], False, None, False)) for r in asked.slice(begin, SENT).to_pylist())
                else:
                    out = []
                    for row in group(asked, name, header, types or [], data or []):
                        out.append(row)
                        if len(out) == SENT:
                            yield sent(out)
                            out = []
                    if out:
                        yield sent(out)

    def sent(found: Iterable[tuple[dict, tuple]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([r | dict(zip(names, x, strict=True)) for r, x in found], schema=arrow)

    def group(asked: pa.Array, name: str, header: list[str], types: list[str], data: list[list]) -> Iterator[tuple[dict, tuple]]:
        """The rows of a group change by change, and within one query by query."""
        changes: dict[tuple, tuple[evolution.Change, list[int]]] = {}
        for at, (k, parent) in enumerate(zip(pc.struct_field(asked, key).to_pylist(), pc.struct_field(asked, "table_id").to_pylist(), strict=True)):
            draw = Draw(seed, str(k))
            change = make(header, types, draw.pick(list(kinds)), draw)
            new_id = evolution.derived_id(parent, change, seed)
            changes.setdefault((new_id, change.table, change.separator), (change, []))[1].append(at)
        base = sqlite3.connect(":memory:")
        load_sqlite(base, name, header, types, data)
        base.commit()  # a copy waits for open transactions
        held = plain.Table(base, name)
        seen: dict = {}
        before: dict[str | None, ExecResult] = {}
        for (new_id, _, _), (change, places) in changes.items():
            new_name = "table_" + new_id.replace("-", "_")
            con, changed, last = None, None, None
            repaired = evolution.repeated_repair(change, lambda q, new_name=new_name: rename_table(q, name, new_name))
            for begin in range(0, len(places), SENT):
                for r in asked.take(pa.array(places[begin : begin + SENT])).to_pylist():
                    q = r[sql]
                    if last is None or last[0] != q:
                        new_sql = repaired(q)
                        if new_sql == evolution.UNANSWERABLE:
                            last = q, (change.kind, new_id, new_sql, evolution.UNANSWERABLE, [], False, None, False)
                        else:
                            if con is None:
                                con = sqlite3.connect(":memory:")
                                base.backup(con)
                                load_sqlite(con, new_name, *evolution.evolve_rows(header, types, data, change, seed))
                                changed = plain.Table(con, new_name, held)
                            if q not in before:
                                before[q] = run_plain(held, q, 0, seen) or run_sqlite(base, q, most=0, seen=seen)
                            after = run_plain(changed, new_sql, most, seen) or run_sqlite(con, new_sql, most=most, seen=seen)
                            good = after.status == "rows" if change.kind in ("add_column", "rename_column") else after.status != "error"
                            last = q, (change.kind, new_id, new_sql, after.status, [json.dumps(x, ensure_ascii=False, default=str) for x in after.rows], after.truncated, same_result(before[q], after), good)
                    yield r, last[1]
            if con is not None:
                con.close()
        base.close()

    return with_tables(df, tables, sql=sql).mapInArrow(work, schema)


# -- translation -------------------------------------------------------------------------------------
def translate(df: DataFrame, translations: DataFrame, key: str = "row_id", languages: Sequence[str] = translation.LANGUAGES, most: int = 3) -> DataFrame:
    """Every row in every language: the first candidate that the gate keeps; rows without one are dropped.

    ``translations`` has (key, lang, attempt, translation, semantic_similarity,
    back_translation_similarity).
    """
    wanted = translation.fan_out(df, languages).join(translations, [key, "lang"]).withColumn("original_text", F.col("nl"))
    gated = translation.gate(wanted)
    return filters.first_kept(gated.withColumn("_id", F.concat_ws(":", key, "lang")), "_id", "attempt", F.col("keep"), most).drop("_id")


def rule_entities(text: str) -> list[tuple[str, str, int, int]]:
    """The default recogniser: runs of capitalised words beyond a sentence's first, and quoted names."""
    out = []
    for m in re.finditer(r"(?<![.!?]\s)(?<!^)\b[A-ZÀ-Þ][\w'-]+(?:\s+[A-ZÀ-Þ][\w'-]+)*", text):
        out.append((m[0], "NAME", m.start(), m.end()))
    out += [(m[1], "QUOTED", m.start(1), m.end(1)) for m in re.finditer(r"[\"“']([^\"”']{3,})[\"”']", text)]
    return sorted(set(out), key=lambda e: e[2:])


def entities(df: DataFrame, column: str, factory: Callable[[], Callable[[str], list[tuple[str, str, int, int]]]] | None = None, excluded: Sequence[str] = ("CARDINAL", "DATE", "ORDINAL", "PERCENT", "QUANTITY", "TIME")) -> DataFrame:
    """Add ``entities`` (text, label, start, end): merged, without excluded labels and short texts."""

    @vectorised("array<struct<text:string,label:string,start:int,end:int>>")
    def recognise(x: pd.Series) -> pd.Series:
        model = factory() if factory else rule_entities
        return x.map(lambda t: [{"text": a, "label": b, "start": c, "end": d} for a, b, c, d in (model(t) if t else []) if b not in excluded])

    found = df.withColumn("_e", recognise(F.col(column)))
    return found.withColumn("entities", translation.merged_entities(F.col("_e"))).drop("_e")


# -- judging --------------------------------------------------------------------------------------------
def relaxed_match(judge_answer: str) -> Column:
    """1 or 0 from a judge's answer on equivalence: a JSON flag, else a score, else the words used; null if none."""
    x = F.col(judge_answer)
    body = answers.fenced(x, "json")
    flag = F.coalesce(F.get_json_object(body, "$.equivalent"), F.get_json_object(body, "$.match"), F.get_json_object(body, "$.result"))
    low = F.lower(x)
    said = F.when(low.rlike(r"\b(not equivalent|no match|different|false|no)\b"), 0.0).when(low.rlike(r"\b(equivalent|match|same|true|yes)\b"), 1.0)
    named = F.when(flag.isNotNull(), F.when(answers.truthy(flag), 1.0).otherwise(0.0))
    return F.coalesce(named, (answers.score_of(x) >= 0.5).cast("double"), said)


def judged_match(df: DataFrame, gold: str, predicted: str, factory: Callable[[], TextModel]) -> DataFrame:
    """Add ``answer`` and ``relaxed`` by an injected judge of query pairs; equal queries are not asked about."""

    @vectorised("string")
    def ask(a: pd.Series, b: pd.Series) -> pd.Series:
        model = factory()
        known: dict[tuple, str] = {}
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = model(f"Gold: {pair[0]}\nPredicted: {pair[1]}")
        return pd.Series([known[pair] for pair in zip(a, b, strict=True)], dtype=object)

    from pairforge.functions.text import same_squeezed

    same = F.coalesce(same_squeezed(gold, predicted), F.lit(False))
    equal = df.filter(same).withColumn("answer", F.lit('{"equivalent": true}')).withColumn("relaxed", F.lit(1.0))
    rest = df.filter(~same).withColumn("answer", ask(F.col(gold), F.col(predicted)))
    return equal.unionByName(rest.withColumn("relaxed", relaxed_match("answer")))


def timed(df: DataFrame, methods: Mapping[str, Callable[[DataFrame], DataFrame]]) -> list[tuple[str, float]]:
    """Seconds that each method takes over the whole of a frame."""
    out = []
    for name, method in methods.items():
        begin = time.perf_counter()
        method(df).write.format("noop").mode("overwrite").save()
        out.append((name, time.perf_counter() - begin))
    return out


def resume(df: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """What is left of a run."""
    return rows.unprocessed(df, done, key)


__all__ = ["ExecResult", "choose", "entities", "evolve", "experiment", "generate", "judged_match", "relaxed_match", "resume", "timed", "translate"]
