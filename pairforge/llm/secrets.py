"""Secret scans: fixed patterns and character Markov models.

All of it is DataFrame expressions. Three base kinds are regular expressions.
The method adds a fourth kind, ``markov``: runs of characters as keys have them
are compared under two first-order character models, one trained from random
strings and one from ordinary identifiers; where the mean log-likelihood ratio
for a character is above a threshold, the run is a span. Where it is not, as
words stand beside a key in the run, the stretches of the run with the highest
sums of ratios are judged in its place. Texts are only cut up where a cheap test
has found a match.

Positions are code points, the end exclusive. A text is split by the pattern
and the lengths of the pieces and of the matches between them give the places.

Defined cases: a null text is empty and has no spans; very long texts are scanned
whole; repeated rows give equal results; an empty table gives an empty result;
:func:`scan` returns its own columns only and :func:`redact` the input's.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base kinds in their order, as (kind, pattern, quick test, group, least length).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

#: Runs that the models judge: characters of keys, so many at least.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Mean log-likelihood ratio for a character, in nats, above which a run is a secret.
THRESHOLD = 0.35
#: Least characters of a stretch that is judged on its own.
LEAST = 20
#: Nats above the threshold: a stretch ends where its sum has fallen by ``DROP`` and is looked at from ``GAIN`` on.
DROP, GAIN = 8.0, 4.0

#: Matches of a text that are placed together.
STRETCH = 256

#: Fixed value: the models' alphabet; all other characters share one further class.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1

#: Fixed value: words of which the ordinary identifiers of the sample are made.
WORDS = (
    "account action active address after amount answer array author backup balance base before billing block body branch buffer button cache "
    "call cancel category center change channel check child class client clear close code color column command comment commit common config "
    "connection content context control convert copy count create credit current customer data date debug default delete detail device dialog "
    "direct document domain download draft edit email empty enable end engine entity entry error event example exception execute export field "
    "file filter final first folder format found frame function general get global grade group handle handler header height hidden history home "
    "image import index info initial input insert instance internal invoice item key label language last layout left length level library limit "
    "line link list load local location login main manager map master match maximum member memory menu message method minimum model module "
    "month move name network next node note notice number object offer office open option order origin output owner package page panel parent "
    "parse part path pattern payment people period person phone picture place plan player point policy position post power previous price print "
    "private process product profile program project property provider public query question queue quick random range rate read reason record "
    "region release remote remove render report request reset resource response result return right role root row rule sample save scale schedule "
    "schema screen script search section select sequence serial server service session set setting share show sign simple single size sort source "
    "space start state status step stock stop store stream string style subject submit summary support system table target task team template "
    "test text theme thread time title tool total trace transfer tree type unit update upload user value version view visible week weight widget "
    "width window word work write year zone"
).split()


def labelled_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(sample, is_secret): seeded random strings and identifiers of words.

    Any labelled table of the same two columns can take its place.
    """
    words = F.array(*map(F.lit, WORDS))
    ids = spark.range(n)

    def word(salt: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(WORDS))) + 1).cast("int"))

    def digest(salt: int) -> Column:
        return F.sha2(F.concat_ws(":", F.lit(salt), "id"), 256)

    kind = F.pmod("id", F.lit(3))
    random = F.when(kind == 0, F.substring(digest(1), 1, 40)).otherwise(F.translate(F.substring(F.base64(F.unhex(digest(2))), 1, 40), "+/=", "9aZ"))
    random = F.when(kind == 1, F.regexp_replace(F.base64(F.unhex(digest(3))), "=", "")).otherwise(random)
    camel = F.concat(word(4), F.initcap(word(5)), F.initcap(word(6)), F.initcap(word(7)))
    ordinary = F.when(kind == 0, F.concat_ws("_", word(4), word(5), word(6), word(7))).when(kind == 1, camel).otherwise(F.concat(word(4), word(5), F.lit("-"), word(6), F.lit("/"), word(7), F.pmod("id", F.lit(100)).cast("string")))
    return ids.select(random.alias("sample"), F.lit(True).alias("is_secret")).union(ids.select(ordinary.alias("sample"), F.lit(False).alias("is_secret")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, row by row.

    Counts with one added are gathered for (label, class, class): at most
    2 * 68 * 68 numbers, whatever the sample's size.
    """
    pairs = samples.select("is_secret", "sample", F.explode(F.expr("sequence(1, length(sample) - 1)")).alias("i")).filter("length(sample) > 1")
    classes = pairs.select("is_secret", F.expr(f"instr('{ALPHABET}', substring(sample, i, 1))").alias("a"), F.expr(f"instr('{ALPHABET}', substring(sample, i + 1, 1))").alias("b"))
    counts = {(r.is_secret, r.a, r.b): r.n for r in classes.groupBy("is_secret", "a", "b").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratios = []
    for a in range(CLASSES):
        sums = {k: sum(counts.get((k, a, b), 0) for b in range(CLASSES)) for k in (True, False)}
        for b in range(CLASSES):
            p, q = ((counts.get((k, a, b), 0) + 1) / (sums[k] + CLASSES) for k in (True, False))
            ratios.append(log(p / q))
    return ratios


_SPANS = "array<struct<begin:int,end:int,kind:int>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _places(text: str, pattern: str, test: str, kind: int, keep: str = "true", parts: str | None = None) -> Column:
    """Spans of the matches that ``keep`` accepts (over ``m``: the match, ``v``: its second group or itself).

    With ``parts``, an array of (begin, end) within the match, these are the spans.
    """
    group = 2 if kind == 0 else 0
    p = _quoted(pattern)
    found = (
        f"zip_with(split({text}, {p}, -1), zip_with(regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group}), (m, v) -> struct(m, v)), "
        f"(gap, x) -> struct(length(gap) as gap, x.m as m, x.v as v))"
    )
    parts = parts or "array(struct(0 as begin, length(x.m) as end))"
    # by stretches of matches, so that no array grows match by match over a whole text
    stretches = f"transform(sequence(0, cast((size(f) - 1) / {STRETCH} as int)), j -> slice(f, {STRETCH} * j + 1, {STRETCH}))"
    within = (
        f"transform({stretches}, c -> aggregate(c, struct(0 as at, cast(array() as {_SPANS}) as spans), (s, x) -> struct("
        f"cast(s.at + x.gap + coalesce(length(x.m), 0) as int) as at, "
        f"case when x.m is not null and {keep} then concat(s.spans, transform({parts}, part -> struct(cast(s.at + x.gap + part.begin as int) as begin, cast(s.at + x.gap + part.end as int) as end, {kind} as kind))) "
        f"else s.spans end as spans)))"
    )
    moved = "transform(c.spans, y -> struct(cast(s.at + y.begin as int) as begin, cast(s.at + y.end as int) as end, y.kind as kind))"
    spans = _let("f", found, f"flatten(aggregate({within}, struct(0 as at, cast(array() as array<{_SPANS}>) as done), (s, c) -> struct(cast(s.at + c.at as int) as at, concat(s.done, array({moved})) as done), s -> s.done))")
    return F.expr(f"case when {text} rlike {_quoted(test)} then {spans} else cast(array() as {_SPANS}) end")


def scan(df: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``_text`` and ``spans``: array of (begin, end, kind) by begin, then kind."""
    if ratios is None:
        ratios = train(labelled_samples(df.sparkSession))
    base = df.select(*keep, F.coalesce(df[text], F.lit("")).alias("_text"))
    base = base.withColumn("_assign", _places("_text", ASSIGN, ASSIGN, 0, "length(x.v) >= 6"))
    base = base.withColumn("_access", _places("_text", ACCESS, ACCESS, 1, "true"))
    base = base.withColumn("_hex", _places("_text", HEX, HEX, 2, "true"))
    base = base.withColumn("_markov", _judged(ratios, threshold))
    # structs sort by their fields in order, so kind stands before end meanwhile
    spans = F.expr("transform(array_sort(transform(concat(_assign, _access, _hex, _markov), x -> struct(x.begin as begin, x.kind as kind, x.end as end))), x -> struct(x.begin as begin, x.end as end, x.kind as kind))")
    return base.select(*keep, "_text", spans.alias("spans"))


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _scanned(items: str, fields: dict[str, tuple[str, str]], kind: str, step: str, last: str | None = None) -> str:
    """What ``step`` emits over an array, in order.

    ``fields``: the state's (start, type) by name; ``step``: the next state over ``s`` (the state), ``v`` (an item)
    and ``emit`` (an array of what is emitted, in its field ``out``). Items are met by stretches, as an array that grew item by item
    would be copied each time. ``last`` is emitted at the end, over ``s``.
    """
    start = ", ".join(f"cast({value} as {t}) as {name}" for name, (value, t) in fields.items())
    kept = ", ".join(f"s.{name} as {name}" for name in fields)
    moved = ", ".join(f"r.{name} as {name}" for name in fields)
    stretches = f"transform(sequence(0, cast((size(a) - 1) / {STRETCH} as int)), j -> slice(a, {STRETCH} * j + 1, {STRETCH}))"
    inner = f"aggregate(c, struct({kept}, cast(array() as array<{kind}>) as out), (s, v) -> {step})"
    outer = f"aggregate({stretches}, struct({start}, cast(array() as array<array<{kind}>>) as done), (s, c) -> {_let('r', inner, f'struct({moved}, concat(s.done, array(r.out)) as done)')}, s -> flatten({f'concat(s.done, array({last}))' if last else 's.done'}))"
    return _let("a", items, f"case when size(a) > 0 then {outer} else cast(array() as array<{kind}>) end")


_PART = "struct<begin:int,end:int>"


def _judged(ratios: list[float], threshold: float) -> Column:
    """Spans of the models: each run costs time in proportion to its length, however many stretches it has.

    ``k`` are a run's characters as places in the alphabet, ``g`` the ratios of its pairs, ``p`` the places of its signs
    and ``n`` how many signs stand before each place, so what is looked up is looked up once.
    """
    table = f"array({','.join(f'{x:.3f}D' for x in ratios)})"
    small, capital, sign, plus = 26, 52, ALPHABET.index("+") + 1, ALPHABET.index("+") + 1

    def scores(codes: str) -> str:
        return f"transform(sequence(1, size({codes}) - 1), i -> element_at({table}, 1 + {CLASSES} * element_at({codes}, i) + element_at({codes}, i + 1)))"

    def mean(values: str) -> str:
        return f"aggregate({values}, 0D, (t, r) -> t + r) / size({values})"

    # stretches of pairs, each up to the place of its highest sum above the threshold
    none = f"cast(array() as array<{_PART}>)"
    found = f"case when h.best > {GAIN}D then concat(s.out, array(struct(s.begin as begin, h.end as end))) else s.out end"
    step = _let(
        "h",
        _let("t", f"s.sum + element_at(g, v) - {threshold}D", "struct(t as sum, greatest(s.best, t) as best, case when t > s.best then v + 1 else s.end end as end)"),
        f"case when h.sum <= 0 or h.best - h.sum > {DROP}D then struct(0D as sum, v as begin, 0D as best, 0 as end, {found} as out) "
        "else struct(h.sum as sum, s.begin as begin, h.best as best, h.end as end, s.out as out) end",
    )
    state = {"sum": ("0D", "double"), "begin": ("0", "int"), "best": ("0D", "double"), "end": ("0", "int")}
    stretches = _scanned("sequence(1, size(g))", state, _PART, step, f"case when s.best > {GAIN}D then array(struct(s.begin as begin, s.end as end)) else {none} end")

    def judged(part: str) -> str:
        """The part without signs at its ends, or null where it is no secret."""
        # digits alone are numbers; capitals alone are judged as small letters, as the identifiers have few capitals
        shaped = f"exists(c, x -> x <= {capital}) and (exists(c, x -> x > {capital}) and exists(c, x -> x > {capital} and x < {sign}) or c[0] <= {capital} and c[size(c) - 1] <= {capital})"
        lower = f"transform(c, x -> case when x > {small} and x <= {capital} then x - {small} else x end)"
        value = f"case when exists(c, x -> x <= {small} or x > {capital} and x < {sign}) then {_let('q', 'slice(g, b.begin + 1, b.end - b.begin - 1)', mean('q'))} else {_let('l', lower, _let('q', scores('l'), mean('q')))} end"
        good = _let("c", "slice(k, b.begin + 1, b.end - b.begin)", f"{shaped} and {value} > {threshold}D")
        ends = f"transform(slice(k, w.begin + 1, w.end - w.begin), x -> x < {plus})"
        bare = _let("e", ends, "case when array_position(e, true) > 0 then struct(cast(w.begin + array_position(e, true) - 1 as int) as begin, cast(w.end - array_position(reverse(e), true) + 1 as int) as end) end")
        return _let("w", part, _let("b", bare, f"case when b.end - b.begin >= {LEAST} then case when {good} then b end end"))

    # chance takes characters off a stretch's ends: as far as the next / _ = - it is tried first, once for all stretches in that part
    wide = "struct(cast(case when element_at(n, v.begin + 1) = 0 then 0 else element_at(p, element_at(n, v.begin + 1)) + 1 end as int) as begin, cast(coalesce(get(p, element_at(n, v.end + 1)), size(k)) as int) as end)"
    same = "s.wide is not null and s.wide.begin = o.begin and s.wide.end = o.end"
    emit = "case when f is null or (s.last is not null and s.last.begin = f.begin and s.last.end = f.end) then s.out else concat(s.out, array(f)) end"
    nothing = ("null", _PART)
    choose = _let(
        "o",
        wide,
        _let(
            "t",
            f"case when {same} then s.tried else {judged('o')} end",
            _let("f", f"coalesce(t, {judged('v')})", f"struct(o as wide, t as tried, coalesce(f, s.last) as last, {emit} as out)"),
        ),
    )
    chosen = _scanned(stretches, {"wide": nothing, "tried": nothing, "last": nothing}, _PART, choose)
    # as it is, then without signs at its ends
    whole = "struct(0 as begin, size(k) as end)"
    shaped = "x.m rlike '[0-9]' or x.m rlike '^[A-Za-z].*[A-Za-z]$'"
    lower = f"transform(k, x -> case when x > {small} and x <= {capital} then x - {small} else x end)"
    value = f"case when x.m rlike '[a-z0-9]' then {mean('g')} else {_let('l', lower, _let('q', scores('l'), mean('q')))} end"
    first = f"case when ({shaped}) and {value} > {threshold}D then {whole} else {judged(whole)} end"
    before = _let("d", "split(translate(x.m, '_=-', '///'), '/', -1)", "flatten(transform(d, (y, j) -> array_repeat(j, length(y) + 1)))")
    signs = f"filter(transform(k, (y, j) -> case when y > {sign} then j end), y -> y is not null)"
    tried = _let("f", first, f"case when f is not null then array(f) else {_let('p', signs, _let('n', before, chosen))} end")
    parts = _let("k", f"transform(split(x.m, ''), c -> instr('{ALPHABET}', c))", _let("g", scores("k"), tried))
    return _places("_text", RUN, RUN, 3, "x.m rlike '[A-Za-z]'", parts)


def _joined(spans: str) -> Column:
    names = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at({names}, x.kind + 1), x.begin, x.end)), ',')")


def report(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return scanned.select(*keep, *counts, F.sha2(_joined("filter(spans, x -> x.kind < 3)"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(df: DataFrame, ratios: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The input with every span of its texts replaced by ``mark``; spans that overlap share one."""
    columns = df.columns
    carried = df.select(*[df[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(columns)])
    text = f"_c{columns.index('text')}"
    found = scan(carried, ratios, text=text, keep=tuple(carried.columns))
    cut = F.expr(
        "aggregate(spans, struct(1 as at, '' as done), (s, x) -> case "
        f"when x.begin + 1 >= s.at then struct(cast(x.end + 1 as int) as at, concat(s.done, substring(_text, s.at, x.begin + 1 - s.at), '{mark}') as done) "
        "else struct(cast(greatest(s.at, x.end + 1) as int) as at, s.done as done) end, s -> concat(s.done, substring(_text, s.at)))"
    )
    return found.select(*[(F.when(F.size("spans") > 0, cut).otherwise(F.col(c)) if c == text else F.col(c)).alias(name) for c, name in zip(carried.columns, columns, strict=True)])
