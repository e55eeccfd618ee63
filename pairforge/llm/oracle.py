"""Oracle SQL (DuckDB) of the operators that SQL can express on whole tables."""

from __future__ import annotations

from pairforge.llm.mixing import BLOCK, MOST, SHARD

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d),
k AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(w[p:p + 49], ' ')) < doc_id AS again FROM p),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, 50)) AS i FROM k WHERE again),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
    SELECT word.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY word.i) AS text
    FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i WHERE gone.i IS NULL GROUP BY word.doc_id
)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

MAXSCORE = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS bigint) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, cast(k AS int) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 10
"""


def _seats(name: str, cells: str, keys: list[str], group: str, votes: str, seats: str) -> str:
    """Common table expressions for Sainte-Laguë quotas, by ranking every quotient in question."""
    same = " AND ".join(f"b.{k} IS NOT DISTINCT FROM e.{k}" for k in keys)
    listed = ", ".join(keys)
    return f"""
{name}_b AS (
    SELECT *, cast(CASE WHEN 2 * {seats} > c AND total > 0 THEN floor({votes} / 2 * (2 * {seats} - c) / total + 0.5) ELSE 0 END AS bigint) AS sure,
        cast(CASE WHEN total > 0 THEN floor({votes} / 2 * (2 * {seats} + c) / total + 0.5) ELSE 0 END AS bigint) + 1 AS most
    FROM (SELECT *, sum({votes}) OVER (PARTITION BY {group}) AS total, count(*) OVER (PARTITION BY {group}) AS c FROM {cells})
),
{name}_o AS (SELECT *, {seats} - sum(sure) OVER (PARTITION BY {group}) AS open FROM {name}_b),
{name}_e AS (
    SELECT {listed}, count(*) AS extra FROM (
        SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (2 * seat + 1) DESC, {listed}) AS k
        FROM (SELECT *, unnest(range(sure, most + 1)) AS seat FROM {name}_o WHERE {votes} > 0)
    ) WHERE k <= open GROUP BY {listed}
),
{name} AS (SELECT b.*, sure + coalesce(extra, 0) AS quota FROM {name}_o b LEFT JOIN {name}_e e ON {same})"""


def _chosen(k: str) -> str:
    def part(x: str) -> str:
        return f"floor({x} * rest / cast(blocks AS double))"

    return f"(cast({part(f'({k} + phase - 1)')} AS bigint) - cast({part('(phase - 1)')} AS bigint))"


def _words_before(x: str) -> str:
    k = f"cast(floor({x} / {BLOCK}.0) AS bigint)"
    return f"(whole * {x} + {_chosen(k)} * {BLOCK} + ({_chosen(f'({k} + 1)')} - {_chosen(k)}) * ({x} - {k} * {BLOCK}))"


MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source),
w AS (SELECT *, cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS double) AS weight FROM s),
r AS (SELECT *, {MOST}.0 * source_size AS cap, {MOST}.0 * source_size / weight AS ratio, cast(sum(source_size) OVER () AS double) AS everything FROM w),
l AS (
    SELECT *, (everything - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM r
    WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
t AS (
    SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) END AS target,
        0 AS one, cast(round(everything / {BLOCK}) AS bigint) AS seats FROM l
),
{_seats("q", "t", ["source"], "one", "target", "seats")},
a AS (
    SELECT d.*, q.source_size, q.target, q.quota AS source_quota, md5('42:' || coalesce(cast(doc_id AS varchar), chr(0))) AS key,
        cast(greatest(1, ceil(q.source_size / {SHARD}.0)) AS bigint) AS shards
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
),
b AS (SELECT *, cast('0x' || substr(key, 1, 7) AS bigint) % shards AS shard FROM a),
c AS (SELECT source, shard, cast(sum(size) AS double) AS cell_size, min(source_quota) AS source_quota FROM b GROUP BY source, shard),
{_seats("m", "c", ["source", "shard"], "source", "cell_size", "source_quota")},
e AS (
    SELECT b.*, cast(greatest(1, ceil(m.cell_size / {BLOCK}.0)) AS bigint) AS blocks, m.quota,
        sum(size) OVER (PARTITION BY b.source, b.shard ORDER BY key, doc_id, digest ROWS UNBOUNDED PRECEDING) AS last
    FROM b JOIN m ON b.source IS NOT DISTINCT FROM m.source AND b.shard = m.shard
),
f AS (
    SELECT *, cast(last AS bigint) AS b_end, cast(last - size AS bigint) AS b_begin, cast(floor(least(quota, {MOST} * blocks) / cast(blocks AS double)) AS bigint) AS whole,
        cast('0x' || substr(md5('42:' || coalesce(source, chr(0)) || ':' || shard), 8, 7) AS bigint) % blocks AS phase FROM e
),
g AS (SELECT *, least(quota, {MOST} * blocks) - whole * blocks AS rest FROM f)
SELECT doc_id, size, source_size, target, cast({_words_before("b_end")} - {_words_before("b_begin")} AS bigint) AS taken FROM g
"""

MIDDLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
        sha256('7:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents
),
c AS (
    SELECT *, cast(len(l) AS bigint) AS n, cast('0x' || h[1:8] AS bigint) % (len(l) + 1) AS a, cast('0x' || h[9:16] AS bigint) % (len(l) + 1) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
            WHEN cast('0x' || h[25:32] AS bigint) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
),
p AS (
    SELECT *, array_to_string(l[:least(a, b)], '') AS prefix, array_to_string(l[least(a, b) + 1:greatest(a, b)], '') AS middle,
        array_to_string(l[greatest(a, b) + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

def _round(k: int, update: bool = True) -> str:
    """Assignment of all parts to the codebook ``b{k}``, and the next codebook."""
    assigned = f"""
a{k} AS (
    SELECT vec_id, label, i, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT p.*, b.e, cast(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS bigint) AS d
        FROM p JOIN b{k} b ON p.i = b.i
    ) GROUP BY vec_id, label, i, part
)"""
    if not update:
        return assigned
    return f"""{assigned},
m{k} AS (
    SELECT i, e, list(cast(floor(s / n) AS bigint) ORDER BY c) AS entry FROM (
        SELECT i, e, c, sum(part[c]) AS s, count(*) AS n FROM a{k}, unnest(range(1, 5)) AS t(c) GROUP BY i, e, c
    ) GROUP BY i, e
),
b{k + 1} AS (SELECT b.i, b.e, coalesce(m.entry, b.entry) AS entry FROM b{k} b LEFT JOIN m{k} m ON b.i = m.i AND b.e = m.e)"""


CODES = f"""
WITH q AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS double)) AS bigint)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (SELECT vec_id, label, i, x[4 * i + 1:4 * i + 4] AS part FROM q, unnest(range(0, 16)) AS t(i)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM q ORDER BY vec_id LIMIT 64)),
b0 AS (SELECT i, e, part AS entry FROM p JOIN f ON p.vec_id = f.vec_id),{_round(0)},{_round(1)},{_round(2, False)},
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY i) AS code, cast(sum(d) AS bigint) AS error FROM a2 GROUP BY vec_id),
l AS (SELECT label, cast(sum(error) AS bigint) AS label_error FROM r GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY i, e)) FROM b2) AS codebooks_sha256
FROM r JOIN l ON r.label IS NOT DISTINCT FROM l.label
"""

ORACLE_SQL = {"op2_substring": SUBSTRING, "op3_mixing": MIXING, "op5_maxscore": MAXSCORE, "op12_middle": MIDDLE, "op13_vector_codes": CODES}
