"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

import math

from graphloom.llm.merkle import LEAF
from graphloom.llm.mixing import BLOCK_DOCS, BLOCKS, OUTPUT_SHARDS, PASSES

_WORD = r"[^\x20\x09-\x0D]+"
_LEVELS = (OUTPUT_SHARDS - 1).bit_length()


def _fill() -> str:
    """The boundary block's three passes; ``gap0`` is what its source still needs there."""
    sql, taken = "", "false"
    for i in PASSES:
        gap, src = f"gap{i - 1}", "docs0" if i == 1 else f"e{i - 1}"
        free = f"NOT ({taken}) AND {_fits(i, 'size', gap)}"
        sql += f""", f{i} AS (SELECT *, {free} AS free{i}, sum(CASE WHEN {free} THEN size ELSE 0 END) OVER (PARTITION BY src ORDER BY h) AS run{i} FROM {src}),
c{i}_ AS (SELECT *, coalesce(max(CASE WHEN free{i} AND run{i} <= {gap} THEN h END) OVER (PARTITION BY src), -1) AS c{i} FROM f{i}),
e{i} AS (SELECT *, free{i} AND h <= c{i} AS t{i}, {gap} - coalesce(sum(CASE WHEN free{i} AND h <= c{i} THEN size END) OVER (PARTITION BY src), 0) AS gap{i} FROM c{i}_)"""
        taken += f" OR t{i}"
    return sql


def _fits(i: int, size: str, gap: str) -> str:
    return f"({size} > 0 AND {size} <= {gap}{f' AND {size} * 4 > {gap}' if i == 1 else ''})"


def _lf(n: str) -> str:
    """ln n! as in mixing.log_factorial."""
    few = "[" + ", ".join(repr(math.lgamma(i + 1)) for i in range(16)) + "]"
    x = f"({n})::DOUBLE"
    series = f"{x} * ln({x}) - {x} + ln({x} * {2 * math.pi!r}) / 2 + 1 / ({x} * 12) - 1 / ({x} * {x} * {x} * 360) + 1 / ({x} * {x} * {x} * {x} * {x} * 1260)"
    return f"(CASE WHEN ({n}) < 16 THEN {few}[({n}) + 1] ELSE {series} END)"


def _tree_levels() -> str:
    """The splitting tree: nodes lo..hi - 1 with n blocks and ``ks``, the blocks of each source in order."""
    sql = f""", t0 AS (SELECT 0 AS node, 0 AS lo, {OUTPUT_SHARDS} AS hi, sum(b)::BIGINT AS n, list(b ORDER BY src NULLS LAST) AS ks FROM (SELECT src, count(*)::BIGINT AS b FROM u GROUP BY 1))"""
    total, special, drawn = "s.n", "q", "s.l"
    low, high = f"greatest(0, {drawn} - ({total} - {special}))", f"least({special}, {drawn})"
    ways = f"{_lf(special)} - {_lf('k')} - {_lf(f'{special} - k')} + {_lf(f'{total} - {special}')} - {_lf(f'{drawn} - k')} - {_lf(f'{total} - {special} - {drawn} + k')} - {_lf(total)} + {_lf(drawn)} + {_lf(f'{total} - {drawn}')}"
    for i in range(_LEVELS):
        u = f"('0x' || substr(md5('mix:{i}:' || node || ':' || len(s.p)), 1, 13))::BIGINT::DOUBLE / {float(16**13)!r}"
        pick = f"list_reduce(range({low}, {high} + 1), lambda a, k: {{'c': a.c + exp({ways}), 'k': CASE WHEN a.c < {u} AND a.c + exp({ways}) >= {u} THEN k ELSE a.k END}}, {{'c': 0.0::DOUBLE, 'k': ({high})::BIGINT}}).k"
        sql += f""", m{i} AS MATERIALIZED (SELECT *, (lo + hi) // 2 AS mid, floor(n * ((lo + hi) // 2 - lo) / (hi - lo))::BIGINT AS half FROM t{i}),
p{i} AS MATERIALIZED (SELECT *, list_reduce(ks, lambda s, q: list_transform([{pick}], lambda x: {{'n': s.n - q, 'l': s.l - x, 'p': list_append(s.p, x)}})[1], {{'n': n, 'l': half, 'p': []::BIGINT[]}}).p AS picks FROM m{i}),
t{i + 1} AS (SELECT 2 * node AS node, lo, mid AS hi, half AS n, picks AS ks FROM p{i} UNION ALL SELECT 2 * node + 1, mid, hi, n - half, list_transform(ks, lambda q, j: q - picks[j]) FROM p{i})"""
    return sql


MIXING = f"""WITH d AS (SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS size, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT src, sum(size)::DOUBLE AS ss, count(*) AS n FROM d GROUP BY 1),
s1 AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2 * ss AS cap, 1.5 * sum(ss) OVER () AS al, sum(n) OVER () AS nn FROM s0),
s2 AS (SELECT *, (al - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level, row_number() OVER (ORDER BY cap / w, src NULLS LAST) AS pos FROM s1 WINDOW b AS (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT src, ss, n, greatest(1, least(ceil(n * {BLOCKS} / nn), floor(n / {BLOCK_DOCS})))::BIGINT AS blocks, greatest(1, least({BLOCKS}, floor(n / greatest(1, least(ceil(n * {BLOCKS} / nn), floor(n / {BLOCK_DOCS}))) / {BLOCK_DOCS})))::BIGINT AS cuts, least(cap, (SELECT arg_min(level, pos) FROM s2 WHERE cap >= level * w) * w) AS target FROM s2),
s AS MATERIALIZED (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END::INT AS fu, target - CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END * ss AS rest FROM s3),
k AS MATERIALIZED (SELECT d.*, blocks, rest, fu, ss, target, h % blocks AS block, h // blocks % cuts AS part FROM d JOIN s ON d.src IS NOT DISTINCT FROM s.src),
b AS (SELECT src, block, sum(size) AS words, any_value(rest) AS rest FROM k GROUP BY 1, 2),
b2 AS (SELECT *, sum(words) OVER (PARTITION BY src ORDER BY block) AS upto FROM b),
edge AS MATERIALIZED (SELECT src, min(block) AS edge, arg_min(rest - upto + words, block) AS need FROM b2 WHERE upto > rest GROUP BY 1),
ed AS MATERIALIZED (SELECT k.src, k.size, k.h, k.part, edge, need FROM k JOIN edge ON k.src IS NOT DISTINCT FROM edge.src AND k.block = edge.edge),
parts AS (SELECT src, part, need, words, sum(words) OVER (PARTITION BY src ORDER BY part) AS upto FROM (SELECT src, part, any_value(need) AS need, sum(size) AS words FROM ed GROUP BY 1, 2)),
pcut AS MATERIALIZED (SELECT src, min(part) AS pcut, arg_min(need - upto + words, part) AS pneed FROM parts WHERE upto > need GROUP BY 1),
docs0 AS (SELECT ed.src, ed.size, ed.h, edge, pneed AS gap0 FROM ed JOIN pcut ON ed.src IS NOT DISTINCT FROM pcut.src AND ed.part = pcut.pcut){_fill()},
star AS (SELECT src, arg_min(h, (abs(gap{PASSES[-1]} - size), h)) AS star FROM e{PASSES[-1]} WHERE NOT ({" OR ".join(f"t{i}" for i in PASSES)}) AND size > 0 AND abs(gap{PASSES[-1]} - size) < gap{PASSES[-1]} GROUP BY 1),
cut AS MATERIALIZED (SELECT src, {", ".join(f"any_value(gap{i - 1}) AS g{i}, any_value(c{i}) AS c{i}" for i in PASSES)} FROM e{PASSES[-1]} GROUP BY 1),
p AS (SELECT k.doc_id, k.src, k.size, k.h, k.block, k.ss, k.target, k.fu + CASE WHEN k.rest <= 0 THEN 0 WHEN edge.edge IS NULL OR k.block < edge.edge THEN 1 WHEN k.block = edge.edge AND (k.part < pcut OR k.part = pcut AND (
  {" OR ".join(f"({_fits(i, 'k.size', f'g{i}')} AND k.h <= c{i})" for i in PASSES)} OR k.h = coalesce(star, -1))) THEN 1 ELSE 0 END AS times
  FROM k LEFT JOIN edge ON k.src IS NOT DISTINCT FROM edge.src LEFT JOIN pcut ON k.src IS NOT DISTINCT FROM pcut.src LEFT JOIN cut ON k.src IS NOT DISTINCT FROM cut.src LEFT JOIN star ON k.src IS NOT DISTINCT FROM star.src),
u0 AS (SELECT s.src, block, fu + CASE WHEN rest > 0 AND (edge IS NULL OR block <= edge) THEN 1 ELSE 0 END AS drawn FROM (SELECT *, unnest(range(blocks)) AS block FROM s) s LEFT JOIN edge ON s.src IS NOT DISTINCT FROM edge.src),
u1 AS (SELECT src, block, unnest(range(1, drawn + 1)) AS pass FROM u0),
u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('mix:' || coalesce(src, '') || ':' || block || ':' || pass)) - 1 AS rank FROM u1){_tree_levels()},
names AS (SELECT src, row_number() OVER (ORDER BY src NULLS LAST) AS j FROM (SELECT DISTINCT src FROM u)),
leaf AS (SELECT src, lo, ks[j] AS b, sum(ks[j]) OVER (PARTITION BY j ORDER BY lo) AS upto FROM t{_LEVELS} CROSS JOIN names),
lists AS (SELECT u.src, block, list(lo ORDER BY pass) AS shards FROM u JOIN leaf ON u.src IS NOT DISTINCT FROM leaf.src AND rank >= upto - b AND rank < upto GROUP BY 1, 2)
SELECT doc_id, size, ss::BIGINT AS source_size, target, (size * times)::BIGINT AS taken, coalesce(array_to_string(shards[1:times], ','), '') AS shards FROM p LEFT JOIN lists ON p.src IS NOT DISTINCT FROM lists.src AND p.block = lists.block"""


def _tree(name: str, text: str, src: str) -> str:
    """Sections ``s`` with hash h, n leaves and paragraphs p with h, n and leaves."""
    return f""", {name}0 AS (SELECT doc_id, list_transform(string_split({text}, E'\\n\\n'), lambda s: list_transform(string_split(s, E'\\n'), lambda p: list_transform(regexp_extract_all(p, '{LEAF.replace("'", "''")}'), lambda x: substr(sha256(x), 1, 32)))) AS t FROM {src}),
{name}1 AS (SELECT doc_id, list_transform(t, lambda s: list_transform(s, lambda p: {{'h': sha256('p' || array_to_string(p, '')), 'n': len(p), 'leaves': p}})) AS t FROM {name}0),
{name}2 AS (SELECT doc_id, list_transform(t, lambda s: {{'h': sha256('s' || array_to_string(list_transform(s, lambda p: p.h), '')), 'n': coalesce(list_sum(list_transform(s, lambda p: p.n)), 0), 'p': s}}) AS t FROM {name}1),
{name} AS (SELECT doc_id, sha256('r' || array_to_string(list_transform(t, lambda s: s.h), '')) AS root, t FROM {name}2)"""


def _like(name: str, a: str, b: str, on: str) -> str:
    """Shared sections, then shared paragraphs of the others, then shared leaves of the rest."""
    level = lambda x, y: f"list_intersect(list_transform({x}, lambda nd: nd.h), list_transform({y}, lambda nd: nd.h))"
    known = lambda x, both: f"coalesce(list_sum(list_transform(list_filter(list_distinct(list_transform({x}, lambda nd: {{'h': nd.h, 'n': nd.n}})), lambda nd: list_contains({both}, nd.h)), lambda nd: nd.n)), 0)"
    rest = lambda x, both: f"list_filter({x}, lambda nd: NOT list_contains({both}, nd.h))"
    return f""", {name}0 AS (SELECT {a}.doc_id, {a}.t AS x, {b}.t AS y, {level(f"{a}.t", f"{b}.t")} AS hs FROM {a} JOIN e ON {a}.doc_id = e.doc_id JOIN {b} ON {on} = {b}.doc_id),
{name}1 AS (SELECT doc_id, {known("x", "hs")} AS c0, flatten(list_transform({rest("x", "hs")}, lambda s: s.p)) AS x, flatten(list_transform({rest("y", "hs")}, lambda s: s.p)) AS y FROM {name}0),
{name}2 AS (SELECT *, {level("x", "y")} AS hp FROM {name}1),
{name}3 AS (SELECT doc_id, c0 + {known("x", "hp")} AS c, list_distinct(flatten(list_transform({rest("x", "hp")}, lambda p: p.leaves))) AS x, list_distinct(flatten(list_transform({rest("y", "hp")}, lambda p: p.leaves))) AS y FROM {name}2),
{name} AS (SELECT doc_id, CASE WHEN 2 * c + len(x) + len(y) > 0 THEN 2.0::DOUBLE * (c + len(list_intersect(x, y))) / (2 * c + len(x) + len(y)) ELSE 0.0 END::DOUBLE AS near FROM {name}3)"""


MERKLE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS next_id FROM t),
e AS (SELECT x.doc_id, x.n, x.next_id, x.text, left(x.text, x.n - x.n // 2) || left(y.text, x.n // 2) AS edited FROM x JOIN t y ON x.next_id = y.doc_id)
{_tree("own", "text", "t")}{_tree("ed", "edited", "e")}{_like("ne", "own", "ed", "own.doc_id")}{_like("nn", "own", "own2", "e.next_id").replace("JOIN own2 ON", "JOIN own own2 ON")},
d AS (SELECT own.doc_id, flatten(list_transform(own.t, lambda s, i: CASE WHEN s.h IS NOT DISTINCT FROM ed.t[i].h THEN [] ELSE list_filter(list_transform(s.p, lambda p, j: CASE WHEN p.h IS DISTINCT FROM ed.t[i].p[j].h THEN (i - 1) || ':' || (j - 1) END), lambda z: z IS NOT NULL) END)) AS edits FROM own JOIN ed ON own.doc_id = ed.doc_id)
SELECT e.doc_id, e.n AS n_chars, sha256(edited) AS edited_sha256, own.root AS fingerprint, ed.root AS edited_fingerprint, ne.near AS near_edited, nn.near AS near_next, len(edits) AS edited_paragraphs, edits[1] AS first_edit
FROM e JOIN own ON e.doc_id = own.doc_id JOIN ed ON e.doc_id = ed.doc_id JOIN ne ON e.doc_id = ne.doc_id JOIN nn ON e.doc_id = nn.doc_id JOIN d ON e.doc_id = d.doc_id"""


SUBSTRINGS = f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), ' ')) AS k FROM p QUALIFY i + 12 <= n),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM g) WHERE first < doc_id),
m AS (SELECT p.doc_id, p.word, p.i, coalesce(max(f.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) >= p.i - 12, false) AS gone FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.i = f.i),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


SUFFIXES = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
q AS (SELECT doc_id, j, substr(x, 512 * j + 1, 1312) AS x, len(x) // 2 AS n FROM (SELECT doc_id, x, unnest(range((len(x) + 511) // 512)) AS j FROM d)),
p AS MATERIALIZED (SELECT doc_id, 256 * j + i AS i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN 256 * j + i + 400 <= n THEN md5_number(substr(x, 2 * i + 1, 800)) END AS k FROM (SELECT *, unnest(range(least(256, n - 256 * j))) AS i FROM q)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM p WHERE k IS NOT NULL) WHERE c > 1),
m AS (SELECT p.doc_id, p.i, p.byte, coalesce(max(f.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) > p.i - 400, false) AS gone FROM p LEFT JOIN f ON p.doc_id = f.doc_id AND p.i = f.i),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM m),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY 1)
SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""
