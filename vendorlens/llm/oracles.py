"""DuckDB SQL for the queries that SQL can express, written against the contract."""
from __future__ import annotations

from vendorlens.llm.mixing import SCHEDULES, WEIGHTS, WORDS
from vendorlens.llm.secrets import ASSIGN_LEAST, KINDS, SCOPE

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _numbers(*names: str) -> str:
    return "(" + ", ".join(str(n) for n, k in enumerate(KINDS) if k[0] in names or k[1] in names) + ")"


_PIECES = "\n  UNION ALL ".join(
    f"SELECT doc_id, {n} AS kind, unnest(m) AS m, unnest(g[:len(m)]) AS g, generate_subscripts(m, 1) AS i FROM "
    f"(SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_quoted(p)}) AS m, "
    f"regexp_split_to_array(coalesce(text, ''), {_quoted(p)}) AS g FROM documents)" for n, (_, _, _, p) in enumerate(KINDS))
_NAMES = "['" + "', '".join(k[0] for k in KINDS) + "']"

def _near(role: str) -> str:
    """Whether a part of the role ends at most SCOPE before this one starts, or starts at most SCOPE after it ends."""
    here = f"FILTER (kind IN {_numbers(role)})"
    return (f"(coalesce(max(e) {here} OVER earlier >= s - {SCOPE}, false) OR "
            f"coalesce(min(s) {here} OVER later <= e + {SCOPE}, false))")


_OP1 = f"""
WITH pieces AS ({_PIECES}),
placed AS (
  SELECT doc_id, kind, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM pieces),
parts AS (
  SELECT doc_id, kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM placed
  WHERE kind <> 0 OR length(regexp_extract(m, {_quoted(KINDS[0][3])}, 2)) >= {ASSIGN_LEAST}),
near AS (
  SELECT *, {_near("id")} AS has_id, {_near("secret")} AS has_secret FROM parts
  WINDOW earlier AS (PARTITION BY doc_id ORDER BY s), later AS (PARTITION BY doc_id ORDER BY s DESC)),
kept AS (
  SELECT *, {_NAMES}[kind + 1] || ':' || s || ':' || e AS t FROM near
  WHERE kind < 3 OR (kind = 3 AND has_secret) OR (kind = 4 AND has_id) OR (kind = 5 AND has_id AND has_secret)),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, string_agg(t, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
    string_agg(t, ',' ORDER BY s, kind) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)"""


def _inverse(demand: str) -> str:
    cases = []
    for n, points in enumerate(SCHEDULES):
        pieces = list(zip(points, points[1:]))
        areas = [(t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in pieces]
        whole, done, whens = sum(areas), 0.0, []
        for ((t0, a), (t1, b)), area in zip(pieces, areas):
            left = f"({demand} * {whole}::DOUBLE - {done}::DOUBLE)"
            slope = (b - a) / (t1 - t0)
            whens.append(f"WHEN {demand} * {whole}::DOUBLE < {done + area}::DOUBLE THEN {t0}::DOUBLE + {left} * 2 / "
                         f"({a}::DOUBLE + sqrt(greatest({a * a}::DOUBLE + {left} * 2 * {slope}::DOUBLE, 0)))")
            done += area
        cases.append(f"WHEN number % {len(SCHEDULES)} = {n} THEN CASE {' '.join(whens)} ELSE 1 END")
    return f"CASE {' '.join(cases)} END"


_OP8 = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (
  SELECT *, {list(WEIGHTS)}[number % {len(WEIGHTS)} + 1] AS weight, (2 * source_size)::DOUBLE / {list(WEIGHTS)}[number % {len(WEIGHTS)} + 1] AS ratio FROM sources),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY ratio, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighed),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, number LIMIT 1),
goals AS (
  SELECT source, source_size, number, coalesce(least((SELECT level FROM chosen) * weight, (2 * source_size)::DOUBLE), 0) AS target FROM weighed),
placed AS (
  SELECT doc_id, size, source_size, number, target, floor(target)::BIGINT AS goal,
    (sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
parts AS (
  SELECT *, greatest(0, least(goal - start, size)) AS f, greatest(0, least(goal - start - source_size, size)) AS a FROM placed)
SELECT doc_id, size, source_size, target, f + a AS taken,
  CASE WHEN f > 0 THEN round({_inverse("((start + f / 2.0::DOUBLE) / goal)")}, 9) END AS position,
  CASE WHEN a > 0 THEN round({_inverse("((start + source_size + a / 2.0::DOUBLE) / goal)")}, 9) END AS position_2
FROM parts"""

_OP9 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS t
  FROM iw, LATERAL unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS u(i) WHERE len(w) > 0),
dwins AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM dw, (SELECT DISTINCT m FROM wins), LATERAL unnest(generate_series(1, len(w) - m + 1)) AS u(i)),
hits AS (SELECT doc_id, i, m, item_id FROM dwins JOIN wins USING (m, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL unnest(generate_series(i, i + m - 1)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS t FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP10 = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS t(i)),
e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(er) + length(et) + length('<|im_start|><|im_end|>') + 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

def _jaccard(k: int, percent: int, more: str = "") -> str:
    """Groups of documents that links of k-word shingle sets form, by comparing all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORDS}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), {k}) - 1], ' ') AS t
  FROM w, LATERAL unnest(generate_series(1, len(w) - least(len(w), {k}) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id{more}
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id"""


_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _row(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_FOLDED = "sha256(CASE WHEN s.d IS NULL THEN f.h WHEN s.i < f.i THEN s.d || f.h ELSE f.h || s.d END), f.p || coalesce(s.d, '')"
_OP11 = f"""
WITH RECURSIVE leaf AS (
  SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
    {_row("n_chars")} AS d, CASE WHEN {_CRC32} % 7 = 0 THEN {_row("(n_chars + 1)")} ELSE {_row("n_chars")} END AS claim FROM documents),
nodes(lang, level, i, d, n) AS (
  SELECT lang, 0, i, d, n FROM leaf
  UNION ALL SELECT lang, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
subs AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, d, n) AS (
  SELECT 0, i, d, n FROM subs
  UNION ALL SELECT level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
lower(doc_id, lang, leaf, level, i, n, h, p) AS (
  SELECT doc_id, lang, d, 0, i, n, claim, '' FROM leaf
  UNION ALL SELECT f.doc_id, f.lang, f.leaf, f.level + 1, f.i // 2, (f.n + 1) // 2, {_FOLDED}
  FROM lower f LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1),
upper(doc_id, leaf, subroot, level, i, n, h, p) AS (
  SELECT doc_id, leaf, subs.d, 0, subs.i, subs.n, h, p FROM lower JOIN subs ON subs.lang IS NOT DISTINCT FROM lower.lang WHERE lower.n = 1
  UNION ALL SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.i // 2, (f.n + 1) // 2, {_FOLDED}
  FROM upper f LEFT JOIN tops s ON s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT doc_id, leaf, subroot, tops.d AS root, sha256(p) AS proof_sha256, h AS folded_root, h = tops.d AS verified
FROM upper JOIN tops ON upper.n = 1 AND tops.n = 1"""

_OP12 = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": _OP1,
    "op4_jaccard_join": _jaccard(3, 90),
    "op8_mix_sources": _OP8,
    "op9_decontaminate": _OP9,
    "op10_chat_format": _OP10,
    "op11_merkle_manifest": _OP11,
    "op12_hard_negatives": _OP12,
    "op13_minhash": _jaccard(2, 80, ", min(other) = doc_id AS kept"),
}
