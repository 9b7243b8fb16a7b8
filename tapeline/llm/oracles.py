"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

_SUBSTRING = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM p),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM k, range(20) t(j) WHERE r > 1),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS x FROM d),
s AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS kept, count(*) AS n FROM u ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)"""

_ESC = r"regexp_replace({0}, '<(\\*)\|', '<\1\\|', 'g')"
_CHAT = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(12 + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C')) + 1 + length({_ESC.format('text')}) + 11) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""

_COMPONENTS = """cc(id, c) AS (SELECT id, id FROM nodes UNION SELECT e.b, cc.c FROM cc JOIN e ON e.a = cc.id),
comp AS (SELECT id, min(c) AS c FROM cc GROUP BY id)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
x AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), nodes AS (SELECT id FROM d), {_COMPONENTS}
SELECT id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, id = c AS kept FROM comp LEFT JOIN n USING (id)"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT id, label, v, sqrt(list_dot_product(v, v)) AS m FROM v
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.id < b.id AND list_dot_product(a.v, b.v) / (a.m * b.m) >= 0.98),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), nodes AS (SELECT id FROM v), {_COMPONENTS},
k AS (SELECT a AS id, count(*) AS n FROM e GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, id = c AS kept FROM comp LEFT JOIN k USING (id)"""

_EXT = "CASE WHEN coalesce(list_position({0}, false), 0) = 0 THEN len({0}) ELSE list_position({0}, false) - 1 END"
_SAME = "list_transform({0}, lambda x, i: x = {1}[i] AND i <= len({1}))"
_LINES = f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
i AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS x, len(l) AS n FROM d),
m AS (SELECT *, substr(md5(x), 1, 8) AS h, len(regexp_extract_all(x, {_WORDS})) > 50 AS own FROM i),
e AS (SELECT *, (i = n - 1 OR own OR lead(own) OVER (PARTITION BY doc_id ORDER BY i) OR substr(md5(coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), '') || h), 1, 1) NOT IN ('0', '1'))::INT AS last FROM m),
g AS (SELECT *, coalesce(sum(last) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
k AS (SELECT doc_id, c, min(i) AS pos, count(*) AS n, list(x ORDER BY i) AS l FROM g GROUP BY 1, 2),
y AS (SELECT *, coalesce(list_reverse(lag(l) OVER w), []) AS b, coalesce(lead(l) OVER w, []) AS a FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
r AS (SELECT *, row_number() OVER v AS k, first_value(b) OVER v AS fb, first_value(a) OVER v AS fa FROM y WINDOW v AS (PARTITION BY l ORDER BY doc_id, pos)),
s AS (SELECT *, {_SAME.format('b', 'fb')} AS sb, {_SAME.format('a', 'fa')} AS sa FROM r WHERE k > 1),
t AS (SELECT doc_id, pos, n, l, {_EXT.format('sb')} AS eb, {_EXT.format('sa')} AS ea FROM s),
q AS (SELECT DISTINCT doc_id, unnest(range((pos - eb)::BIGINT, (pos + n + ea)::BIGINT)) AS i FROM t WHERE eb + n + ea >= 2 OR len(regexp_extract_all(l[1], {_WORDS})) > 50),
z AS (SELECT g.* FROM g ANTI JOIN q USING (doc_id, i)),
o AS (SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS kept FROM z GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, (coalesce(len(l), 0) - coalesce(o.n, 0))::BIGINT AS n_removed,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""

_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
# the rule itself, without seeds: 12 equal tokens of 15, 16 of 20 and so on hold three in a row
_THREE = "SELECT id, a, t[a + 1] AS x, t[a + 2] AS y, t[a + 3] AS z FROM (SELECT id, t, unnest(range(len(t) - 2)) AS a FROM {0} WHERE len(t) >= 3)"
_DECONTAMINATE = f"""WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT item_id AS id, {_TOKENS} AS t FROM benchmark),
h AS (SELECT DISTINCT x.id AS doc_id, y.id AS item, x.a - y.a AS shift FROM ({_THREE.format('d')}) x JOIN ({_THREE.format('(SELECT * FROM b WHERE len(t) >= 5)')}) y USING (x, y, z)),
w AS (SELECT doc_id, item, shift, d.t, b.t AS u, least(20, len(b.t)) AS need, CASE WHEN len(b.t) < 13 THEN 100 ELSE 80 END AS pc FROM h JOIN d ON d.id = h.doc_id JOIN b ON b.id = h.item),
f AS (SELECT *, unnest(range(greatest(0, -shift), least(len(u) - need, len(t) - need - shift) + 1)) AS f FROM w),
o AS (SELECT DISTINCT doc_id, item FROM f WHERE len(list_filter(range(need), lambda k: t[f + k + shift + 1] = u[f + k + 1])) * 100 >= need * pc
  UNION SELECT d.id, b.id FROM d JOIN b ON d.t = b.t WHERE len(b.t) BETWEEN 1 AND 4),
g AS (SELECT doc_id, count(*) AS n, min(item) AS first_item FROM o GROUP BY doc_id)
SELECT doc_id, n IS NULL AS kept, coalesce(n, 0)::BIGINT AS n_items, coalesce(first_item, -1) AS first_item FROM documents LEFT JOIN g USING (doc_id)"""



def _hilbert(bits: int = 4) -> str:
    """Cells of lang, source and bytes at quantiles, their place on the curve, runs of the order as shards."""
    n = 2**bits
    text_cell = lambda c: f"""e_{c} AS (SELECT list({c}) AS e FROM (SELECT {c}, floor(cum * {n} / total) AS k, floor((cum - n) * {n} / total) AS before FROM (SELECT {c}, n, sum(n) OVER (ORDER BY {c}) AS cum, sum(n) OVER () AS total
  FROM (SELECT {c}, count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c}))) WHERE k > before AND k < {n})"""  # noqa: E731
    below = lambda c: f"coalesce(len(list_filter(e_{c}.e, lambda y: y < {c})), 0)"
    steps, last = [], "x0"
    for k in range(3 * (bits - 1)):
        q, i, now = 1 << (bits - 1 - k // 3), "abc"[k % 3], f"x{k + 1}"
        cols = {c: c for c in "abc"}
        swap = f"(xor(a, {i}) & {q - 1})"
        cols["a"] = f"CASE WHEN {i} & {q} <> 0 THEN xor(a, {q - 1}) ELSE {'a' if i == 'a' else f'xor(a, {swap})'} END"
        if i != "a":
            cols[i] = f"CASE WHEN {i} & {q} <> 0 THEN {i} ELSE xor({i}, {swap}) END"
        steps.append(f"{now} AS (SELECT id, {', '.join(f'{v} AS {c}' for c, v in cols.items())} FROM {last})")
        last = now
    turn = "0"
    for j in range(1, bits):
        turn = f"xor({turn}, CASE WHEN c & {1 << j} <> 0 THEN {(1 << j) - 1} ELSE 0 END)"
    woven = " + ".join(f"((({'abc'[s % 3]} >> {bits - 1 - s // 3}) & 1) << {3 * bits - 1 - s})" for s in range(3 * bits))
    table = "list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda y: ('0x' || y)::BIGINT)), lambda c, y: xor(c >> 8, tb[(xor(c, y) & 255) + 1])), 4294967295)"
    return f"""WITH d AS (SELECT doc_id AS id, lang, source, coalesce(text, '') AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS b FROM documents),
{text_cell('lang')}, {text_cell('source')},
e_b AS (SELECT list(DISTINCT (SELECT min(b) FROM (SELECT b, count(*) OVER (ORDER BY b) AS cum, count(*) OVER () AS total FROM d) WHERE cum >= ceil(total * k / {n}))) AS e FROM range(1, {n}) r(k)),
x0 AS (SELECT id, {below('lang')}::BIGINT AS a, {below('source')}::BIGINT AS b, {below('b')}::BIGINT AS c FROM d, e_lang, e_source, e_b),
{', '.join(steps)},
g AS (SELECT id, a, xor(a, b) AS b, xor(xor(a, b), c) AS c FROM {last}),
f AS (SELECT id, xor(a, {turn}) AS a, xor(b, {turn}) AS b, xor(c, {turn}) AS c FROM g),
h AS (SELECT id, {woven} AS hilbert FROM f),
r AS (SELECT *, row_number() OVER (ORDER BY hilbert, id) - 1 AS k, count(*) OVER () AS n FROM h),
tb AS (SELECT {table} AS tb)
SELECT id AS doc_id, b + 1 AS size, {crc}::BIGINT AS text_crc32, 'rows' AS law, (k * 16 // n)::INT AS shard, k - ((k * 16 // n) * n + 15) // 16 AS slot, NULL::INT AS grown_shard, hilbert FROM r JOIN d USING (id), tb"""


ORACLES: dict[str, str] = {
    "op2_hilbert": _hilbert(),
    "op3_substring_doubling": _SUBSTRING,
    "op4_prefix_targets": _CHAT,
    "op6_bayes_minhash": _MINHASH,
    "op7_int8_tiles": _VECTORS,
    "op9_line_chunks": _LINES,
    "op10_spaced_seeds": _DECONTAMINATE,
}
