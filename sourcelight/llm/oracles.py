"""DuckDB twins of the pipeline queries that SQL can express."""

from __future__ import annotations

OP7 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT DISTINCT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM d JOIN g USING (text)
"""


OP1 = """
WITH d AS (
  SELECT DISTINCT doc_id, source, sha256(coalesce(text, '')) AS text_hash,
         greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS n_tokens
  FROM documents),
s AS (SELECT source, sum(n_tokens) AS tokens FROM d GROUP BY source),
t AS (SELECT sum(tokens)::DOUBLE AS total, min(tokens)::DOUBLE AS lo, max(tokens)::DOUBLE AS hi FROM s),
e AS (SELECT round(CASE WHEN hi / lo <= 1.25 THEN 0 ELSE ceil((1 - ln(1.25) / ln(hi / lo)) * 64 ** 4) / 64 ** 4 END, 6) AS a
      FROM t),
p AS (SELECT source, tokens, (tokens / total) ** a AS power FROM s, t, e),
z AS (SELECT sum(power) AS z, max(tokens / power) AS most FROM p),
w AS (SELECT source, tokens, round(power / z * most * z)::BIGINT AS quota FROM p, z),
b AS (SELECT greatest(1, ceil(sum(quota) / 262144.0)) AS blocks FROM w),
k AS (SELECT *, md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || text_hash) AS o FROM d),
r AS (SELECT k.*, quota, tokens,
             sum(n_tokens) OVER (PARTITION BY k.source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS start
      FROM k JOIN w ON k.source IS NOT DISTINCT FROM w.source),
x AS (SELECT *, unnest(range(greatest(ceil((quota - start) / tokens::DOUBLE)::BIGINT, 0))) AS epoch FROM r),
y AS (SELECT doc_id, source, n_tokens, epoch, o,
             least(floor((start + epoch * tokens) / quota::DOUBLE * blocks), blocks - 1)::BIGINT AS block FROM x, b)
SELECT doc_id, source, n_tokens, epoch, block,
       row_number() OVER (PARTITION BY block ORDER BY md5(o || '|' || epoch), doc_id) - 1 AS place FROM y
"""

OP3 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4
    THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT a, y FROM r JOIN e ON b = x)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = a GROUP BY a
"""

OP6 = """
WITH p AS (
  SELECT page_id,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
r(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, rh || rp AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
      FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM q LEFT JOIN m ON q.page_id = m.page_id AND n = 1
"""


def _spans(name: str, rank: int, pattern: str, ok: str) -> str:
    return f"""
SELECT doc_id, '{name}' AS kind, {rank} AS rank, m, stop - length(m) AS start, stop
FROM (
  SELECT doc_id, m, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m,
           unnest(string_split_regex(text, '{pattern}')[:-2]) AS gap,
           unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM d)
) WHERE {ok}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    f"length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length({_DIGITS})), "
    f"lambda i: CASE WHEN i % 2 = 0 THEN reverse({_DIGITS})[i + 1]::INT "
    f"ELSE (reverse({_DIGITS})[i + 1]::INT * 2) % 10 + (reverse({_DIGITS})[i + 1]::INT * 2) // 10 END)) % 10 = 0"
)
#: Holds where a table has none of the added kinds (account and social security numbers), as the given ones.
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join([
    _spans('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', 'true'),
    _spans('ip', 1, '[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)',
           "list_bool_and(list_transform(string_split(m, '.'), lambda p: coalesce(try_cast(p AS DOUBLE), 999) <= 255))"),
    _spans('card', 2, '[0-9]([ -]?[0-9])+', _LUHN),
    _spans('phone', 3, '[+][0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 9 AND 15'),
])}),
p AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip,
         count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS told
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(told, '')) AS base_sha256, coalesce(told, '') AS spans
FROM (SELECT DISTINCT doc_id FROM d) d LEFT JOIN p USING (doc_id)
"""


def _rounds(n: int) -> str:
    """Assignment (a) and moved centroids (c) of n rounds, then the last assignment."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""
p{i} AS MATERIALIZED (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM k CROSS JOIN c{i}),
a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM p{i} GROUP BY vec_id)""")
        if i < n:
            parts.append(f"""
s{i} AS (SELECT c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) AS r(j) GROUP BY c, j),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS w FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.w, o.w) AS w FROM c{i} o LEFT JOIN m{i} m USING (c))""")
    return ",".join(parts)


OP11 = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS w FROM k
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= 40),
{_rounds(5)}
SELECT vec_id, a5.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a5.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON a5.c = c5.c
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP12 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM i, range(1, 1000000) AS t(s) WHERE s <= len(w) - n + 1),
l AS (SELECT DISTINCT n FROM i),
y AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, l)),
f AS MATERIALIZED (SELECT r, s, n, item FROM y JOIN x USING (n, g)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM f) GROUP BY r),
j AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM f) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN j USING (r)
"""


def _leaf(n_chars: str) -> str:
    told = ", ".join(
        f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c}), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")
    )
    return f"sha256(concat({told}))"


def _tree(name: str, source: str) -> str:
    """All levels of the trees over ``source`` (tree, i, n, h)."""
    return f"""
{name}(tree, lv, i, n, h) AS (
  SELECT tree, 0, i, n, h FROM {source}
  UNION ALL
  SELECT tree, any_value(lv) + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY tree, i // 2)"""


OP13 = f"""
WITH RECURSIVE t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS h, {_leaf('n_chars + 1')} AS h1, n_chars,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS crc
  FROM documents, t),
l AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n
  FROM d),
{_tree('a', 'l')},
s AS MATERIALIZED (
  SELECT '' AS tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM a WHERE n = 1),
{_tree('b', 's')},
g AS MATERIALIZED (
  SELECT a.tree, a.lv, a.i, false AS up, a.h FROM a UNION ALL SELECT s.lang, b.lv, b.i, true, b.h FROM b, s),
q AS MATERIALIZED (
  SELECT l.doc_id, l.tree, l.h AS leaf, s.h AS subroot, s.i AS si, l.i AS li,
         CASE WHEN crc % 7 = 0 AND doc_id IS NOT NULL AND n_chars IS NOT NULL THEN h1 ELSE l.h END AS start,
         (SELECT max(lv) FROM a WHERE a.tree = l.tree) AS high, (SELECT max(lv) FROM b) AS top
  FROM l JOIN s ON s.lang = l.tree),
f(tree, li, k, high, top, si, acc, told) AS (
  SELECT tree, li, 0, high, top, si, start, '' FROM q
  UNION ALL
  SELECT f.tree, f.li, f.k + 1, f.high, f.top, f.si,
         sha256(CASE WHEN g.h IS NULL THEN acc WHEN g.i < pos THEN g.h || acc ELSE acc || g.h END), told || coalesce(g.h, '')
  FROM (SELECT *, k >= high AS up, CASE WHEN k < high THEN k ELSE k - high END AS lv,
               CASE WHEN k < high THEN li >> k ELSE si >> (k - high) END AS pos FROM f WHERE k < high + top) f
  LEFT JOIN g ON g.tree = f.tree AND g.up = f.up AND g.lv = f.lv AND g.i = xor(pos, 1))
SELECT doc_id, leaf, subroot, r.h AS root, sha256(told) AS proof_sha256, acc AS folded_root, acc = r.h AS verified
FROM q JOIN f ON f.tree = q.tree AND f.li = q.li AND f.k = q.high + q.top, (SELECT h FROM b WHERE n = 1) r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": OP1, "op3_parity_join": OP3, "op6_url_filter": OP6, "op7_exact_dedup": OP7, "op8_pii": OP8,
        "op11_centroids": OP11, "op12_decontaminate": OP12, "op13_merkle": OP13,
    }
