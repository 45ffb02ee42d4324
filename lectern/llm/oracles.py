"""DuckDB SQL for those queries of this subpackage that SQL can express over whole tables."""

from .quality_rules import RULES, STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FAILED = ", ".join(f"CASE WHEN n_words >= {r.least_words} AND NOT ({r.ratio.replace(' / ', '::DOUBLE / ')} BETWEEN {r.low!r} AND {r.high!r}) THEN '{r.name}' END" for r in RULES)

OP9 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
h AS (SELECT r, i, w[i:i + 4] AS g FROM g),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM h),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM d WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
             ((length(text) - length(replace(text, '!!', ''))) // 2)::BIGINT AS n_bangs, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (r)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {_FAILED}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = "list_filter(regexp_split_to_array(" + _LOWER.format("coalesce(text, '')") + ", '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP4 = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_TOKENS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents),
t AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
l AS (SELECT r, i, list(t) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM t),
dw AS (SELECT r, n, i, array_to_string(l[1:n], ' ') AS g FROM l, sizes WHERE len(l) >= n),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
s AS (SELECT r, count(*)::BIGINT AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(s.n, 0)::BIGINT AS n_items, sha256(coalesce(s.items, '')) AS items_sha256,
       coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
"""

_ROUNDS = "".join(
    f"""
a{r} AS MATERIALIZED (SELECT row_id, v, c, distance FROM (SELECT row_id, p.v, c, list_sum(list_transform(range(1, 65), lambda i: (p.v[i] - m.v[i]) * (p.v[i] - m.v[i])))::BIGINT AS distance FROM p, c{r} m)
     QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, c) = 1),"""
    + (
        f"""
s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c)),"""
        if r < 10
        else ""
    )
    for r in range(11)
)
OP11 = f"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
     WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS c, v FROM p QUALIFY c < 8),{_ROUNDS}
SELECT vec_id, c AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (c) JOIN p USING (row_id)
"""

OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT r, l, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d),
x AS (SELECT r, i, line, translate(regexp_replace(line, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM k),
g AS (SELECT k FROM x WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*)::BIGINT AS n, count(g.k)::BIGINT AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (g.k IS NULL) AS left_ FROM x LEFT JOIN g USING (k) GROUP BY r)
SELECT doc_id, n AS n_lines, n_dropped, sha256(coalesce(left_, '')) AS kept_sha256 FROM d JOIN o USING (r)
"""

_CRC = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
OP13 = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC} AS t),
s AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST) AS l, list(len(regexp_extract_all(text, '[^ \\t-\\r]+')) ORDER BY turn NULLS FIRST) AS w,
      (xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(any_value(crc.t)[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4)::INT AS h FROM s, crc GROUP BY conv_id),
r AS MATERIALIZED (SELECT o.conv_id, coalesce(f.l[1:o.h], []) || o.l[o.h + 1:] AS l, coalesce(f.w[1:o.h], []) || o.w[o.h + 1:] AS w FROM o LEFT JOIN o f ON f.conv_id = o.conv_id - o.conv_id % 20),
p AS MATERIALIZED (SELECT conv_id, d, sha256(array_to_string(l[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(l[1:d - 1], ',')) END AS up, len(l) = d AS ends, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words FROM (SELECT *, unnest(range(len(l) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, any_value(up) AS up, count(*)::BIGINT AS n, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e FROM p GROUP BY k, d),
c AS (SELECT up AS k, d - 1 AS d, count(*)::BIGINT AS n FROM n WHERE up IS NOT NULL GROUP BY ALL),
t AS (SELECT a.k, a.d, sum((c.n IS NULL)::INT)::BIGINT AS leaves, sum((n.n - 1) * n.words)::BIGINT AS saved FROM n LEFT JOIN c USING (k, d) JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.n, 0) AS n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, sha256(n.e) AS ends_sha256
FROM n JOIN t USING (k, d) LEFT JOIN c USING (k, d) LEFT JOIN n u ON u.k = n.up AND u.d = n.d - 1
"""

ORACLES = {"op4_decontaminate": OP4, "op9_quality_rules": OP9, "op11_lloyd": OP11, "op12_line_dedup": OP12, "op13_prefix_trie": OP13}
