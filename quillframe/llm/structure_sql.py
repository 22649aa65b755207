"""DuckDB SQL for the prefix trie, the Merkle manifest and the source mix."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    eight = f"list_reduce(list_prepend(xor(s, c), range(8)::BIGINT[]), lambda a, i: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda s, c: {eight}), 4294967295)"


OP11 = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS b
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, {crc32("conv_id::VARCHAR")} % 9 AS h FROM t GROUP BY 1),
s AS (SELECT c.conv_id, c.n, c.h, c.conv_id - c.conv_id % 5 AS base, least(c.h, coalesce(x.n, 0)) AS lent FROM c LEFT JOIN c x ON x.conv_id = c.conv_id - c.conv_id % 5),
r AS (
  SELECT s.conv_id, p, k, b FROM s JOIN t ON t.conv_id = s.base AND p < h
  UNION ALL SELECT s.conv_id, p - h + lent, k, b FROM s JOIN t ON t.conv_id = s.conv_id AND p >= h),
q AS (SELECT s.conv_id, coalesce(w.k, []) AS k, coalesce(w.b, []) AS b FROM s LEFT JOIN (SELECT conv_id, list(k ORDER BY p) AS k, list(b ORDER BY p) AS b FROM r GROUP BY 1) w USING (conv_id)),
f AS (SELECT conv_id, len(k) AS size, unnest(range(0, len(k) + 1)) AS d, k, b FROM q),
m AS (SELECT conv_id, size, d, sha256(array_to_string(k[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(k[1:d - 1], ',')) END AS up, coalesce(b[d], 0) AS b FROM f),
n AS (SELECT d, node, any_value(up) AS up, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d) AS ends FROM m GROUP BY d, node),
g AS (SELECT d - 1 AS d, up AS node, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
e AS (SELECT n.*, coalesce(g.n, 0) AS children FROM n LEFT JOIN g USING (d, node)),
w AS (SELECT m.d, m.node, sum((e.n - 1) * e.b)::BIGINT AS saved, count(*) FILTER (e.children = 0) AS leaves FROM e JOIN m ON m.conv_id = e.conv_id AND m.d <= e.d GROUP BY ALL)
SELECT e.conv_id, e.d AS depth, a.conv_id AS parent_conv_id, e.n AS n_convs, e.children AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM e JOIN w USING (d, node) LEFT JOIN n a ON a.d = e.d - 1 AND a.node = e.up
"""


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf, CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents),
l AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM d),
t AS (
  SELECT lang, 0 AS v, p AS i, leaf AS h, n FROM l
  UNION ALL SELECT lang, v + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, v, i // 8, n),
s AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS v, p AS i, h, n FROM s
  UNION ALL SELECT v + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY v, i // 8, n),
hops AS (
  SELECT r, v, p // pow(8, v)::BIGINT AS own, i, h FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.n > 1 AND t.i // 8 = l.p // pow(8, v + 1)::BIGINT
  UNION ALL SELECT r, 100 + v, s.p // pow(8, v)::BIGINT, i, u.h FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN u ON u.n > 1 AND u.i // 8 = s.p // pow(8, v + 1)::BIGINT),
runs AS (
  SELECT r, row_number() OVER (PARTITION BY r ORDER BY v) AS k, coalesce(string_agg(h, '' ORDER BY i) FILTER (i < own), '') AS a, coalesce(string_agg(h, '' ORDER BY i) FILTER (i > own), '') AS b FROM hops GROUP BY r, v),
proof AS (SELECT r, sha256(string_agg(a || b, '' ORDER BY k)) AS proof, max(k) AS most FROM runs GROUP BY r),
fold AS (SELECT r, 0 AS k, coalesce(other, leaf) AS h FROM l UNION ALL SELECT f.r, f.k + 1, sha256(a || h || b) FROM fold f JOIN runs x ON x.r = f.r AND x.k = f.k + 1),
ended AS (SELECT r, arg_max(h, k) AS h FROM fold GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, ended.h AS folded_root, ended.h = root.h AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN ended USING (r) LEFT JOIN proof USING (r), (SELECT h FROM u WHERE n = 1) root
"""

OP13 = r"""
WITH d AS (SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER byratio AS k, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::BIGINT AS words, (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS weight
  FROM s WINDOW byratio AS (ORDER BY cap / w, source NULLS LAST), before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT words, weight FROM o WHERE w * words <= cap::HUGEINT * weight ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN w * level.words > cap::HUGEINT * level.weight THEN cap::DOUBLE ELSE (w * level.words)::DOUBLE / level.weight END AS target FROM s, level),
q AS (SELECT *, round(target)::BIGINT AS quota, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS turns FROM t),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || coalesce(doc_id::VARCHAR, '')), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT doc_id, size, source_size, target, (turns * size + greatest(least(quota - turns * source_size - before, size), 0))::BIGINT AS taken
FROM b JOIN q ON q.source IS NOT DISTINCT FROM b.source
"""

ORACLES = {"op11_prefix_trie": OP11, "op12_merkle_manifest": OP12, "op13_source_mix": OP13}
