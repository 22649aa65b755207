"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import (
    byte_bpe,
    decontaminate,
    embedding_dedup,
    merkle_manifest,
    minhash_dedup,
    preference_format,
    prefix_trie,
    quality,
    secret_scan,
    source_mix,
    structure_sql,
    substring_dedup,
    token_counts,
    toxicity,
)
from quillframe.sources.tables import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", quality.in_hold_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation 2k as the chosen one and 2k + 1 as the rejected one."""
    conversations = table(spark, sf_dir, "conversations")
    pairs = conversations.select(F.expr("conv_id div 2").alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
    return preference_format.format_pairs(conversations, pairs)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE))
    counts = [F.expr(f"CAST(size(filter(secrets, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.in_hold_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document or so is tampered with: its text's ASCII letters become small."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = merkle_manifest.manifest(table(spark, sf_dir, "documents"), changed={"text": lower}, where=tampered)
    return made.withColumnRenamed("id", "doc_id")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents"))


_ALL = (
    op1_minhash_dedup,
    op2_decontaminate,
    op3_substring_dedup,
    op4_token_counts,
    op5_byte_bpe,
    op6_toxicity,
    op7_preference_format,
    op8_secret_scan,
    op9_quality,
    op10_embedding_dedup,
    op11_prefix_trie,
    op12_merkle_manifest,
    op13_source_mix,
)
QUERIES = {q.__name__: q for q in _ALL}


def _spans_sql(place: int, rule: secret_scan.Rule) -> str:
    """Spans of a rule in d(r, t): what lies before a match is all between and all matches up to it."""
    pattern = secret_scan.scanned(rule).pattern.replace("'", "''")
    return f"""
SELECT r, {place} AS ord, '{rule.kind}' AS kind, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda k: length(g[k]) >= {rule.least}), lambda k:
  {{'start': (list_sum(list_transform(b[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT, 'size': length(m[k])}})) AS s
FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS b FROM d)"""


_KINDS = ", ".join(f"'{k}'" for k in secret_scan.BASE)

ORACLES: dict[str, str] = structure_sql.ORACLES | {
    "op1_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i : i + 4], ' '))) END) AS g FROM d),
bag AS (SELECT doc_id, g, count(*) AS n FROM runs GROUP BY ALL),
size AS (SELECT doc_id, sum(n)::BIGINT AS total FROM bag GROUP BY 1),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS shared FROM bag x JOIN bag y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b, shared = s.total AND shared = t.total AS equal FROM met JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE shared / (s.total + t.total - shared)::DOUBLE >= 0.8),
edge AS (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS n, doc_id AS m FROM size UNION SELECT y, m FROM reach JOIN edge ON x = n),
named AS (SELECT n, min(m) AS component FROM reach GROUP BY n)
SELECT doc_id, coalesce(total, 0)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(a) FROM link WHERE b = doc_id AND equal), doc_id)) AS class_id, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN named ON n = doc_id
""",
    "op3_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
listed AS (SELECT r, doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' '))) AS h FROM d WHERE len(w) >= 50),
windows AS (SELECT r, doc_id, unnest(h) AS h, generate_subscripts(h, 1) AS i FROM listed),
first AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
hit AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM windows JOIN first USING (h) WHERE low < doc_id),
gone AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
worded AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM worded x WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.r = x.r AND h.p = x.p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (r) LEFT JOIN left_over USING (r)
""",
    "op8_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_spans_sql(i, r) for i, r in enumerate(secret_scan.RULES))}),
shown AS (SELECT r, ord, kind, s.start AS start, kind || ':' || s.start || ':' || (s.start + s.size) AS span FROM spans),
folded AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, ord) FILTER (kind IN ({_KINDS})) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM shown GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN folded USING (r)
""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS n, vec_id AS m FROM v UNION SELECT y, m FROM reach JOIN link ON x = n),
named AS (SELECT n AS vec_id, min(m) AS component FROM reach GROUP BY n),
counted AS (SELECT x AS vec_id, count(*) AS links FROM link GROUP BY x)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN named USING (vec_id)
""",
    "op2_decontaminate": r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
placed AS (SELECT item_id, least(len(w), 10) AS n, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM placed),
widths AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, widths WHERE len(w) >= n),
hits AS (SELECT r, i, s.n AS n, item_id FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM starts) s JOIN windows USING (n, gram)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
""",
    "op7_preference_format": """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
paired AS (
  SELECT a.conv_id // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.n AS na, b.n AS nb
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) a JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) b ON b.conv_id = a.conv_id + 1 AND a.conv_id % 2 = 0),
prefixed AS (
  SELECT q.*, coalesce((SELECT min(x.p) - 1 FROM turns x LEFT JOIN turns y ON y.conv_id = q.rejected_id AND y.p = x.p AND y.role = x.role AND y.text = x.text WHERE x.conv_id = q.chosen_id AND y.p IS NULL), na) AS n
  FROM paired q),
drawn AS (
  SELECT conv_id, p, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown, length(role) + 5 AS skip, length(text) AS size FROM turns),
sided AS (
  SELECT pair_id, side, string_agg(shown, '' ORDER BY p) AS body, string_agg(CASE WHEN role = 'assistant' THEN (before + skip)::VARCHAR || ':' || (before + skip + size)::VARCHAR END, ',' ORDER BY p) AS mask
  FROM (SELECT pair_id, side, p, role, shown, skip, size, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
    FROM (SELECT pair_id, 'c' AS side, d.* FROM prefixed JOIN drawn d ON d.conv_id = chosen_id AND d.p > n UNION ALL SELECT pair_id, 'r', d.* FROM prefixed JOIN drawn d ON d.conv_id = rejected_id AND d.p > n)) GROUP BY 1, 2),
prompts AS (SELECT pair_id, string_agg(shown, '' ORDER BY p) AS prompt FROM prefixed JOIN drawn d ON d.conv_id = chosen_id AND d.p <= n GROUP BY 1)
SELECT q.pair_id, q.chosen_id, q.rejected_id, q.n::BIGINT AS n_prompt_turns, coalesce(prompt, '') AS prompt, coalesce(c.body, '') AS chosen, coalesce(r.body, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM prefixed q LEFT JOIN prompts USING (pair_id) LEFT JOIN sided c ON c.pair_id = q.pair_id AND c.side = 'c' LEFT JOIN sided r ON r.pair_id = q.pair_id AND r.side = 'r'
""",
}
