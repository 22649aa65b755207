"""Vector retrieval over embeddings: a row's label stands for its document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators.retrieval import fuse, group_similarity, nearest
from quillframe.plans.book import Book
from quillframe.sources.tables import table

book = Book()
PAIRS_SQL = "(SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"


@book.query(f"SELECT query_id, vec_id, similarity, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rn FROM {PAIRS_SQL} WHERE vec_id <> query_id) WHERE rn <= 5")
def knn_topk(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


@book.query(f"SELECT query_id, label::BIGINT AS label, max(similarity) AS similarity FROM {PAIRS_SQL} GROUP BY ALL")
def max_chunk_similarity(spark, sf_dir):
    return group_similarity(table(spark, sf_dir, "embeddings"), "label")


_KEYWORD_SQL = "(SELECT vec_id AS query_id, (vec_id * 7 + i * i) % 10 AS label, i AS rank FROM embeddings, range(1, 5) t(i) WHERE vec_id % 50 = 0)"
_SEMANTIC_SQL = f"(SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, label) AS rank FROM (SELECT query_id, label::BIGINT AS label, max(similarity) AS similarity FROM {PAIRS_SQL} GROUP BY ALL) WHERE similarity >= 0.3)"


@book.query(f"""
WITH k AS (SELECT query_id, label, min(rank) AS rank FROM {_KEYWORD_SQL} GROUP BY ALL), head AS (SELECT * FROM k WHERE rank <= 3),
rest AS (SELECT s.query_id, s.label, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank) AS n FROM {_SEMANTIC_SQL} s WHERE NOT EXISTS (SELECT 1 FROM head WHERE head.query_id = s.query_id AND head.label = s.label))
SELECT query_id, label, rank::INT AS place, false AS semantic_only FROM head
UNION ALL SELECT query_id, label, (n + 3)::INT, NOT EXISTS (SELECT 1 FROM k WHERE k.query_id = rest.query_id AND k.label = rest.label) FROM rest WHERE n <= 2""")
def additive_fusion(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i"))
    keyword = queries.select("query_id", ((F.col("query_id") * 7 + F.col("i") * F.col("i")) % 10).alias("label"), F.col("i").alias("rank")).groupBy("query_id", "label").agg(F.min("rank").alias("rank"))
    similar = group_similarity(vectors, "label", least=0.3)
    semantic = similar.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "label")))
    return fuse(keyword, semantic, "query_id", "label")
