"""F and the vector part of I: sorting, top-k, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handbook_spark.corpus import Corpus
from handbook_spark.functions import text, vectors
from handbook_spark.operators import aggregates, filters, retrieval
from handbook_spark.plans.registry import query

KEYWORDS = "the onen das und"


@query("f1_order_by", "SELECT o_orderkey, o_totalprice FROM orders")
def f1(c: Corpus) -> DataFrame:
    return filters.select_rows(c.table("orders"), ["o_orderkey", "o_totalprice"], order_by=("o_totalprice", "DESC"))


@query("f2_order_by_score", """
SELECT raw_module_id, CAST(correct_module_code + correct_ects + correct_title AS DOUBLE) AS total FROM v_search""")
def f2(c: Corpus) -> DataFrame:
    total = (F.col("correct_module_code") + F.col("correct_ects") + F.col("correct_title")).cast("double")
    return c.view("v_search").select("raw_module_id", total.alias("total")).orderBy(F.col("total").desc())


@query("f3_limit_after_dedup", """
SELECT text_md5 FROM (SELECT DISTINCT md5(text) AS text_md5 FROM documents) ORDER BY text_md5 LIMIT 4""")
def f3(c: Corpus) -> DataFrame:
    distinct = aggregates.distinct_rows(c.table("documents").select(F.md5("text").alias("text_md5")))
    return distinct.orderBy("text_md5").limit(4)


def example_vector(c: Corpus) -> list[float]:
    """Query by example: the vector with the smallest id."""
    return list(c.table("embeddings").orderBy("vec_id").first()["embedding"])


_QUERY_VECTOR = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)"
_COSINE = f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY_VECTOR})"


@query("f4_cosine_top_k", f"""
SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 15""")
def f4(c: Corpus) -> DataFrame:
    hits = retrieval.nearest(c.table("embeddings"), "embedding", "vec_id", example_vector(c), 15)
    return hits.select("vec_id", F.round("score", 6).alias("score"))


_BM25 = rf"""
docs AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS tokens FROM documents),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM docs),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term),
weights AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS w, avg(ln(n - df + 0.5) - ln(df + 0.5)) OVER () AS mean_w FROM df, stats),
query_terms AS (SELECT term, CASE WHEN w < 0 THEN 0.25 * mean_w ELSE w END AS w FROM weights WHERE term IN ('the', 'onen', 'das', 'und')),
tf AS (SELECT doc_id, len(tokens) AS length, q.w, len(list_filter(tokens, lambda t: t = q.term)) AS tf FROM docs, query_terms q),
bm25 AS (SELECT doc_id, sum(w * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean))) AS score FROM tf, stats GROUP BY doc_id)"""


@query("f5_bm25_top_k", f"""
WITH {_BM25.strip()} SELECT doc_id, round(score, 6) AS score FROM bm25 ORDER BY round(score, 9) DESC, doc_id LIMIT 10""")
def f5(c: Corpus) -> DataFrame:
    return c.text_index().top_k(KEYWORDS, 10).select("doc_id", F.round("score", 6).alias("score"))


@query("f5_bm25_scores", f"""
WITH {_BM25.strip()} SELECT doc_id, round(score, 6) AS score FROM bm25""")
def f5_scores(c: Corpus) -> DataFrame:
    scored = retrieval.bm25(c.table("documents"), "doc_id", "text", KEYWORDS)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@query("f6_rank_fusion", f"""
WITH {_BM25.strip()},
dense AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS rank FROM embeddings),
sparse AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm25),
hits AS (SELECT doc_id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT doc_id, rank FROM sparse WHERE rank <= 10)
SELECT md5(d.text) AS content_md5, round(sum(0.5 / (h.rank + 60)), 9) AS fused_score
FROM hits h JOIN documents d ON d.doc_id = h.doc_id GROUP BY d.text""")
def f6(c: Corpus) -> DataFrame:
    documents = c.table("documents")
    dense = retrieval.nearest(c.table("embeddings"), "embedding", "vec_id", example_vector(c), 10)
    sparse = c.text_index().top_k(KEYWORDS, 10)
    lists = []
    for hits, key in ((dense, "vec_id"), (sparse, "doc_id")):
        lists.append(retrieval.rank_hits(hits, "score", key).select(F.col(key).alias("doc_id"), "rank"))
    fused = retrieval.fuse_hits(lists, [0.5, 0.5], documents, "doc_id", "text")
    return fused.select(F.md5("text").alias("content_md5"), F.round("fused_score", 9).alias("fused_score"))


@query("f7_numbered_hits", f"""
SELECT rank, 'Treffer ' || CAST(rank AS VARCHAR) || ':' || chr(10) || 'Studiengang: ' || d.lang || chr(10) || 'Inhalt: ' || d.text || chr(10)
  || 'Metadaten: {{"lang":"' || d.lang || '","source":"' || d.source || '"}}' AS hit
FROM (SELECT vec_id, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS rank FROM embeddings) h
JOIN documents d ON d.doc_id = h.vec_id WHERE rank <= 5""")
def f7(c: Corpus) -> DataFrame:
    hits = retrieval.nearest(c.table("embeddings"), "embedding", "vec_id", example_vector(c), 5)
    ranked = retrieval.rank_hits(hits, "score", "vec_id").select(F.col("vec_id").alias("doc_id"), "rank")
    metadata = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return c.table("documents").join(F.broadcast(ranked), "doc_id").select(
        "rank", retrieval.hit_text(F.col("rank"), F.col("lang"), F.col("text"), metadata).alias("hit")
    )


@query("i34_l2_normalisation", """
SELECT vec_id, round(norm * norm, 6) AS squared, round(first, 6) AS first FROM (
  SELECT vec_id, sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(e, e)) AS norm, e[1] / sqrt(list_inner_product(e, e)) AS first
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def i34_unit(c: Corpus) -> DataFrame:
    unit = c.table("embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return unit.select(
        "vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("squared"), F.round(F.get("u", F.lit(0)), 6).alias("first")
    )


@query("i34_similarity_to_queries", f"""
SELECT vec_id, query_no, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v), 6) AS score
FROM embeddings e, (SELECT 0 AS query_no, {_QUERY_VECTOR} AS v UNION ALL
  SELECT 1, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id DESC LIMIT 1)) q""")
def i34_matrix(c: Corpus) -> DataFrame:
    ends = [c.table("embeddings").orderBy(order).limit(1).select(F.lit(n).alias("query_no"), F.col("embedding").alias("query"))
            for n, order in enumerate((F.col("vec_id"), F.col("vec_id").desc()))]
    cells = retrieval.cosine_to_queries(c.table("embeddings"), "embedding", "vec_id", ends[0].unionByName(ends[1]))
    return cells.withColumn("score", F.round("score", 6))


_PAIRS = """
SELECT a.vec_id AS left_id, b.vec_id AS right_id,
       list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def _neighbour_pairs(c: Corpus) -> DataFrame:
    vectors_ = c.table("embeddings").select("vec_id", "embedding")
    pairs = vectors_.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    return retrieval.cosine_pairs(pairs, vectors_, "vec_id", "embedding")


@query("i34_cosine_pairs", f"SELECT left_id, right_id, round(similarity, 6) AS similarity FROM ({_PAIRS})")
def i34_pairs(c: Corpus) -> DataFrame:
    return _neighbour_pairs(c).withColumn("similarity", F.round("similarity", 6))


@query("i35_penalised_similarity", f"""
SELECT p.left_id, p.right_id, round(CASE WHEN contains(l.text, 'und') AND NOT contains(r.text, 'und') THEN similarity * 0.7 ELSE similarity END, 6) AS adjusted
FROM ({_PAIRS}) p JOIN documents l ON l.doc_id = p.left_id JOIN documents r ON r.doc_id = p.right_id""")
def i35(c: Corpus) -> DataFrame:
    texts = c.table("documents")
    left = texts.select(F.col("doc_id").alias("left_id"), F.col("text").alias("_left"))
    right = texts.select(F.col("doc_id").alias("right_id"), F.col("text").alias("_right"))
    pairs = _neighbour_pairs(c).join(left, "left_id").join(right, "right_id")
    adjusted = retrieval.penalised(F.col("similarity"), F.col("_left"), F.col("_right"), "und")
    return pairs.select("left_id", "right_id", F.round(adjusted, 6).alias("adjusted"))


def _k_means_sql(k: int, rounds: int) -> str:
    """Rounds of assignment and mean, written one after the other."""
    parts = [f"""e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS cluster, v FROM e ORDER BY vec_id LIMIT {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS (SELECT vec_id, v, cluster FROM (SELECT e.vec_id, e.v, c.cluster, row_number() OVER (
  PARTITION BY e.vec_id ORDER BY list_distance(e.v, c.v), c.cluster) AS nth FROM e, c{n} c) WHERE nth = 1)""")
        parts.append(f"""c{n + 1} AS (SELECT cluster, list(m ORDER BY i) AS v FROM (SELECT cluster, i, avg(x) AS m FROM (
  SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY cluster, i) GROUP BY cluster)""")
    return f"WITH {', '.join(parts)} SELECT vec_id, cluster FROM a{rounds}"


@query("i36_k_means", _k_means_sql(3, 5))
def i36(c: Corpus) -> DataFrame:
    return retrieval.cluster(c.table("embeddings"), "embedding", "vec_id", 3, 5)


@query("i37_token_count", r"""
SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|\S')) AS n_tokens FROM documents""")
def i37(c: Corpus) -> DataFrame:
    return c.table("documents").select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))
