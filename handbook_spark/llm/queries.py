"""Registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from handbook_spark.llm import (
    bit_sliced, byte_bpe, fill_middle, language, lm_scoring, mixing, neighbours, part_enum, piece_bpe, prefix_trie, secrets, token_files,
    toxicity,
)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(build):
        _QUERIES[name] = build
        if sql is not None:
            _CHECKS[name] = sql
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_CHECKS)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


@_query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_files.read_blocks(token_files.write_blocks(docs, tokenizer_file("word_bpe_49k.json")))


_OP2_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)
    / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
  FROM usable q JOIN usable c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query("op2_nearest_neighbours", _OP2_SQL)
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return neighbours.nearest(rows, F.col("id") % 50 == 0, 5)


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    machine = toxicity.fit(toxicity.sample(docs, labels, fold("doc_id", 5) != 0))
    return toxicity.score_documents(docs, machine, "doc_id").select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_OP4_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@_query("op4_bit_sliced_top_k", _OP4_SQL)
def op4_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return bit_sliced.best(rows, F.col("id") % 50 == 0, 5, 256)


@_query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    learned = language.learn(docs, fold("doc_id", 4) != 2)
    return language.identify(docs, learned, "doc_id").withColumn("held_out", fold("doc_id", 4) == 2).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


@_query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.digests(docs, tokenizer_file("byte_bpe_50k.json"), "doc_id")


_OP7_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM split
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b
)
SELECT s.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, r.root AS component_id
FROM split s LEFT JOIN sizes z ON z.doc_id = s.doc_id
JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = s.doc_id
"""


@_query("op7_ngram_jaccard", _OP7_SQL)
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum.near_copies(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("op8_lm_scores")
def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = lm_scoring.score(docs, fold("doc_id", 10) != 0, tokenizer_file("word_bpe_49k.json"))
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score", "mixed_score")


@_query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", *map(count, secrets.KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


_OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (ARRAY[3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT *, 2 * source_size / weight AS ratio,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes
), shares AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * coalesce(
    (SELECT f.level FROM filling f WHERE f.level <= f.ratio ORDER BY f.ratio, f.level LIMIT 1), ratio)) AS target FROM filling
), served AS (
  SELECT s.doc_id, s.source, s.size, h.source_size, h.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN shares h ON s.source IS NOT DISTINCT FROM h.source
), copies AS (
  SELECT *, start + (pass - 1) * source_size AS bef,
    least(size, round(target)::BIGINT - (start + (pass - 1) * source_size)) AS given
  FROM served, (VALUES (1), (2)) p(pass) WHERE size > 0
), ordered AS (
  SELECT *, coalesce(sum(given) OVER (ORDER BY (bef + given) / target, source NULLS FIRST, start, pass
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
  FROM copies WHERE given > 0
), used AS (
  SELECT source, start, sum(greatest(least(given, (SELECT ceil(sum(target)) FROM shares) - position), 0)) AS taken
  FROM ordered GROUP BY source, start
)
SELECT s.doc_id, s.size, s.source_size::BIGINT AS source_size, s.target,
       coalesce(u.taken, 0)::BIGINT AS taken, s.source
FROM served s LEFT JOIN used u ON s.source IS NOT DISTINCT FROM u.source AND s.start = u.start AND s.size > 0
"""


@_query("op10_source_mix", _OP10_SQL)
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.taken_words(mixing.sized_documents(docs)).select(
        "doc_id", "size", "source_size", "target", "taken", "source")


_OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), chosen AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM chosen
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
         ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts
"""


@_query("op11_fill_in_middle", _OP11_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    made = fill_middle.fill_in_middle(docs, "doc_id")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@_query("op12_sentence_piece")
def op12_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return piece_bpe.digests(docs, tokenizer_file("piece_bpe_32k.model"), "doc_id")


_OP13_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS hash,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(hash ORDER BY turn NULLS FIRST, hash) AS turns,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM said GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, coalesce(f.turns[1:o.h], []) || o.turns[o.h + 1:len(o.turns)] AS path
  FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 20
), reached AS (
  SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT path[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
  FROM reached GROUP BY p, depth
), weighed AS (
  SELECT n.*, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * w.words END AS saved, CASE WHEN depth = 0 THEN NULL ELSE p[1:depth - 1] END AS up
  FROM nodes n LEFT JOIN (SELECT DISTINCT hash, words FROM said) w ON w.hash = p[depth]
), born AS (
  SELECT up, count(*) AS n FROM weighed WHERE depth > 0 GROUP BY up
), above AS (
  SELECT p[1:unnest(range(0, depth + 1))] AS top, saved, CASE WHEN b.n IS NULL THEN 1 ELSE 0 END AS leaf
  FROM weighed x LEFT JOIN born b ON b.up = x.p
), under AS (
  SELECT top, sum(saved) AS saved, sum(leaf) AS leaves FROM above GROUP BY top
)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, coalesce(b.n, 0) AS n_children, t.leaves::BIGINT AS n_leaves,
  t.saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM weighed x LEFT JOIN weighed u ON u.p = x.up AND u.depth = x.depth - 1 LEFT JOIN born b ON b.up = x.p JOIN under t ON t.top = x.p
"""


@_query("op13_prefix_trie", _OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
