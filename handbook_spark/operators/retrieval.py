"""Ranking of modules by vector, keyword and fused scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from handbook_spark.functions.text import words
from handbook_spark.functions.vectors import cosine, literal_vector
from handbook_spark.session import materialize

# Fixed parameters of the keyword ranking and of the rank fusion.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_FLOOR = 0.25
FUSION_OFFSET = 60
# Blocks of a query table and cells of the vectors that meet them.
GRID = 16


def unit(values: Sequence[float]) -> list[float]:
    length = math.sqrt(sum(v * v for v in values))
    return [v / length for v in values] if length else list(values)


def cosine_to(vector: Column, query: Sequence[float]) -> Column:
    """Cosine to a query vector given by the caller; NULL for a missing, zero or otherwise sized vector.

    Runs on Arrow batches: one matrix product per batch is about three times as fast as the array
    functions on a million 64-wide vectors.
    """
    direction = np.asarray(unit(query))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        matrix = np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.zeros((0, len(direction)))
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        return pd.Series(np.divide(matrix @ direction, lengths, out=np.full(len(lengths), np.nan), where=lengths > 0))

    # Only vectors of the right length get to Python; the others are replaced by one that scores NULL.
    fits = F.coalesce(F.size(vector) == len(direction), F.lit(False))
    whole = F.when(fits, vector).otherwise(F.array_repeat(F.lit(0.0), len(direction)).cast("array<float>"))
    return F.nullif(score(whole), F.lit(float("nan")))


def with_cosine(df: DataFrame, vector: str, query: Sequence[float], name: str = "score") -> DataFrame:
    return df.withColumn(name, cosine_to(F.col(vector), query))


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows; ties go to the smaller key. Each task sends at most k rows."""
    return df.orderBy(F.col(score).desc(), F.col(key)).limit(k)


def nearest(df: DataFrame, vector: str, key: str, query: Sequence[float], k: int = 15) -> DataFrame:
    """Exact k nearest vectors by cosine."""
    return top_k(with_cosine(df, vector, query), "score", key, k)


def cosine_to_queries(df: DataFrame, vector: str, key: str, queries: DataFrame) -> DataFrame:
    """Similarity matrix of the vectors against a table of queries (``query_no``, ``query``), one row per cell.

    Queries fall into blocks and vectors into cells; every vector meets every block and every query every
    cell, as equi joins of ``GRID`` x ``GRID`` keys. A small query table is broadcast by its measured size.
    """
    left = df.select(
        key, F.col(vector).alias("_vector"), F.pmod(F.xxhash64(key), F.lit(GRID)).alias("_cell"),
        F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)).cast("array<bigint>")).alias("_block"),
    )
    right = queries.select(
        "query_no", F.col("query").alias("_query"), F.pmod(F.xxhash64("query_no"), F.lit(GRID)).alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)).cast("array<bigint>")).alias("_cell"),
    )
    return left.join(right, ["_cell", "_block"]).select(
        key, "query_no", cosine(F.col("_vector"), F.col("_query")).alias("score")
    )


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Cosine of the listed pairs (``left_id``, ``right_id``); two equi joins, no pair is made up."""
    left = vectors.select(F.col(key).alias("left_id"), F.col(vector).alias("_left"))
    right = vectors.select(F.col(key).alias("right_id"), F.col(vector).alias("_right"))
    return (
        pairs.join(left, "left_id").join(right, "right_id")
        .withColumn("similarity", cosine(F.col("_left"), F.col("_right")))
        .drop("_left", "_right")
    )


def penalised(similarity: Column, left_text: Column, right_text: Column, term: str, factor: float = 0.7) -> Column:
    """Similarity reduced when a term occurs in the first text only."""
    only_left = F.contains(left_text, F.lit(term)) & ~F.contains(right_text, F.lit(term))
    return F.when(only_left, similarity * factor).otherwise(similarity)


def bm25(df: DataFrame, key: str, text: str, query: str, floor: float = BM25_FLOOR) -> DataFrame:
    """``key`` and Okapi BM25 score of every text for the words of a query.

    Texts are read once: their lengths and the query words' counts are stored as a narrow table, from which both the
    statistics (a row of numbers whose width is the length of the query) and the scores come.
    Words found in more than half of the texts get ``floor`` times the mean weight of the
    vocabulary, which is counted only when such a word is asked for.
    """
    terms = query.split()
    distinct = list(dict.fromkeys(terms))
    tokens = words(F.col(text))
    # One scan of the tokens of a text yields its length and every term frequency.
    counted = df.withColumn("_tokens", tokens).withColumn("_length", F.size("_tokens"))
    for i, term in enumerate(distinct):
        counted = counted.withColumn(f"_tf{i}", F.col("_length") - F.size(F.array_remove("_tokens", term)))
    counted = materialize(counted.select(key, "_length", *[f"_tf{i}" for i in range(len(distinct))]))
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_length").alias("mean"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(distinct))],
    ).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    weights = [math.log(n - stats[f"df{i}"] + 0.5) - math.log(stats[f"df{i}"] + 0.5) for i in range(len(distinct))]
    if any(w < 0 for w in weights):
        vocabulary = (
            df.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        )
        average = vocabulary.agg(
            F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("w")
        ).first()["w"]
        weights = [w if w >= 0 else floor * average for w in weights]
    score = F.lit(0.0)
    for term in terms:
        i = distinct.index(term)
        tf = F.col(f"_tf{i}")
        if stats[f"df{i}"]:
            score = score + F.lit(weights[i]) * tf * (BM25_K1 + 1) / (
                tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("_length") / F.lit(mean))
            )
    return counted.select(key, score.alias("score"))


def rank_hits(hits: DataFrame, score: str, key: str) -> DataFrame:
    """Rank a short hit list (the result of a top-k, so its size is bounded by k)."""
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))))


def fuse_ranks(lists: Sequence[DataFrame], weights: Sequence[float], content: str, offset: int = FUSION_OFFSET) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked hit lists; equal contents are one hit.

    Each list has ``content`` and ``rank``; the fused score sums weight / (rank + offset).
    """
    parts = None
    for hits, weight in zip(lists, weights, strict=True):
        part = hits.select(content, (F.lit(weight) / (F.col("rank") + offset)).alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(content).agg(F.sum("part").alias("fused_score"))


def fuse_hits(lists: Sequence[DataFrame], weights: Sequence[float], texts: DataFrame, key: str, content: str) -> DataFrame:
    """``fuse_ranks`` of ranked hit lists (``key``, ``rank``) whose contents are fetched once for all of them."""
    parts = None
    for number, (hits, weight) in enumerate(zip(lists, weights, strict=True)):
        part = hits.select(key, (F.lit(weight) / (F.col("rank") + FUSION_OFFSET)).alias("part"), F.lit(number).alias("list"))
        parts = part if parts is None else parts.unionByName(part)
    found = texts.select(key, content).join(F.broadcast(parts), key)  # k rows per list
    return found.groupBy(content).agg(F.sum("part").alias("fused_score"))


def hit_text(rank: Column, title: Column, content: Column, metadata: Column) -> Column:
    """Numbered hit with its title, content and metadata map."""
    return F.concat(
        F.lit("Treffer "), rank.cast("string"), F.lit(":\nStudiengang: "), F.coalesce(title, F.lit("unbekannt")),
        F.lit("\nInhalt: "), content, F.lit("\nMetadaten: "), F.to_json(metadata),
    )


def cluster(df: DataFrame, vector: str, key: str, k: int = 3, rounds: int = 5) -> DataFrame:
    """K-means cluster of every vector after a fixed number of rounds.

    The first centres are the vectors of the k smallest keys; a vector belongs to the nearest centre, to the
    smaller number among equally near ones, and a cluster without vectors keeps its centre. Centres are k
    rows; sums are partial aggregates.
    """
    rows = df.select(key, F.col(vector).cast("array<double>").alias("_v"))
    centres = [list(r["_v"]) for r in rows.orderBy(key).limit(k).collect()]
    width = len(centres[0]) if centres else 0

    def assigned() -> DataFrame:
        distances = [
            F.struct(F.aggregate(F.zip_with("_v", literal_vector(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
                     .alias("distance"), F.lit(i).alias("cluster"))
            for i, c in enumerate(centres)
        ]
        nearest_one = F.array_min(F.array(*distances)) if distances else F.struct(F.lit(0.0), F.lit(None).cast("int").alias("cluster"))
        return rows.withColumn("cluster", nearest_one["cluster"])

    for _ in range(rounds if centres else 0):
        means = assigned().groupBy("cluster").agg(F.array(*[F.avg(F.get("_v", F.lit(i))) for i in range(width)]).alias("mean"))
        for row in means.collect():
            centres[row["cluster"]] = list(row["mean"])
    return assigned().select(key, "cluster")


