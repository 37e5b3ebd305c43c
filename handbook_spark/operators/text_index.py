"""A stored inverted index for keyword ranking: a query reads the postings of its own words and skips blocks that cannot matter.

Postings are rows (term, block): documents with ids ``block * BLOCK_DOCS`` and on are one block, and a row has the places of its documents
in the block, word counts and text lengths as arrays, and the largest score share that the term gives to a document of the block. A
term of all documents is thus many rows of bounded size. The table is cut by a hash of the term and sorted by term, so that a filter on
terms skips folders and row groups; parquet packs the ascending places as differences.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from handbook_spark.functions.text import words
from handbook_spark.operators.retrieval import BM25_B, BM25_FLOOR, BM25_K1, top_k
from handbook_spark.session import materialize

BLOCK_DOCS = 4096
BUCKETS = 64
#: Decimal places at which scores are compared, so that the order of summation decides no rank.
DIGITS = 9
_PARTS = "term string, block long, words long, at array<int>, tf array<int>, length array<int>"
_POSTINGS = "term string, block long, n int, most double, at array<int>, tf array<int>, length array<int>, bucket int"


def _share(tf: Column, length: Column, mean: Column) -> Column:
    """What a word gives to a text's score, apart from its weight."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_PARTS`` rows of documents (block, at, tokens): the entries that a batch gives to a term and block."""
    for batch in batches:
        tokens = batch.column("tokens")
        offsets = tokens.offsets.to_numpy().astype(np.int64)
        coded = tokens.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        size, width = np.diff(offsets), max(len(coded.dictionary), 1)
        cells, tf = np.unique(np.repeat(np.arange(batch.num_rows), size) * width + coded.indices.to_numpy(), return_counts=True)
        doc, term = cells // width, cells % width
        block, at = (batch.column(name).to_numpy() for name in ("block", "at"))
        order = np.lexsort((doc, block[doc], term))
        doc, term, tf = doc[order], term[order], tf[order]
        of = block[doc]
        first = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(of) != 0))) if len(doc) else np.zeros(0, np.int64)
        bounds = np.append(first, len(doc))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(term[first])), pa.array(of[first], pa.int64()),
             pa.array(np.add.reduceat(tf, first) if len(first) else tf, pa.int64()),
             *(_lists(values, bounds) for values in (at[doc], tf, size[doc]))], names=["term", "block", "words", "at", "tf", "length"])


def merged(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[pa.RecordBatch]:
    """``_POSTINGS`` rows from ``_PARTS`` (with bucket) that are sorted by term and block; entries of one place and length are one.

    The last term and block of a batch wait for the next one, in which they may go on.
    """
    waiting: list[pa.RecordBatch] = []

    def starts(rows: pa.RecordBatch) -> np.ndarray:
        codes = (rows.column("term").dictionary_encode().indices.to_numpy(), rows.column("block").to_numpy())
        return np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in codes], axis=0)))

    def joined(rows: pa.RecordBatch) -> pa.RecordBatch:
        begin = starts(rows)
        lists = [rows.column(name) for name in ("at", "tf", "length")]
        bounds = lists[0].offsets.to_numpy().astype(np.int64)
        at, tf, length = (x.values.to_numpy()[bounds[0] : bounds[-1]].astype(np.int64) for x in lists)
        group = np.repeat(np.arange(len(begin)), np.add.reduceat(np.diff(bounds), begin))
        order = np.lexsort((length, at, group))
        group, at, tf, length = group[order], at[order], tf[order], length[order]
        first = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(at) != 0) | (np.diff(length) != 0)))
        tf = np.add.reduceat(tf, first)
        group, at, length = group[first], at[first], length[first]
        share = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))
        n = np.bincount(group, minlength=len(begin))
        ends = np.concatenate(([0], np.cumsum(n)))
        heads = {name: rows.column(name).take(pa.array(begin)) for name in ("term", "block", "bucket")}
        return pa.RecordBatch.from_arrays(
            [heads["term"], heads["block"], pa.array(n, pa.int32()), pa.array(np.maximum.reduceat(share, ends[:-1])),
             *(_lists(x, ends) for x in (at, tf, length)), heads["bucket"]], names=["term", "block", "n", "most", "at", "tf", "length", "bucket"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([*waiting, batch])
        last = int(starts(rows)[-1])
        if last:
            yield joined(rows.slice(0, last))
        waiting = [rows.slice(last)]
    if waiting:
        yield joined(waiting[0])


def build_index(documents: DataFrame, key: str, text: str, path: str) -> TextIndex:
    """Write the index of ``documents`` to ``path``. ``key`` is a unique integer; rows without it take no part, null texts are empty.

    Texts are read once for the postings; the number of documents comes from their keys.
    """
    doc = F.col(key).cast("long")
    block = F.floor(doc / BLOCK_DOCS)
    rows = documents.filter(F.col(key).isNotNull())
    # Entries are counted where a text is read; a row of parts holds those of one term, block and batch.
    parts = materialize(rows.select(
        block.alias("block"), (doc - block * BLOCK_DOCS).cast("int").alias("at"), words(F.col(text)).alias("tokens")).mapInArrow(counted, _PARTS))
    keys = rows.select(doc.alias("doc"))
    number = keys.agg(F.count(F.lit(1)).alias("number")).first()["number"]
    mean = parts.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("total")).first()["total"] / max(number, 1)
    order = ["bucket", "term", "block"]
    placed = parts.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket").sortWithinPartitions(*order)
    postings = placed.mapInArrow(lambda batches: merged(batches, mean or 1.0), _POSTINGS)
    postings.sortWithinPartitions(*order).write.option("parquet.writer.version", "PARQUET_2_0").partitionBy("bucket").parquet(f"{path}/postings")
    spark = documents.sparkSession
    terms = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.log(F.lit(number) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms.agg(F.avg(weight).alias("average")).select(
        F.lit(number).cast("long").alias("number"), F.lit(float(mean)).alias("mean"), "average").write.parquet(f"{path}/meta")
    keys.write.parquet(f"{path}/keys")
    return TextIndex(spark, path, key)


class TextIndex:
    """A stored index; see ``build_index``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.number, self.mean, self.average = spark.read.parquet(f"{path}/meta").first()

    def postings(self, terms: list[str]) -> DataFrame:
        """Rows of some terms; other folders and row groups are not read."""
        hashes = self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term")).alias("bucket")).distinct()
        buckets = [r.bucket for r in hashes.collect()]  # one number a term at most
        return self.spark.read.schema(_POSTINGS).parquet(f"{self.path}/postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def weights(self, terms: list[str], floor: float = BM25_FLOOR) -> dict[str, float]:
        """Weight of each indexed term; a word of more than half of the texts weighs ``floor`` times the mean of the vocabulary."""
        found = self.postings(terms).groupBy("term").agg(F.sum("n").alias("df")).collect()  # one row a term
        weights = {r.term: math.log(self.number - r.df + 0.5) - math.log(r.df + 0.5) for r in found}
        return {t: w if w >= 0 else floor * self.average for t, w in weights.items()}

    def _scores(self, postings: DataFrame, weight: Column) -> DataFrame:
        """Scores of the documents in some posting rows."""
        entries = postings.select("block", weight.alias("weight"), F.explode(F.arrays_zip("at", "tf", "length")).alias("e"))
        share = F.col("weight") * _share(F.col("e.tf"), F.col("e.length"), F.lit(self.mean or 1.0))
        return entries.groupBy((F.col("block") * BLOCK_DOCS + F.col("e.at")).alias("doc")).agg(F.round(F.sum(share), DIGITS).alias("score"))

    def bounds(self, query: str) -> DataFrame:
        """block, bound: the most that a document of the block can score for the query, from the heads of the postings."""
        counts = Counter(query.split())
        weights = self.weights(list(counts))
        heads = self.postings(list(counts)).select("term", "block", "most")
        return heads.groupBy("block").agg(F.sum(F.greatest(self._weight(counts, weights), F.lit(0.0)) * F.col("most")).alias("bound"))

    @staticmethod
    def _weight(counts: Counter, weights: dict[str, float]) -> Column:
        known = {t: weights[t] * n for t, n in counts.items() if t in weights}
        return F.element_at(F.create_map(*[F.lit(x) for item in (known or {"": 0.0}).items() for x in item]), F.col("term"))

    def top_k(self, query: str, k: int) -> DataFrame:
        """The k best documents for the words of a query: key and score, ties to the smaller key.

        The k blocks with the highest bounds hold at least k documents with a score, if there are as many; their k-th best score
        excludes every block whose bound is lower. Documents without any word of the query score 0 and come last.
        """
        counts = Counter(query.split())
        weights = self.weights(list(counts)) if counts else {}
        if not weights:
            return self._empty(k)
        postings, weight = self.postings(list(weights)), self._weight(counts, weights)
        bounds = self.bounds(query)
        likely = bounds.orderBy(F.col("bound").desc(), "block").limit(k).select("block")
        sure = top_k(self._scores(postings.join(likely, "block"), weight), "score", "doc", k).collect()  # k rows
        least = sure[-1]["score"] if len(sure) == k else -math.inf
        kept = bounds.filter(F.col("bound") >= F.lit(least - 2 * 10**-DIGITS)).select("block")
        hits = top_k(self._scores(postings.join(kept, "block"), weight), "score", "doc", k)
        if least < 0 or len(sure) < k:  # documents without a score of their own come into question
            hits = top_k(hits.unionByName(self._others(postings, k)), "score", "doc", k)
        return hits.select(F.col("doc").alias(self.key), "score")

    def _others(self, postings: DataFrame, k: int) -> DataFrame:
        """The k first documents that hold no term of some postings."""
        places = postings.select("block", F.explode("at").alias("place"))
        scored = places.select((F.col("block") * BLOCK_DOCS + F.col("place")).alias("doc")).distinct()
        rest = self.spark.read.parquet(f"{self.path}/keys").join(scored, "doc", "left_anti")
        return rest.orderBy("doc").limit(k).withColumn("score", F.lit(0.0))

    def _empty(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/keys").orderBy("doc").limit(k).select(F.col("doc").alias(self.key), F.lit(0.0).alias("score"))
