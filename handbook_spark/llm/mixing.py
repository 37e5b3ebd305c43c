"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash and served in that order, a second time if the
source's target exceeds its size. A copy's virtual finish time is its source's words up to and with
it, divided by the source's target; serving all copies by finish time takes every source in
proportion to its target at any moment, and time 1 is where the total budget is spent. The copy
that crosses time 1 is cut to the words that still fit, so each source ends at its target.

Results for odd input: a null text has size 0; a document of size 0 takes 0 words; the null source is a source of its
own and comes last; a null doc_id is shuffled like an empty one; equal rows are served one after the
other in any order, which does not change the words that they take together; an empty table gives
no rows.

A source may hold any share of the rows. Running totals are built from cells of the hash range or of
the time: totals of a cell are aggregated, the cells are added up, and only the rows of one cell
(about ``CELL_ROWS``) are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbook_spark.session import materialize

WEIGHTS = (3, 1, 2)
#: Budget as a multiple of all words, and the most a source may give as a multiple of its words.
BUDGET, MOST = 1.5, 2
CELL_ROWS = 4096
#: Hash digits that place a row in a cell; 16 ** 6 cells of a source at most.
_DIGITS = 6


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """Target of each source from ``sizes`` (source, source_size), one row per source.

    Shares stop at ``most`` times a source's size and the excess is shared again by weight, until
    none is above. That ends where target = min(most * size, weight * level) for one level; sources
    reach their limit in the order of limit / weight, so the level follows from running sums.
    The window holds one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = (
        sizes.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(
            F.row_number().over(ordered) - 1, F.lit(len(weights))).cast("int") + 1))
        .withColumn("__limit", F.col("source_size") * most)
        .withColumn("__ratio", F.col("__limit") / F.col("__weight"))
        .withColumn("__left", F.sum("source_size").over(everything) * budget
                    - F.coalesce(F.sum("__limit").over(before), F.lit(0)))
        .withColumn("__level", F.col("__left") / F.sum("__weight").over(after))
        # The first source, in filling order, that does not reach its limit sets the level for all later ones.
        .withColumn("__final", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level")))
                    .over(everything)["__level"])
    )
    share = F.least(F.col("__limit").cast("double"), F.coalesce(F.col("__final"), F.col("__ratio")) * F.col("__weight"))
    return rows.select("source", "source_size", share.alias("target"))


def _running(rows: DataFrame, keys: list[str], cell: str, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over all rows before, by ``keys``, ordered by ``cell`` and ``order``.

    Only rows of one cell are sorted together; the window over cells holds one row per cell.
    """
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, cell).agg(F.sum(value).alias("__sum"))
    offsets = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, cell])],
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    same = F.lit(True)
    for i, k in enumerate([*keys, cell]):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, same)
        .withColumn(out, F.col("__offset") + F.col("__inside"))
        .drop("__offset", "__inside", *[f"__k{i}" for i in range(len(keys) + 1)])
    )


def served(sized: DataFrame, **shares) -> DataFrame:
    """Shuffled documents: the columns of ``sized`` (doc_id, source, size, more if wanted) with source_size, target, budget,
    start and time_cells.

    ``start`` is the number of the source's words before the document, ``budget`` all words of the mix.
    """
    counted = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))
    everything = Window.partitionBy()
    plan = targets(counted.select("source", "source_size"), **shares).join(
        counted.select(F.col("source").alias("__source"), "__n"), F.col("source").eqNullSafe(F.col("__source"))).select(
        "__source", "source_size", "target",
        F.ceil(F.sum("target").over(everything)).cast("long").alias("budget"),
        F.ceil(F.col("__n") / CELL_ROWS).alias("__cells"),
        F.ceil(F.sum("__n").over(everything) / CELL_ROWS).alias("time_cells"))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    place = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("__source"))).withColumns({
        "__digest": digest, "__cell": F.floor(place * F.col("__cells") / F.lit(16 ** _DIGITS))})
    return _running(rows, ["source"], "__cell", ["__digest", "doc_id", "size"], "size", "start").drop(
        "__source", "__digest", "__cells", "__cell")


def mix(documents: DataFrame) -> DataFrame:
    """Copies in the mix of ``served`` documents: the served columns with pass, finish, position and taken.

    A copy's words stop at its source's target (time 1). All copies are range-sorted by finish time,
    ties by source and document; ``position`` is the number of words before a copy in that order, and the
    words beyond the total budget are cut off there.
    """
    before = F.col("start") + (F.col("pass") - 1) * F.col("source_size")
    given = F.least(F.col("size"), F.round("target").cast("long") - before)
    copies = (
        documents.filter("size > 0").withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2))))
        .withColumn("given", given).filter("given > 0")
        .withColumn("finish", (before + F.col("given")) / F.col("target"))
        .withColumn("__cell", F.floor(F.least(F.col("finish"), F.lit(1.0)) * F.col("time_cells")))
    )
    ordered = _running(copies, [], "__cell", ["finish", "source", "start", "pass"], "given", "position")
    taken = F.least(F.col("given"), F.col("budget") - F.col("position"))
    return ordered.withColumn("taken", taken).filter("taken > 0").drop("given", "__cell", "time_cells")


def taken_words(sized: DataFrame, **shares) -> DataFrame:
    """Every document with the words that the mix takes of it: doc_id, source, size, source_size, target, taken."""
    documents = materialize(served(sized, **shares))
    # Documents with words differ in (source, start), repeated rows too.
    used = mix(documents).groupBy(F.col("source").alias("__source"), F.col("start").alias("__start")).agg(
        F.sum("taken").alias("__taken"))
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0)
    return documents.join(used, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each document, stored once so that texts are read once."""
    return materialize(docs.select("doc_id", "source", words(F.col("text")).alias("size")))


def first_words(text: Column, number: Column) -> Column:
    """The first words of a text, with single spaces between them."""
    return F.array_join(F.slice(F.split(F.trim(F.translate(text, "\t\n\v\f\r", "     ")), " +"), 1, number), " ")


def mixed_documents(docs: DataFrame, **shares) -> DataFrame:
    """The mix itself: each copy's row of ``docs`` (doc_id, text, source and more), cut texts with the words they give.

    Copies meet their texts by doc_id and a hash of the text. Rows that agree in both are served as often as
    there are such rows, each time with the same text.
    """
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    sized = materialize(keyed.select("doc_id", "source", "__key", words(F.col("text")).alias("size")))
    copies = mix(materialize(served(sized, **shares))).select(
        F.col("doc_id").alias("__doc_id"), F.col("source").alias("__source"), F.col("__key").alias("__copy"),
        F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (
        F.col("__key") == F.col("__copy"))
    text = F.when(F.col("__taken") < F.col("__size"), first_words(F.col("text"), F.col("__taken").cast("int"))).otherwise(F.col("text"))
    return keyed.dropDuplicates(["doc_id", "source", "__key"]).join(copies, same).withColumn("text", text).select(*docs.columns)
