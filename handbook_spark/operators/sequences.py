"""Operators on ordered pages and lines: runs, ranges, segments, packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from handbook_spark.functions.nested import let
from handbook_spark.functions.text import token_count
from handbook_spark.operators.numbering import BLOCK, block_of, first_per_key, local_runs, local_sums, with_offsets

MODULE_BREAK = "\n\n--- NEUES MODUL ---\n\n"


def strip_text(text: Column) -> Column:
    """Text without whitespace at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ordered_join(order: Sequence[str], text: str, separator: str) -> Column:
    """Aggregate: texts of a group joined in order."""
    entries = F.sort_array(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(entries, lambda e: e[text]), separator)


def best_versions(scored: DataFrame, tie_breaker: str) -> DataFrame:
    """One row per module code: best agreements first, then the newest version, an unknown one ahead."""
    order = [F.col(s).desc_nulls_first() for s in ("correct_module_code", "correct_ects", "correct_title", "version")]
    return first_per_key(scored, ["module_code"], [*order, F.col(tie_breaker)])


def module_text_pieces(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Modules as runs of pages with the same header, in ordered pieces; a header coming back later is a new module.

    The header line and the two footer lines of every page are dropped. Columns ``handbook_id,
    page_no, header, text``. Pages are put together inside their block of positions, where
    they already lie in one task: a piece (``handbook_id, run, first_page, header, body``) holds at most ``block`` pages.
    """
    lines = F.split("text", "\n")
    body = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 3, F.lit(0))), "\n")
    local, offsets = local_runs(
        pages.select("handbook_id", "page_no", "header", body.alias("body")), ["handbook_id"], ["page_no"], "header",
        block=block,
    )
    pieces = local.groupBy("handbook_id", "_block", "_local", "header").agg(
        F.min("page_no").alias("first_page"), ordered_join(["page_no"], "body", "\n").alias("body")
    )
    return with_offsets(pieces, offsets, ["handbook_id"], "run").drop("_block")


def module_texts(pages: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pieces of each module put together to one text."""
    return (
        module_text_pieces(pages, block)
        .groupBy("handbook_id", "run", "header")
        .agg(F.min("first_page").alias("_first"), ordered_join(["first_page"], "body", "\n").alias("_body"))
        .select(
            "handbook_id", F.col("_first").alias("first_page"), F.col("header").alias("module_code"),
            F.concat(F.lit("Modul "), F.col("header"), F.col("_body")).alias("content"),
        )
    )


def _touching(ranges: Column) -> Column:
    """Merge neighbouring ranges of a sorted list of (lo, hi)."""
    return let(ranges, _merge_touching)


def _merge_touching(ranges: Column) -> Column:
    opens = F.filter(ranges, lambda r, i: (i == 0) | (F.get(ranges, i - 1)["hi"] + 1 != r["lo"]))
    closes = F.filter(ranges, lambda r, i: F.coalesce(F.get(ranges, i + 1)["lo"] != r["hi"] + 1, F.lit(True)))
    return F.zip_with(opens, closes, lambda a, b: F.struct(a["lo"].alias("lo"), b["hi"].alias("hi")))


def _single_pages(pages: Column) -> Column:
    return F.transform(pages, lambda p: F.struct(p.alias("lo"), p.alias("hi")))


def _range_texts(ranges: Column) -> Column:
    texts = F.transform(
        ranges,
        lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat(r["lo"], F.lit(" - "), r["hi"])),
    )
    return F.array_join(texts, ", ")


def pages_text(pages: Column) -> Column:
    """An array of page numbers as text such as ``3 - 5, 9``."""
    return _range_texts(_touching(_single_pages(F.array_sort(F.array_distinct(pages)))))


def page_ranges(df: DataFrame, keys: Sequence[str], page: str) -> DataFrame:
    """Page numbers per key as text such as ``3 - 5, 9``; repeated pages count once.

    Pages are folded to ranges inside blocks of page numbers first, so only ranges are brought
    together per key.
    """
    in_block = (
        df.select(*keys, F.col(page).alias("_page")).filter(F.col("_page").isNotNull()).distinct()
        .groupBy(*keys, block_of("_page").alias("_block"))
        .agg(F.sort_array(F.collect_list("_page")).alias("_pages"))
    )
    merged = in_block.select(*keys, F.inline(_touching(_single_pages(F.col("_pages")))))
    return (
        merged.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_ranges"))
        .select(*keys, _range_texts(_touching(F.col("_ranges"))).alias("pages"))
    )


def first_occurrences(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """Each value once per key with the position of its first occurrence; copies meet in a partial minimum."""
    return df.groupBy(*keys, value).agg(F.min(position).alias(position))


def starts_module(text: Column, marker: str, window: int = 15) -> Column:
    """The marker lies in the first characters of the page."""
    return F.contains(F.substring(text, 1, window), F.lit(marker))


def segment_pieces(pages: DataFrame, marker: str, block: int = BLOCK) -> DataFrame:
    """Pages collected to modules, in ordered pieces: a marked page opens one, other pages join the open one.

    A piece (``handbook_id, segment, first_page, n_pages, content``) holds at most ``block`` pages.
    """
    opens = starts_module(F.col("text"), marker).cast("int")
    local, offsets = local_sums(pages, ["handbook_id"], ["page_no"], opens, block=block)
    pieces = (
        local.withColumn("_text", strip_text(F.col("text")))
        .groupBy("handbook_id", "_block", "_local")
        .agg(
            F.min("page_no").alias("first_page"), F.count(F.lit(1)).alias("n_pages"),
            ordered_join(["page_no"], "_text", "\n\n").alias("content"),
        )
    )
    return with_offsets(pieces, offsets, ["handbook_id"], "segment").drop("_block")


def segment_modules(pages: DataFrame, marker: str, block: int = BLOCK) -> DataFrame:
    """The pieces of each module put together to one text; blank ones drop."""
    return (
        segment_pieces(pages, marker, block)
        .groupBy("handbook_id", "segment")
        .agg(
            F.min("first_page").alias("_first"), F.sum("n_pages").alias("_pages"),
            ordered_join(["first_page"], "content", "\n\n").alias("content"),
        )
        .filter(strip_text(F.col("content")) != "")
        .select("handbook_id", "segment", F.col("_first").alias("first_page"), F.col("_pages").alias("n_pages"), "content")
    )


def table_of_contents(pages: DataFrame, marker: str) -> DataFrame:
    """Pages labelled cover (page 0), toc (up to the first marked page) or body.

    The first marked page comes from a partial aggregate and is joined back, so a handbook with
    very many pages needs no single-task window.
    """
    marked = (F.col("page_no") >= 2) & starts_module(F.col("text"), marker)
    firsts = pages.filter(marked).groupBy("handbook_id").agg(F.min("page_no").alias("_first"))
    region = (
        F.when(F.col("page_no") == 0, F.lit("cover"))
        .when(F.col("page_no") >= F.col("_first"), F.lit("body"))
        .otherwise(F.lit("toc"))
    )
    return pages.join(firsts, "handbook_id", "left").withColumn("region", region).drop("_first")


def _chunk_starts(sizes: Column, limit: int) -> Column:
    """Places (from 1) where a chunk begins.

    A module joins the open chunk while the sum stays strictly below ``limit``; otherwise it opens
    the next chunk, so a module larger than the limit stands alone.
    """
    start = F.struct(
        F.array(F.lit(1)).alias("starts"), F.lit(0).cast("long").alias("filled"), F.lit(0).alias("place")
    )

    def step(state: Column, size: Column) -> Column:
        fits = state["filled"] + size < limit
        place = state["place"] + 1
        return F.struct(
            F.when(fits, state["starts"]).otherwise(F.concat(state["starts"], F.array(place))).alias("starts"),
            F.when(fits, state["filled"] + size).otherwise(size.cast("long")).alias("filled"),
            place.alias("place"),
        )

    return F.array_distinct(F.aggregate(sizes, start, step)["starts"])


def pack_modules(df: DataFrame, key: str, items: Column, limit: int, separator: str = MODULE_BREAK) -> DataFrame:
    """Pack the ordered module texts of each document into chunks below a token budget.

    Chunks are put together inside the row, where each item is sized once; rows never meet.
    """

    def chunks(texts: Column) -> Column:
        def cut(sizes: Column) -> Column:
            def one(starts: Column) -> Column:
                def chunk(begin: Column, number: Column) -> Column:
                    length = F.coalesce(F.get(starts, number + 1), F.size(texts) + 1) - begin
                    members = F.slice(texts, begin, length)
                    return F.struct(
                        number.alias("chunk_no"), length.alias("n_modules"),
                        F.aggregate(F.slice(sizes, begin, length), F.lit(0), lambda a, s: a + s).alias("n_tokens"),
                        F.array_join(F.transform(members, strip_text), separator).alias("text"),
                    )

                return F.filter(F.transform(starts, chunk), lambda c: c["n_modules"] > 0)

            return let(_chunk_starts(sizes, limit), one)

        return let(F.transform(texts, token_count), cut)

    # The outer generator keeps the optimizer from copying the fold into a filter of the scan.
    return df.select(key, F.inline_outer(let(items, chunks))).filter(F.col("chunk_no").isNotNull())
