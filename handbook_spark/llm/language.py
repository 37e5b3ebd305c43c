"""Language identification by compression.

Each language has a zstandard compressor primed with raw training text as its dictionary. A text is
cut into pieces, every piece is compressed with every language's dictionary, and the language with
the smallest total wins. The prediction is marked as rejected when the runner-up needs hardly more.

Results for odd input: a null text or one without any letter gets ``und``, score 0 and is rejected;
a null or empty language name is never learned; with no training row at all every text gets
``und``; equal totals go to the smaller language name; repeated rows are scored one by one; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm.words import steps

#: Training sample: at most so many texts of each language, each giving at most so many characters.
SAMPLE_TEXTS, SAMPLE_CHARS = 192, 800
#: Bytes that are compressed at once. Small pieces keep the dictionary's share of all matches high.
PIECE_BYTES = 1024
#: A text below so many bytes is compressed behind a passage of each language, which is left out of that
#: language's dictionary; the passage's own size is taken off. A frame's fixed cost would hide the text otherwise.
SHORT_BYTES = 256
#: Matches of four bytes count: the fast levels look for longer ones, which single words do not give.
MATCHER = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 4, "min_match": 4, "target_length": 16,
           "strategy": zstandard.STRATEGY_GREEDY}
#: Rejected if the runner-up's total is less than so many parts larger than the best one.
NARROW = 0.01
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, training: Column) -> dict[str, tuple[bytes, bytes]]:
    """Raw dictionary of each language, and its passage for short texts, from a bounded sample of the rows where ``training`` holds.

    The sample takes the text with the smallest hash in each of ``SAMPLE_TEXTS`` hash cells of a
    language, so copies count once and any number of rows gives at most that many texts. Each
    gives a passage of ``SAMPLE_CHARS`` characters from a place that also depends on the hash.
    """
    rows = docs.filter(training & (F.length("lang") > 0) & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("text").alias("h"))
    picked = rows.groupBy("lang", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("cell")).agg(F.min("h").alias("h"))
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    passages = (
        rows.join(F.broadcast(picked.select("lang", "h")), ["lang", "h"])
        .select("lang", "h", F.substring(F.col("text"), begin, F.lit(SAMPLE_CHARS)).alias("passage"))
        .groupBy("lang", "h").agg(F.min("passage").alias("passage"))
    )
    found: dict[str, list[tuple[int, str]]] = {}
    for row in passages.collect():  # languages x SAMPLE_TEXTS passages at most
        found.setdefault(row.lang, []).append((row.h, row.passage))
    learned = {}
    for lang in sorted(found):
        texts = [p.lower().encode("utf-8", "surrogatepass") for _, p in sorted(found[lang])]
        carrier = max(range(len(texts)), key=lambda i: (len(texts[i]), -i))
        rest = [t for i, t in enumerate(texts) if i != carrier]
        learned[lang] = (b"\n".join(rest or texts), texts[carrier] + b"\n" if rest else b"")
    return learned


class Compressed:
    """Sizes of texts under one language's dictionary."""

    def __init__(self, compressor: zstandard.ZstdCompressor, carrier: bytes):
        self.compress, self.carrier = compressor.compress, carrier
        self.carrier_size = len(self.compress(carrier))

    def size(self, raw: bytes) -> int:
        if len(raw) < SHORT_BYTES:
            return max(len(self.compress(self.carrier + raw)) - self.carrier_size, 0)
        return sum([len(self.compress(raw[at : at + PIECE_BYTES])) for at in range(0, len(raw), PIECE_BYTES)])


def compressors(dictionaries: dict[str, tuple[bytes, bytes]]) -> dict[str, Compressed]:
    made = {}
    settings = zstandard.ZstdCompressionParameters(**MATCHER, write_content_size=False)
    for lang, (raw, carrier) in sorted(dictionaries.items()):
        primed = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=settings)
        made[lang] = Compressed(zstandard.ZstdCompressor(dict_data=primed, compression_params=settings), carrier)
    return made


def classify(text: str | None, by_lang: dict[str, Compressed]) -> tuple[str, float, bool]:
    """Predicted language, score from 0 to 1 and whether the margin is too narrow."""
    if not text or not by_lang or not _LETTER.search(text):
        return UNKNOWN, 0.0, True
    raw = text.lower().encode("utf-8", "surrogatepass")
    totals = [(sizes.size(raw), lang) for lang, sizes in by_lang.items()]
    totals.sort()
    best, lang = totals[0]
    unit = 2.0 + best / 64
    score = 1.0 / sum(math.exp((best - size) / unit) for size, _ in totals)
    return lang, score, len(totals) > 1 and totals[1][0] - best <= NARROW * best


def identify(docs: DataFrame, dictionaries: dict[str, tuple[bytes, bytes]], *keep: str) -> DataFrame:
    """``keep`` columns of each row with ``lang_pred``, ``score`` and ``rejected``; one pass, no shuffle."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang = compressors(dictionaries)
        for batch in batches:
            for part in steps(batch, "__text"):
                found = [classify(t, by_lang) for t in part.column("__text").to_pylist()]
                langs, scores, rejected = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in fields]
                    + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[f.name for f in fields] + ["lang_pred", "score", "rejected"])

    return source.mapInArrow(run, schema)
