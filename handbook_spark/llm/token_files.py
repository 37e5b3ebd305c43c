"""Token ids in grammar-compressed blocks.

Documents are encoded with a public tokenizer, dealt out by ranges of doc_id, and written in that order as
blocks. A block holds its ids as a Re-Pair grammar: pairs of ids that occur often are replaced by
nonterminals, again and again, and the rules are stored with the length of what each symbol expands to. With these
lengths a stretch of ids is decoded without expanding what lies before it.

Block format (little endian): the header ``HEADER`` with magic, bytes per symbol, vocabulary size, rules,
documents, symbols and ids; then left and right side of each rule, the expansion length of each rule, the
first symbol and the first id of each document (one more than documents), and the symbols.

Results for odd input: a null text encodes like an empty one (only the end id); null doc_ids come first; equal doc_ids
are ordered by text; a text longer than a block becomes a block of its own; an empty table gives no
blocks; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handbook_spark.llm.words import ChunkMemo, gather, lowered, split, steps
from handbook_spark.session import materialize

END_ID = 2
#: Ids of a block; it ends with the document that reaches this number.
BLOCK_IDS = 1 << 20
#: A pair is replaced if it occurs so often in a block; a round that saves less than this part ends the grammar.
MIN_COUNT, MIN_SAVING, MAX_ROUNDS = 8, 0.02, 8
HEADER = struct.Struct("<4sIQQQQQ")
MAGIC = b"RPG1"
#: Different chunks whose ids a task remembers.
MEMO_CHUNKS = 1_000_000
#: Text bytes that are encoded at once; large steps look a frequent word up less often.
ENCODE_BYTES = 8 << 20
#: Most range borders that one aggregate looks up.
_ACCURACY = 100_000


class LibraryEncoder(ChunkMemo):
    """Ids by the tokenizers library, for a tokenizer that drops white space and lowers all letters.

    Chunks between white space are then independent of each other, and so is a full stop or comma behind an
    ASCII letter. Each different chunk goes through the library once per memo.
    """

    def __init__(self, path: str, memo: int = MEMO_CHUNKS):
        super().__init__(memo)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.ends = np.zeros(self.vocabulary, bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.ends[at] = token.endswith("</w>")
        self.marks = np.array([self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,"], np.int32)

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(chunks), np.int64)
        letters = np.fromiter((c.lower().isalpha() for c in chunks), bool, len(chunks))
        plain, other = np.flatnonzero(letters), np.flatnonzero(~letters)
        # Words of letters are encoded many at a time: each ends with the one token that closes a word.
        words = [chunks[i] for i in plain.tolist()]
        joined = self._flat([" ".join(words[at : at + 256]) for at in range(0, len(words), 256)])[0]
        ends = np.flatnonzero(self.ends[joined])
        if len(ends) == len(plain):
            counts[plain] = np.diff(ends, prepend=-1)
        else:
            joined, counts[plain] = self._flat(words)
        single, counts[other] = self._flat([chunks[i] for i in other.tolist()])
        starts = np.zeros(len(chunks), np.int64)
        starts[plain] = np.cumsum(counts[plain]) - counts[plain]
        starts[other] = len(joined) + np.cumsum(counts[other]) - counts[other]
        return gather(np.concatenate((joined, single)), starts, counts), counts

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's number of ids; with ``end_id`` behind each text if given."""
        # Special tokens are matched before letters are lowered, so texts that may hold one stay as they are.
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        offsets, words = split(pc.if_else(special, texts, lowered(texts)))
        whole = words.dictionary
        stop = pc.match_substring_regex(whole, "[A-Za-z][.,]$").to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(stop), pc.utf8_slice_codeunits(whole, 0, -1), whole)
        mark = np.where(stop, pc.ends_with(whole, ",").to_numpy(zero_copy_only=False).astype(np.int64), -1)
        cut = pc.dictionary_encode(cut)
        code_of = self.codes(cut.dictionary)[cut.indices.to_numpy()]
        index = words.indices.to_numpy()
        # The ids of each different word of this step, with its mark behind.
        counts = self.count[code_of] + (mark >= 0)
        pool = np.empty(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        has = mark >= 0
        inner = np.ones(len(pool), bool)
        inner[ends[has] - 1] = False
        pool[inner] = gather(self.ids, self.start[code_of], self.count[code_of])
        pool[ends[has] - 1] = self.marks[mark[has], 0]
        per_word = counts[index]
        before = np.concatenate(([0], np.cumsum(per_word)))
        per_text = np.diff(before[offsets])
        ids = gather(pool, (ends - counts)[index], per_word)
        if end_id is None:
            return ids, per_text
        return np.insert(ids, np.cumsum(per_text), end_id), per_text + 1


@functools.lru_cache(maxsize=2)
def library_encoder(path: str, memo: int = MEMO_CHUNKS) -> LibraryEncoder:
    return LibraryEncoder(path, memo)


def grammar(ids: np.ndarray, firsts: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of one block: rules (n x 2), symbols, and each document's first symbol.

    Each round counts all neighbouring pairs, and replaces every pair above the threshold at once, from left to right
    without overlaps. A pair never spans two documents. Counts are kept in a table of hashed
    pairs in which one pair owns a slot; pairs that lose their slot take part in later rounds, which hash anew.
    """
    small = vocabulary < 65536
    half, wide = (16, np.uint32) if small else (32, np.uint64)
    multiplier, width = (0x9E3779B1, 32) if small else (0x9E3779B97F4A7C15, 64)
    symbols = ids.astype(wide)
    begins = firsts.astype(np.int64)  # of documents among the symbols, and the end
    rules: list[np.ndarray] = []
    n_rules, limit = 0, (1 << half) - vocabulary
    for turn in range(MAX_ROUNDS):
        size = len(symbols)
        if size < 2:
            break
        bits = max(12, min(18, size.bit_length() - 1))
        keys = (symbols[:-1] << wide(half)) | symbols[1:]
        slots = (keys * wide(multiplier + 2 * turn)) >> wide(width - bits)
        # The first rounds take only the most frequent pairs: what they make is what later ones build upon.
        least = max(MIN_COUNT, size >> (11 + 2 * turn))
        # Places in slots with enough pairs of any kind; then the pairs of the one that owns the slot.
        at = np.flatnonzero((np.bincount(slots, minlength=1 << bits) >= least)[slots])
        edge = np.zeros(size + 1, bool)
        edge[begins] = True
        at = at[~edge[at + 1]]
        keys, slots = keys[at], slots[at]
        owner = np.zeros(1 << bits, wide)
        owner[slots] = keys
        owned = owner[slots] == keys
        at, slots = at[owned], slots[owned]
        counts = np.bincount(slots, minlength=1 << bits)
        chosen = np.flatnonzero(counts >= least)
        if not len(chosen) and least > MIN_COUNT:
            continue
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")][: max(limit - n_rules, 0)]
        if not len(chosen):
            break
        marked = np.zeros(1 << bits, bool)
        marked[chosen] = True
        kept = marked[slots]
        at, slots = at[kept], slots[kept]
        # Of neighbouring places every second one, from the first on.
        new_run = np.ones(len(at), bool)
        new_run[1:] = at[1:] != at[:-1] + 1
        begin = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        kept = (np.arange(len(at)) - begin) & 1 == 0
        at, slots = at[kept], slots[kept]
        # A rule that overlaps left once or never would cost more than it saves.
        used = np.bincount(slots, minlength=1 << bits)
        chosen = chosen[used[chosen] >= 2]
        name = np.zeros(1 << bits, wide)
        name[chosen] = np.arange(vocabulary + n_rules, vocabulary + n_rules + len(chosen)).astype(wide)
        made = name[slots]
        at, made = at[made > 0], made[made > 0]
        pair = owner[chosen]
        rules.append(np.stack((pair >> wide(half), pair & wide((1 << half) - 1)), 1).astype(np.int64))
        n_rules += len(chosen)
        symbols[at] = made
        keep = np.ones(size, bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        begins = begins - np.searchsorted(at, begins - 1)
        if len(at) < MIN_SAVING * size and least == MIN_COUNT:
            break
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), symbols, begins


def lengths_of(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Number of ids that each rule stands for; a rule uses only rules before it."""
    lengths = np.ones(len(rules), np.int64)
    left, right = rules[:, 0].tolist(), rules[:, 1].tolist()
    found: list[int] = []
    for a, b in zip(left, right):
        found.append((1 if a < vocabulary else found[a - vocabulary]) + (1 if b < vocabulary else found[b - vocabulary]))
    lengths[:] = found
    return lengths


def pack(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> bytes:
    """One block of the file format from the ids of its documents."""
    firsts = np.concatenate(([0], np.cumsum(counts)))
    rules, symbols, begins = grammar(ids, firsts, vocabulary)
    kind = "<u2" if vocabulary + len(rules) <= 65536 else "<u4"
    head = HEADER.pack(MAGIC, int(kind[-1]), vocabulary, len(rules), len(counts), len(symbols), len(ids))
    return b"".join((
        head, rules[:, 0].astype(kind).tobytes(), rules[:, 1].astype(kind).tobytes(),
        lengths_of(rules, vocabulary).astype("<u4").tobytes(), begins.astype("<u8").tobytes(),
        firsts.astype("<u8").tobytes(), symbols.astype(kind).tobytes()))


class Block:
    """A packed block: all ids, or any stretch of them."""

    def __init__(self, data: bytes):
        magic, width, self.vocabulary, n_rules, n_docs, n_symbols, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        kind, at = f"<u{width}", HEADER.size

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype, count, at)
            at += found.nbytes
            return found

        self.left, self.right = take(kind, n_rules), take(kind, n_rules)
        self.lengths = take("<u4", n_rules)
        self.begins, self.firsts = take("<u8", n_docs + 1), take("<u8", n_docs + 1)
        self.symbols = take(kind, n_symbols)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        made = symbols >= self.vocabulary
        out[made] = self.lengths[symbols[made] - self.vocabulary]
        return out

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols: rules are opened until only ids are left, one array step per level."""
        symbols = symbols.astype(np.int64)
        while True:
            made = symbols >= self.vocabulary
            if not made.any():
                return symbols
            rule = symbols[made] - self.vocabulary
            place = np.arange(len(symbols)) + np.cumsum(made) - made
            out = np.empty(len(symbols) + len(rule), np.int64)
            out[place[~made]] = symbols[~made]
            out[place[made]], out[place[made] + 1] = self.left[rule], self.right[rule]
            symbols = out

    @functools.cached_property
    def _phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Expansions of all rules one after the other, and where each begins."""
        starts = np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))
        return self._expand(np.arange(self.vocabulary, self.vocabulary + len(self.left))), starts

    def ids(self) -> np.ndarray:
        phrases, starts = self._phrases
        symbols = self.symbols.astype(np.int64)
        pool = np.concatenate((np.arange(self.vocabulary), phrases))
        where = np.where(symbols < self.vocabulary, symbols, 0)
        made = symbols >= self.vocabulary
        where[made] = self.vocabulary + starts[symbols[made] - self.vocabulary]
        return gather(pool, where, self._sizes(self.symbols))

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop`` of the block; only the symbols that reach into it are expanded."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.int64)
        first = int(np.searchsorted(self.firsts, start, "right")) - 1
        last = int(np.searchsorted(self.firsts, stop, "left"))
        symbols = self.symbols[self.begins[first] : self.begins[last]]
        ends = int(self.firsts[first]) + np.cumsum(self._sizes(symbols))
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        before = int(self.firsts[first]) if a == 0 else int(ends[a - 1])
        return self._expand(symbols[a : b + 1])[start - before : stop - before]

    def document(self, row: int) -> np.ndarray:
        return self.slice(int(self.firsts[row]), int(self.firsts[row + 1]))


def write_blocks(docs: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Stored blocks of ``docs`` (doc_id, text): part, block, doc_ids, n_ids, payload.

    Parts are ranges of doc_id and blocks count up within a part, so (part, block) follows doc_id. Range
    borders come from a scan of doc_id alone; texts are read and encoded once, and only ids are dealt out.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    borders: list = []
    if shares:
        borders = docs.agg(F.percentile_approx("doc_id", shares, min(_ACCURACY, 100 * parts)).alias("b")).first()["b"] or []
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        narrow = encoder.vocabulary <= 65536
        limits = np.array(borders, np.float64 if any(isinstance(b, float) for b in borders) else np.int64)
        for batch in batches:
            for rows in steps(batch, limit=ENCODE_BYTES):
                ids, counts = encoder.encode(rows.column("text"), end_id)
                data = ids.astype("<u2" if narrow else "<u4")
                ends = np.concatenate(([0], np.cumsum(counts))) * data.itemsize
                cells = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                doc_id = rows.column("doc_id")
                part = np.searchsorted(limits, doc_id.fill_null(0).to_numpy(zero_copy_only=False), "left")
                part[doc_id.is_null().to_numpy(zero_copy_only=False)] = 0
                yield pa.RecordBatch.from_arrays(
                    [doc_id, pa.array(part, pa.int32()), cells.cast(pa.binary())], names=["doc_id", "part", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = library_encoder(path).vocabulary
        kind = np.dtype("<u2" if vocabulary <= 65536 else "<u4")
        id_arrow = None
        held: list[np.ndarray] = []
        counts: list[int] = []
        doc_ids: list = []
        total, part, block = 0, None, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, counts, doc_ids, total, block
            payload = pack(np.concatenate(held), np.array(counts, np.int64), vocabulary)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([doc_ids], pa.list_(id_arrow)),
                 pa.array([total], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "block", "doc_ids", "n_ids", "payload"])
            held, counts, doc_ids, total, block = [], [], [], 0, block + 1
            return out

        for batch in batches:
            id_arrow = batch.column("doc_id").type
            for doc_id, at, cell in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "ids"))):
                if at != part:
                    if counts:
                        yield flush()
                    part, block = at, 0
                ids = np.frombuffer(cell, kind)
                held.append(ids)
                counts.append(len(ids))
                doc_ids.append(doc_id)
                total += len(ids)
                if total >= block_ids:
                    yield flush()
        if counts:
            yield flush()

    encoded = source.mapInArrow(encode, f"doc_id {id_type}, part int, ids binary")
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    return materialize(dealt.mapInArrow(
        fill, f"part int, block int, doc_ids array<{id_type}>, n_ids long, payload binary"))


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Documents of stored blocks: doc_id, start, n_tokens, ids_crc32. ``start`` counts the ids of all documents before it."""
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, doc_ids, payload in zip(*(batch.column(c) for c in ("part", "block", "doc_ids", "payload"))):
                block = Block(payload.as_py())
                data = block.ids().astype("<u4")
                firsts = block.firsts.astype(np.int64)
                crcs = [zlib.crc32(data[a:b]) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(part, n), pa.repeat(at, n), doc_ids.values, pa.array(firsts[:-1]),
                     pa.array(np.diff(firsts)), pa.array(crcs, pa.int64())],
                    names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = blocks.select("part", "block", "doc_ids", "payload").mapInArrow(
        read, f"part int, block int, doc_id {id_type}, inside long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", "block", "n_ids")
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select(
        "part", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("part_start"))  # one row per part
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("block_start")).join(
        parts, "part")
    return rows.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
