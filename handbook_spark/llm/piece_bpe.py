"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's characters are symbols; every two neighbours whose joined piece is in the vocabulary stand in an agenda,
ordered by the piece's score and then from left to right. The best entry is taken, its two symbols become one, and the pairs
with the new neighbours enter; entries of symbols that are gone are passed over. Symbols without a piece become byte pieces.

A merge that joins two characters makes a piece that holds them side by side. So where two neighbours of a text occur side by side in
no piece of the vocabulary, nothing can merge, and texts are cut there: the agenda runs over chunks, and a task remembers the ids
of those it has seen. The new chunks of each Arrow batch are encoded by the sentencepiece library as well, and a difference is an error.

Results for odd input: a null text encodes like an empty one, to the end id alone; U+2581 reads as a space, as in the library;
a text of any length is encoded whole; repeated rows are encoded one by one; extra columns are ignored unless named in
``keep``; an empty table gives no rows. Ids that are no text decode like in the library: control ids to nothing, unknown to
its mark, each byte that belongs to no character to U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm.words import ChunkMemo, gather, steps

SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Chunks whose ids a task remembers, about 50 bytes each.
MEMO_CHUNKS = 1_000_000


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
        yield tag >> 3, message[at : at + size]
        at += size


class Pieces:
    """A merge-type vocabulary: pieces with scores, byte pieces, and the tables of the decoder."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as file:
            parts = list(fields(file.read()))
        trainer = dict(fields(next((v for k, v in parts if k == 2), b"")))
        normalizer = dict(fields(next((v for k, v in parts if k == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type vocabulary")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or not normalizer.get(3, 1):
            raise ValueError("only the identity normalizer with a leading space is supported")
        scores: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = np.full(256, -1, np.int64)
        shown, self.silent, self.is_byte = [], [], []
        mark = trainer.get(44, " ⁇ ".encode()).decode()
        for at, piece in enumerate(dict(fields(v)) for k, v in parts if k == 1):
            text, kind = piece[1].decode(), piece.get(3, NORMAL)
            if kind == NORMAL:
                scores[text] = float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
                self.id[text] = at
            elif kind == BYTE:
                self.byte[int(text[3:5], 16)] = at
            elif kind not in (UNKNOWN, CONTROL):
                raise ValueError(f"pieces of kind {kind} are not supported")
            shown.append(text.replace(SPACE, " ").encode() if kind == NORMAL else bytes([int(text[3:5], 16)]) if kind == BYTE
                         else mark.encode() if kind == UNKNOWN else b"")
            self.silent.append(kind == CONTROL)
            self.is_byte.append(kind == BYTE)
        if (self.byte < 0).any():
            raise ValueError("only vocabularies with byte pieces are supported")
        self.end = trainer.get(42, 2)
        self.spaced = np.array([s.startswith(b" ") and not b for s, b in zip(shown, self.is_byte)]) & np.array(
            [piece in self.id for piece in self._names(parts)])
        self.silent, self.is_byte = np.array(self.silent), np.array(self.is_byte)
        # Bytes that each id shows, and its decimal digits with a space before.
        self.shown = _Table(shown)
        self.digits = _Table([b" %d" % i for i in range(len(shown))])
        self._merges(scores, len(shown))

    def _merges(self, scores: dict[str, float], size: int) -> None:
        """Pairs of symbols that make a piece, its rank by score, and the characters that stand side by side in pieces.

        Characters of pieces that are no pieces themselves are symbols behind the ids; all others are the last symbol.
        """
        characters = sorted({c for piece in self.id for c in piece})
        self.symbol = {c: self.id[c] if c in self.id else size + n for n, c in enumerate(characters)}
        self.other = size + len(characters)
        self.known = size
        order = {score: n for n, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {self.id[piece]: order[score] for piece, score in scores.items()}
        self.pair: dict[int, int] = {}
        for piece, at in self.id.items():
            for cut in range(1, len(piece)):
                left, right = (self.symbol[part] if len(part) == 1 else self.id.get(part) for part in (piece[:cut], piece[cut:]))
                if left is not None and right is not None:
                    self.pair[left * (self.other + 1) + right] = at
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.beside = np.zeros((len(characters) + 1, len(characters) + 1), bool)
        for piece in self.id:
            classes = self.class_of[[ord(c) for c in piece]]
            self.beside[classes[:-1], classes[1:]] = True
        # A character at which texts are always cut.
        self.separator = next(c for c in "\n\x01\x02\x03" if not (self.beside[self.class_of[ord(c)]].any() or self.beside[:, self.class_of[ord(c)]].any()))

    def cuts(self, text: str) -> np.ndarray:
        """Whether a chunk begins at each character of a text but the first."""
        classes = self.class_of[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        return ~self.beside[classes[:-1], classes[1:]]

    @staticmethod
    def _names(parts: list) -> Iterator[str]:
        return (dict(fields(v))[1].decode() for k, v in parts if k == 1)

    def encode(self, text: str) -> list[int]:
        """Ids of a text whose spaces are U+2581, by the agenda."""
        symbols = [self.symbol.get(c, self.other) for c in text]
        last, pair, rank, base = len(symbols), self.pair, self.rank, self.other + 1
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        # An entry is a rank and the place of the left symbol.
        agenda = [rank[made] << 40 | at for at in range(last - 1) if (made := pair.get(symbols[at] * base + symbols[at + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            at = entry & (1 << 40) - 1
            right = after[at]
            if symbols[at] < 0 or right == last:
                continue
            made = pair.get(symbols[at] * base + symbols[right])
            if made is None or rank[made] != entry >> 40:
                continue
            symbols[at], symbols[right] = made, -1
            following = after[at] = after[right]
            if following < last:
                before[following] = at
                if (next_made := pair.get(made * base + symbols[following])) is not None:
                    heapq.heappush(agenda, rank[next_made] << 40 | at)
            left = before[at]
            if left >= 0 and (next_made := pair.get(symbols[left] * base + made)) is not None:
                heapq.heappush(agenda, rank[next_made] << 40 | left)
        ids: list[int] = []
        for at, symbol in enumerate(symbols):
            if 0 <= symbol < self.known:
                ids.append(symbol)
            elif symbol >= 0:
                ids.extend(self.byte[b] for b in text[at].encode())
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids."""
        ids = np.asarray(ids, np.int64)
        silent = self.silent[ids]
        said = ids[~silent]
        if not len(said):
            return b""
        skip = int(self.spaced[said[0]])  # the space that encoding puts before a text
        if not self.is_byte[said].any():
            return self.shown.rows(said).tobytes()[skip:]
        # Bytes on both sides of a control id never make a character together.
        breaks = np.flatnonzero(silent)
        return b"".join(_valid(self.shown.rows(part).tobytes()) for part in np.split(ids, breaks))[skip:]


def _valid(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return _replaced(data)


class _Table:
    """Byte strings by id, one after the other."""

    def __init__(self, values: list[bytes]):
        self.size = np.array([len(v) for v in values], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(values), np.uint8)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.start[ids], self.size[ids])


_CHARACTER = re.compile(
    rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|(.)", re.DOTALL)


def _replaced(data: bytes) -> bytes:
    """Each byte that belongs to no character replaced by U+FFFD."""
    return _CHARACTER.sub(lambda m: b"\xef\xbf\xbd" if m[1] else m[0], data)


class BatchEncoder(ChunkMemo):
    """Ids of whole columns; each different chunk goes through the agenda once and is checked against the library."""

    def __init__(self, pieces: Pieces, checked: bool = True):
        super().__init__(MEMO_CHUNKS)
        self.pieces, self.library = pieces, None
        if checked:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=pieces.path)

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.pieces.encode(c.replace(" ", SPACE)) for c in chunks]
        if self.library:
            self._check(chunks, found)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for row in found for i in row), np.int32, int(counts.sum())), counts

    def _check(self, chunks: list[str], found: list[list[int]]) -> None:
        """The library encodes each chunk behind a character at which it is cut."""
        before = self.library.encode(self.pieces.separator)
        theirs = self.library.encode([self.pieces.separator + c for c in chunks], num_threads=1)
        for chunk, ids, wanted in zip(chunks, found, theirs):
            if [*before, *ids] != wanted:
                raise AssertionError(f"ids of {chunk[:80]!r} differ from the library's")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id behind each text, and each text's number of ids."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        space, nothing = (pa.scalar(s, pa.large_string()) for s in (" ", ""))
        texts = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), nothing, space), texts, nothing)
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2] or pa.py_buffer(b"")
        full = np.frombuffer(data, np.uint8)[: offsets[-1]]
        cut = self.pieces.cuts(full.tobytes().decode().replace(" ", SPACE))
        first = np.flatnonzero((full & 0xC0) != 0x80)  # bytes at which characters begin
        starts = np.union1d(first[1:][cut], offsets[:-1][np.diff(offsets) > 0])
        starts = starts[(starts >= offsets[0]) & (starts < offsets[-1])]
        bounds = np.append(starts, offsets[-1]).astype(np.int64)
        if len(starts):
            chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), data)
            coded = pc.dictionary_encode(chunks)
            code = self.codes(coded.dictionary)[coded.indices.to_numpy()]
            counts = self.count[code]
            ids = gather(self.ids, self.start[code], counts)
        else:
            counts, ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        before = np.concatenate(([0], np.cumsum(counts)))
        per_text = np.diff(before[np.searchsorted(starts, offsets)])
        return np.insert(ids, np.cumsum(per_text), self.pieces.end), per_text + 1


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


@functools.lru_cache(maxsize=2)
def batch_encoder(path: str) -> BatchEncoder:
    return BatchEncoder(load(path))


def _mapped(docs: DataFrame, column: str, keep: tuple[str, ...], made: dict[str, str], build) -> DataFrame:
    """``keep`` columns with those that ``build`` makes of ``column``, step by step."""
    source = docs.select(*keep, F.col(column).alias("__in"))
    kept = source.schema.fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{n} {t}" for n, t in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "__in") if column == "text" else [batch]:
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in kept] + build(part.column("__in")), names=[f.name for f in kept] + list(made))

    return source.mapInArrow(run, schema)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids, pa.int32()))


def encode_documents(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` columns with ``ids``, those of the text and the end id."""
    return _mapped(docs, "text", keep, {"ids": "array<int>"}, lambda texts: [_lists(*batch_encoder(path).encode(texts))])


def decode_ids(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` columns with ``text``, decoded from the ``ids`` column; null ids are no ids."""

    def build(column: pa.Array) -> list[pa.Array]:
        return [pa.array([load(path).decode(np.asarray(row.values, np.int64) if row.is_valid else []).decode() for row in column], pa.string())]

    return _mapped(encoded, "ids", keep, {"text": "string"}, build)


def digests(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 (decimal ids joined by spaces) and decoded_sha256, in one pass."""

    def build(texts: pa.Array) -> list[pa.Array]:
        encoder = batch_encoder(path)
        pieces = encoder.pieces
        ids, counts = encoder.encode(texts)
        written, ends = pieces.digits.rows(ids), np.cumsum(pieces.digits.size[ids])
        id_hashes, text_hashes, at, begin = [], [], 0, 0
        for count in counts.tolist():
            end = int(ends[at + count - 1])
            id_hashes.append(hashlib.sha256(written[begin + 1 : end]).hexdigest())
            text_hashes.append(hashlib.sha256(pieces.decode(ids[at : at + count])).hexdigest())
            at, begin = at + count, end
        return [pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]

    return _mapped(docs, "text", keep, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, build)
