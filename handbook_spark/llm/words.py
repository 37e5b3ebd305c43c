"""Words of text columns as Arrow and numpy arrays.

A word is a run of characters other than space and U+0009 to U+000D (``[^\\x20\\x09-\\x0D]+``). All
helpers take whole texts; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one step of a task holds as arrays. A longer single text is a step of its own.
STEP_BYTES = 2 << 20
#: Rows of a step, so that a row's place in its step fits into 16 bits.
STEP_ROWS = 1 << 16

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with at most ``limit`` bytes in ``column`` each, in row order."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, begin = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if (total + size > limit or row - begin == STEP_ROWS) and row > begin:
            yield batch.slice(begin, row - begin)
            total, begin = 0, row
        total += size
    if batch.num_rows > begin:
        yield batch.slice(begin, batch.num_rows - begin)


def split(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words of each text: offsets (one more than texts) into all words, and the words, dictionary coded."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return kept[offsets], pc.dictionary_encode(flat.filter(full))


def lowered(texts: pa.Array) -> pa.Array:
    """A to Z in lower case; other letters stay."""
    return pc.ascii_lower(texts)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values in which every bit depends on all others."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes.

    The bytes of equally long strings are put side by side and folded column by column, so the cost
    is one array step per byte position; strings longer than 64 bytes are hashed one by one.
    """
    import xxhash

    strings = strings.cast(pa.large_binary())
    if len(strings) == 0:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    out = np.empty(len(strings), np.uint64)
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, bounds):
        size = int(sizes[rows[0]])
        if size > 64:
            for row in rows:
                out[row] = xxhash.xxh3_64_intdigest(data[offsets[row] : offsets[row] + size].tobytes(), seed=1)
            continue
        value = np.full(len(rows), size + 1, np.uint64) * _MULTIPLIER
        starts = offsets[rows]
        for at in range(0, size, 4):
            word = np.zeros(len(rows), np.uint64)
            for k in range(at, min(at + 4, size)):
                word = (word << np.uint64(8)) | data[starts + k].astype(np.uint64)
            value = (value ^ word) * np.uint64(0xD6E8FEB86659FD93)
            value = value ^ (value >> np.uint64(32))
        out[rows] = mixed(value)
    return out


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Slices of ``values`` one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return values[:0]
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    places = np.repeat((starts - (ends - counts)).astype(kind), counts)
    places += np.arange(total, dtype=kind)
    return values[places]


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate((array, np.zeros(max(size - len(array), len(array)), array.dtype)))


class ChunkMemo:
    """Token ids of text chunks that a task has seen; ``encode_new`` gives ids and counts of new ones.

    Chunks are looked up by a 64-bit hash, as arrays. The memo holds at most ``limit`` chunks and starts anew beyond
    that, which costs time but changes no result.
    """

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.clear()

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.ids = np.zeros(8192, np.int32)
        self.used = 0

    def codes(self, chunks: pa.Array, prefix: str = "") -> np.ndarray:
        """Memo places of different chunks, each with ``prefix`` before it."""
        keys = hashes(chunks)
        if prefix:
            keys = mixed(keys + _MULTIPLIER)
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = found < len(self.keys)
        known[inside] = self.keys[found[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(self.keys) + len(new) > self.limit:
            self.clear()
            found, known, new = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.arange(len(keys))
        codes = np.empty(len(keys), np.int64)
        codes[known] = self.places[found[known]]
        if len(new):
            ids, counts = self.encode_new([prefix + c for c in chunks.take(pa.array(new)).to_pylist()])
            first = len(self.keys)
            codes[new] = first + np.arange(len(new))
            order = np.argsort(keys[new], kind="stable")
            at = found[new][order]
            self.keys = np.insert(self.keys, at, keys[new][order])
            self.places = np.insert(self.places, at, codes[new][order])
            self.start = _room(self.start, first + len(new))
            self.count = _room(self.count, first + len(new))
            self.ids = _room(self.ids, self.used + len(ids))
            self.start[first : first + len(new)] = self.used + np.cumsum(counts) - counts
            self.count[first : first + len(new)] = counts
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        return codes
