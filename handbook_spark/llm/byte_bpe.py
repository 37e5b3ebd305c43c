"""Byte-level BPE as a streaming transducer, and its decoder as a state machine.

Encoding needs no whole text: merges never cross the pieces that the splitting pattern gives, and inside
a long piece a token is final once ``Merges.lookahead`` more bytes are known. That bound follows from the
merge list alone (see ``sufficient_lookahead``), so an encoder holds at most one window of bytes. Decoding feeds
the bytes of ids to an incremental UTF-8 machine that holds at most three bytes.

Results for odd input: a null text encodes like an empty one (no ids, the hashes of nothing); the special
token's string in a text becomes its id; a text of any length is encoded whole, in windows; repeated
rows are encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm.words import STEP_BYTES, ChunkMemo, gather, steps

#: White space of the splitting pattern. ``\s`` of the installed modules has a few more characters.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_RUNS = {kind: regex.compile(p) for kind, p in (
    ("L", r"\p{L}*"), ("N", r"\p{N}*"), ("O", rf"[^{_SPACE}\p{{L}}\p{{N}}]*"), ("S", rf"[{_SPACE}]*"))}
#: A cut before a space that follows something else than white space is always between two pieces.
_CUT = regex.compile(rf"[^{_SPACE}](?= )")
#: Texts that cannot be cut at every space: white space before a space, or uncommon white space.
_UNEVEN = r"[\t-\r\x20]\x20|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Pieces up to so many bytes are merged as rows of a matrix, longer ones by the streaming encoder.
_MATRIX_BYTES = 40
#: Chunks (a space and what follows up to the next one) whose ids a task remembers.
MEMO_CHUNKS = 300_000
_NONE = np.int32(2**31 - 1)


def sufficient_lookahead(merges: list[tuple[int, int, int]], singles: list[int], length: dict[int, int]) -> int:
    """Bytes after a token that can still change it, at most, for merges (left, right, result) by rank.

    Take the same bytes with and without more text behind them, and the leftmost place where the two token
    rows differ (the front) as merges are applied by rank. It moves left only when a merge (u, v) happens in one
    row, where v starts at the front; then the token there is uv in one row and u in the other, and the
    front moved by the length of u. The token at the front may also grow to the right by merges of higher
    rank. Ranks rise along such a chain, so one pass in rank order gives, for each token, how far the front
    can have moved when that token stands there.
    """
    reach = dict.fromkeys(singles, 0)
    for left, right, made in merges:
        grown, moved = reach.get(left, -1), reach.get(right, -1)
        moved = moved + length[left] if moved >= 0 else -1
        if max(grown, moved) >= 0:
            reach[made] = max(reach.get(made, -1), grown, moved)
        if moved >= 0:
            reach[left] = max(grown, moved)
    return max(reach.values(), default=0)


class Merges:
    """A byte-level BPE vocabulary: ids, bytes and ranked merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, at in vocab.items():
            if token not in self.special:
                self.bytes[at] = bytes(byte_of[c] for c in token)
        for token, at in self.special.items():
            self.bytes[at] = token.encode()
        self.single = np.zeros(256, np.int32)
        for char, b in byte_of.items():
            self.single[b] = vocab[char]
        rows = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            rows.append((vocab[left], vocab[right], vocab[left + right]))
        self.rank = {(left, right): (rank, made) for rank, (left, right, made) in reversed(list(enumerate(rows)))}
        self.lookahead = sufficient_lookahead(
            rows, self.single.tolist(), {i: len(b) for i, b in enumerate(self.bytes)})
        self._tables(rows)
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_length = lengths
        self.byte_start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.byte_data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _tables(self, rows: list[tuple[int, int, int]]) -> None:
        """Open-addressed table from a pair of ids to its rank."""
        self.made = np.array([made for *_, made in rows], np.int32)
        self.bits = max(len(rows).bit_length() + 3, 4)
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, _NONE, np.int32)
        self.probes = 1
        mask = (1 << self.bits) - 1
        for (left, right), (rank, _) in self.rank.items():
            key = left << 32 | right
            slot, probe = self._slot(key), 1
            while self.slot_key[slot] != -1:
                slot, probe = slot + 1 & mask, probe + 1
            self.slot_key[slot], self.slot_rank[slot] = key, rank
            self.probes = max(self.probes, probe)

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` where no merge applies."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(key.shape, _NONE, np.int32)
        open_rows = np.flatnonzero((left >= 0) & (right >= 0))
        key, slot = key.ravel()[open_rows], slot.ravel()[open_rows]
        flat = out.ravel()
        for _ in range(self.probes):
            there = self.slot_key[slot]
            hit = there == key
            flat[open_rows[hit]] = self.slot_rank[slot[hit]]
            more = ~hit & (there != -1)
            if not more.any():
                break
            open_rows, key, slot = open_rows[more], key[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)

    def encode_window(self, data: bytes) -> list[int]:
        """Ids of one piece's bytes: the merge of lowest rank first, the leftmost first within a rank."""
        ids = self.single[np.frombuffer(data, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap = [(*self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        alive = [True] * len(ids)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or self.rank.get((ids[i], ids[j]), (None,))[0] != rank:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if found := self.rank.get((made, ids[after[i]])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if before[i] >= 0 and (found := self.rank.get((ids[before[i]], made))):
                heapq.heappush(heap, (found[0], before[i], found[1]))
        return [x for x, living in zip(ids, alive) if living]

    def encode_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces and the number of ids of each; all pieces of one length step together."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # rows, ids matrix with -1 behind
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            if size > _MATRIX_BYTES:
                for row in rows.tolist():
                    encoder = StreamingEncoder(self)
                    found = encoder.feed(pieces[row]) + encoder.finish()
                    counts[row] = len(found)
                    parts.append((np.array([row]), np.array([found], np.int32)))
                continue
            data = np.frombuffer(b"".join([pieces[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), size)
            ids = self.single[data]
            rank = self.ranks(ids[:, :-1], ids[:, 1:]) if size > 1 else np.full((len(rows), 0), _NONE, np.int32)
            while rank.shape[1]:
                best = rank.argmin(1)
                at = np.arange(len(rows))
                live = rank[at, best] != _NONE
                done = ~live
                if done.any():
                    counts[rows[done]] = (ids[done] >= 0).sum(1)
                    parts.append((rows[done], ids[done]))
                    rows, ids, rank, best = rows[live], ids[live], rank[live], best[live]
                    at = np.arange(len(rows))
                if not len(rows):
                    break
                ids[at, best] = self.made[rank[at, best]]
                columns = np.arange(ids.shape[1] - 1)
                ids = np.take_along_axis(ids, columns + (columns > best[:, None]), 1)
                columns = columns[:-1]
                rank = np.take_along_axis(rank, columns + (columns >= best[:, None]), 1)
                width = rank.shape[1]
                for shift in (-1, 0):
                    pair = best + shift
                    ok = np.flatnonzero((pair >= 0) & (pair < width))
                    if len(ok):
                        rank[ok, pair[ok]] = self.ranks(ids[ok, pair[ok]], ids[ok, pair[ok] + 1])
            if len(rows):
                counts[rows] = (ids >= 0).sum(1)
                parts.append((rows, ids))
        starts = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(starts[-1], np.int32)
        for rows, ids in parts:
            for width in np.unique(counts[rows]).tolist():
                of = counts[rows] == width
                out[starts[rows[of]][:, None] + np.arange(width)] = ids[of][:, :width]
        return out, counts


class StreamingEncoder:
    """Ids of one piece whose bytes arrive in parts; holds one window of bytes."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.window = 4 * merges.lookahead + 64
        self.held = bytearray()

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) < self.window:
                continue
            final, end = len(self.held) - self.merges.lookahead, 0
            for token in self.merges.encode_window(bytes(self.held)):
                if end + len(self.merges.bytes[token]) > final:
                    break
                end += len(self.merges.bytes[token])
                out.append(token)
            del self.held[:end]
        return out

    def finish(self) -> list[int]:
        out = self.merges.encode_window(bytes(self.held)) if self.held else []
        self.held.clear()
        return out


class Transducer:
    """Ids of one text whose characters arrive in parts; memory does not grow with the text.

    Text is held back to the last place that is surely between two pieces. A run of one kind that is longer than
    ``hold`` characters is passed on to a streaming encoder as it comes.
    """

    def __init__(self, merges: Merges, hold: int = 1 << 16):
        self.longest = max(map(len, merges.special), default=0)
        self.merges, self.hold = merges, max(hold, 4 * self.longest, 16)
        self.tail = ""
        self.run: StreamingEncoder | None = None
        self.kind = ""

    def feed(self, text: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(text), self.hold):
            self.tail += text[at : at + self.hold]
            out += self._stable()
        return out

    def finish(self) -> list[int]:
        out: list[int] = []
        if self.run is not None:
            more = _RUNS[self.kind].match(self.tail).end()
            if m := self._special():
                more = min(more, m.start())
            if self.kind == "S" and more < len(self.tail):
                more = max(more - 1, 0)
            out += self._end_run(more)
        out += self._ids(self.tail)
        self.tail = ""
        return out

    def _special(self):
        return self.merges.special_pattern.search(self.tail) if self.merges.special_pattern else None

    def _ids(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in _specials(self.merges, text):
            out += [special] if special is not None else self.merges.encode_rows(
                [p.encode() for p in _PIECES.findall(part)])[0].tolist()
        return out

    def _end_run(self, more: int) -> list[int]:
        out = self.run.feed(self.tail[:more].encode()) + self.run.finish()
        self.run, self.tail = None, self.tail[more:]
        return out

    def _stable(self) -> list[int]:
        """Ids that no further text can change; the rest of the text stays in ``tail``."""
        out: list[int] = []
        # The end of the tail may be the beginning of a special token's string.
        sure = len(self.tail) - self.longest
        if self.run is not None:
            m = self._special()
            more = min(_RUNS[self.kind].match(self.tail).end(), m.start() if m else len(self.tail))
            back = 1 if self.kind == "S" else 0  # the last space of a run may belong to the next piece
            if more > sure and not m:
                fed = max(min(more - back, sure), 0)
                out = self.run.feed(self.tail[:fed].encode())
                self.tail = self.tail[fed:]
                return out
            # White space right before a special token's string ends its text, and so stays whole.
            out = self._end_run(more if m and more == m.start() else max(more - back, 0))
        if m := _last_cut(self.tail):
            out += self._ids(self.tail[: m.end()])
            self.tail = self.tail[m.end() :]
        if len(self.tail) <= self.hold or self._special():
            return out
        # No cut in a long text: pieces that end well before the tail does are final.
        sure = len(self.tail) - self.longest
        ends = [m.end() for m in _PIECES.finditer(self.tail)]
        used = max([e for e in ends[:-2] if e <= sure], default=0)
        out += self._ids(self.tail[:used])
        self.tail = self.tail[used:]
        piece = _PIECES.match(self.tail)[0]
        if len(piece) > self.hold // 2:
            body = piece if piece.isspace() else piece.lstrip(" ")
            self.kind = next(k for k in "LNOS" if _RUNS[k].match(body).end())
            self.run = StreamingEncoder(self.merges)
            lead = len(piece) - len(body)
            out += self.run.feed(self.tail[:lead].encode())
            self.tail = self.tail[lead:]
            out += self._stable()
        return out


def _last_cut(text: str):
    for back in (4096, len(text)):
        last = None
        for last in _CUT.finditer(text, max(len(text) - back, 0)):
            pass
        if last:
            return last
    return None


def _specials(merges: Merges, text: str) -> Iterator[tuple[str, int | None]]:
    at = 0
    if merges.special_pattern is not None:
        for m in merges.special_pattern.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], merges.special[m[0]]
            at = m.end()
    if at < len(text):
        yield text[at:], None


class TextMachine:
    """Text of ids that arrive in parts; bytes of an unfinished character wait for the next part."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.machine.decode(token_bytes(self.merges, ids))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def token_bytes(merges: Merges, ids: np.ndarray) -> bytes:
    sizes = merges.byte_length[ids]
    ends = np.cumsum(sizes)
    if not len(ids):
        return b""
    places = np.arange(ends[-1]) + np.repeat(merges.byte_start[ids] - (ends - sizes), sizes)
    return merges.byte_data[places].tobytes()


class BatchEncoder(ChunkMemo):
    """Ids of whole columns: texts are cut at spaces, and each different chunk goes through the merges once."""

    def __init__(self, merges: Merges):
        super().__init__(MEMO_CHUNKS)
        self.merges = merges

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, which are split into pieces; each different piece is merged once."""
        pieces = [_PIECES.findall(c) for c in chunks]
        place: dict[str, int] = {}
        where = np.array([place.setdefault(p, len(place)) for row in pieces for p in row], np.int64)
        ids, counts = self.merges.encode_rows([p.encode() for p in place])
        per_piece = counts[where]
        ends = np.concatenate(([0], np.cumsum(per_piece)))
        last = np.cumsum([len(row) for row in pieces])
        return gather(ids, (np.cumsum(counts) - counts)[where], per_piece), np.diff(ends[last], prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's number of ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        for special in self.merges.special:
            uneven |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        uneven |= pc.greater(pc.binary_length(texts), STEP_BYTES).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(uneven), "", texts), " ")
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = pc.dictionary_encode(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
        offsets = offsets - offsets[0]
        first = np.zeros(len(pieces), bool)
        first[offsets[:-1]] = True
        index = pieces.indices.to_numpy().astype(np.int64)
        # The first chunk of a text has no space before it. Room for both kinds first: a lookup may start the memo anew.
        heads, head_index = np.unique(index[first], return_inverse=True)
        used = np.zeros(len(pieces.dictionary), bool)
        used[index[~first]] = True
        body = np.flatnonzero(used)
        if len(self.keys) + len(body) + len(heads) > self.limit:
            self.clear()
        of_word = np.zeros(len(used), np.int64)
        of_word[body] = self.codes(pieces.dictionary.take(pa.array(body)), " ")
        code = of_word[index]
        code[first] = self.codes(pieces.dictionary.take(pa.array(heads)))[head_index]
        counts = self.count[code]
        ids = gather(self.ids, self.start[code], counts)
        per_text = np.add.reduceat(counts, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)
        if not uneven.any():
            return ids, per_text
        ends = np.cumsum(per_text)
        out = []
        for row in range(len(texts)):
            if uneven[row]:
                machine, text = Transducer(self.merges), texts[row].as_py()
                found = np.array(machine.feed(text) + machine.finish(), np.int32)
                per_text[row] = len(found)
                out.append(found)
            else:
                out.append(ids[ends[row] - per_text[row] : ends[row]])
        return np.concatenate(out) if out else ids, per_text


@functools.lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(maxsize=2)
def batch_encoder(path: str) -> BatchEncoder:
    return BatchEncoder(load(path))


def encode_documents(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` columns with ``ids``, the token ids of the text."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(path)
        for batch in batches:
            for part in steps(batch, "__text"):
                ids, counts = encoder.encode(part.column("__text"))
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in fields] + [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))],
                    names=[f.name for f in fields] + ["ids"])

    return source.mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, *keep: str) -> DataFrame:
    """``keep`` columns with ``text``, decoded from the ``ids`` column."""
    source = encoded.select(*keep, F.col("ids").alias("__ids"))
    fields = [f for f in source.schema.fields if f.name != "__ids"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(path)
        for batch in batches:
            texts = []
            for ids in batch.column("__ids"):
                machine = TextMachine(merges)
                values = np.asarray(ids.values, np.int64) if ids.is_valid else np.zeros(0, np.int64)
                texts.append(machine.feed(values) + machine.finish())
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in fields] + [pa.array(texts, pa.string())],
                names=[f.name for f in fields] + ["text"])

    return source.mapInArrow(run, schema)


#: Ids that are decoded and hashed at once.
_DECODE_IDS = 1 << 16


def digests(docs: DataFrame, path: str, *keep: str, with_ids: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256, and ``ids`` if asked for: encoding and decoding in one pass."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = batch_encoder(path)
        for batch in batches:
            for part in steps(batch, "__text"):
                ids, counts = encoder.encode(part.column("__text"))
                written = ids.astype("<u4")
                id_hashes, text_hashes, at = [], [], 0
                for count in counts.tolist():
                    id_hashes.append(hashlib.sha256(written[at : at + count]).hexdigest())
                    machine, hashed = TextMachine(encoder.merges), hashlib.sha256()
                    for begin in range(at, at + count, _DECODE_IDS):
                        hashed.update(machine.feed(ids[begin : min(begin + _DECODE_IDS, at + count)]).encode())
                    hashed.update(machine.finish().encode())
                    text_hashes.append(hashed.hexdigest())
                    at += count
                columns = {f.name: part.column(f.name) for f in fields} | {
                    "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_hashes, pa.string()),
                    "decoded_sha256": pa.array(text_hashes, pa.string())}
                if with_ids:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                    columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return source.mapInArrow(run, schema)
