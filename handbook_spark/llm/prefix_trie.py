"""Trie of conversation prefixes from sorted conversations and range minima over their common prefix lengths.

Every conversation is a row of 16-byte turn hashes. Rows are range-sorted over the cluster; each row has the number of turns it
shares with the row before (its LCP). A prefix of ``d`` turns belongs to the rows around it as far as no LCP below ``d`` lies
between, and each candidate prefix finds its left and right end by a binary search of its own on a sparse table
of range minima. Nothing is carried from one prefix to the next, so there is no stack and all searches of a block run as arrays.

Tables are built per block of consecutive rows (``BLOCK_TURNS`` turns, or one longer conversation). A prefix inside a block is
complete there. Prefixes of a block's first or last row may go on in other blocks: each block gives one partial row for
them (counts, sums and minima all add up), and partial rows meet by the hash of the prefix. Sums over a subtree need no
tree walk: the words of a prefix's rows behind depth ``d`` are a difference of running sums, and so are the words
of the prefixes that first appear in an interval of rows.

Results for odd input: rows without conv_id take no part; a null role or text is empty; turns are ordered by their number,
null first, equal numbers by the hash of role and text; repeated rows are turns of their own; a conversation without turns after
rebuilding is a member of the root alone; negative conv_ids group like in SQL (the remainder has the sign of
the id); a conversation of any length is one row of 20 bytes a turn; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handbook_spark.session import materialize

#: Turns of a block, conversations counting as one more turn each.
BLOCK_TURNS = 1 << 17
#: Ids of one row that a prefix's end list is cut into where it goes on in other blocks.
END_IDS = 1024
#: Ways that the children of one prefix are dealt when they look up its smallest member.
SALTS = 32
WIDTH = 16
FAMILY = 20


def turn_hash(role: Column, text: Column) -> Column:
    """Hash of a turn; role and text cannot run into each other."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("int")


def rebuilt(turns: DataFrame, family: int = FAMILY, most: int = 4) -> DataFrame:
    """conv_id, seq (turn hashes one after the other), words (of each turn), of rebuilt conversations.

    Conversation c begins with the first h turns of conversation ``c - c % family``, h = crc32(c) % most, followed by its own turns
    behind its first h. Turns are packed before they move, and all conversations of a family lie together.
    """
    packed = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        (F.col("conv_id") - F.col("conv_id") % family).cast("long").alias("first_id"),
        F.struct(F.col("turn"), turn_hash(F.col("role"), F.col("text")).alias("hash"), word_count(F.col("text")).alias("words")).alias("t"))
    own = packed.repartition("first_id").groupBy("first_id", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    heads = own.filter("conv_id = first_id").select(F.col("first_id").alias("head_id"), F.slice("own", 1, most - 1).alias("head"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    whole = own.join(heads, F.col("first_id") == F.col("head_id"), "left").select("conv_id", F.concat(
        F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), shared),
        F.slice("own", shared + 1, F.greatest(F.size("own") - shared, F.lit(0)))).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: F.hex(t["hash"])), "")
    return whole.select("conv_id", F.unhex(joined).alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))


def common_turns(left: bytes | None, right: bytes) -> int:
    """Turns that two sequences share from their beginning; -1 where there is none to the left."""
    if left is None:
        return -1
    size = min(len(left), len(right))
    if left[:size] == right[:size]:
        return size // WIDTH
    a, b = np.frombuffer(left, np.uint8, size), np.frombuffer(right, np.uint8, size)
    return int(np.argmax(a != b)) // WIDTH


def sorted_rows(conversations: DataFrame) -> DataFrame:
    """Conversations in the order of their turn hashes, stored, with lcp (turns shared with the row before) and next_lcp.

    A row without neighbour has -1 there. Rows of a sorted slice are compared while it streams by; only each slice's first and last
    row are compared across slices, one row per slice.
    """
    placed = conversations.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").withColumn(
        "at", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row waits for the one after it
        shared: int | None = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            seqs = batch.column("seq").to_pylist()
            after = [common_turns(a, b) for a, b in zip(seqs, seqs[1:])]
            lcp = [shared, *after]
            if len(after):
                yield compared(batch.slice(0, batch.num_rows - 1), lcp[:-1], after, seqs if shared is None else [None])
            held, shared = batch.slice(batch.num_rows - 1), lcp[-1]
        if held is not None:
            yield compared(held, [shared], [None], held.column("seq").to_pylist())

    def compared(batch: pa.RecordBatch, lcp: list, after: list, seqs: list) -> pa.RecordBatch:
        edge = [None] * batch.num_rows
        if lcp[0] is None:
            edge[0] = seqs[0]
        if after[-1] is None:
            edge[-1] = seqs[-1]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(lcp, pa.int64()), pa.array(after, pa.int64()), pa.array(edge, pa.binary())],
            names=[*batch.schema.names, "lcp", "next_lcp", "edge"])

    rows = materialize(placed.mapInArrow(run, "conv_id long, seq binary, words array<int>, at long, lcp long, next_lcp long, edge binary"))
    slice_of = F.shiftright(F.col("at"), 33)
    edges = rows.filter("edge IS NOT NULL").groupBy(slice_of.alias("slice")).agg(
        F.min_by("edge", "at").alias("first"), F.max_by("edge", "at").alias("last"))
    order = Window.orderBy("slice")  # one row per slice

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column("before").to_pylist()
            first = batch.column("first").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("slice"), pa.array([common_turns(a, b) for a, b in zip(last, first)], pa.int64())], names=["slice", "shared"])

    shared = edges.withColumn("before", F.lag("last").over(order)).select("slice", "before", "first").mapInArrow(across, "slice long, shared long")
    bounds = shared.select(F.col("slice").alias("__slice"), "shared", F.coalesce(F.lead("shared").over(order), F.lit(-1)).alias("next_shared"))
    return rows.drop("edge").join(F.broadcast(bounds), slice_of == F.col("__slice")).select(
        "conv_id", "seq", "words", "at", F.coalesce("lcp", "shared").alias("lcp"), F.coalesce("next_lcp", "next_shared").alias("next_lcp"))


class RangeMinimum:
    """Sparse table: minima of all ranges whose size is a power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def minimum(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of each range ``first`` to ``last``, both included."""
        level = np.floor(np.log2(last - first + 1)).astype(np.int64)
        out = np.empty(len(first), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.rows[k][first[of]], self.rows[k][last[of] - (1 << int(k)) + 1])
        return out

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Last place up to which all values behind ``at`` reach ``least``: a binary search for each."""
        at, size = at.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            open_ = np.flatnonzero(at + (1 << k) < size)
            open_ = open_[self.rows[k][at[open_] + 1] >= least[open_]]
            at[open_] += 1 << k
        return at

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """First place from which all values behind it up to ``at`` reach ``least``: a binary search for each."""
        at = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            open_ = np.flatnonzero(at - (1 << k) >= 0)
            open_ = open_[self.rows[k][at[open_] - (1 << k) + 1] >= least[open_]]
            at[open_] -= 1 << k
        return at


#: Rows of ``block_rows``: complete prefixes, parts of prefixes that go on elsewhere, and parts of the latter's end lists.
WHOLE, PART, ENDS = 0, 1, 2
_ROWS = pa.schema([
    ("kind", pa.int32()), ("depth", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.binary())])
_ROWS_SQL = ("kind int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, n_convs long, n_children long,"
             " n_leaves long, saved_tokens long, ends binary")


def prefix_keys(seq: bytes) -> list[bytes]:
    """Hash of each prefix of a sequence, the empty one first."""
    chain, keys = hashlib.blake2b(digest_size=WIDTH), []
    keys.append(chain.copy().digest())
    for at in range(0, len(seq), WIDTH):
        chain.update(seq[at : at + WIDTH])
        keys.append(chain.copy().digest())
    return keys


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def block_rows(conv: np.ndarray, seqs: list[bytes], words: np.ndarray, lcp: np.ndarray, next_lcp: np.ndarray) -> pa.RecordBatch:
    """Prefixes of a block of consecutive sorted rows; ``words`` holds the words of all turns, row after row."""
    n = len(conv)
    size = np.fromiter((len(s) // WIDTH for s in seqs), np.int64, n)
    start = np.cumsum(size) - size
    told = _sums(words)
    total = told[start + size] - told[start]  # words of a row

    def spoken(row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of a row's first turns."""
        return told[start[row] + depth] - told[start[row]]

    # Inside the block the first row has no neighbour, so its prefixes begin there, the root included.
    local = lcp.copy()
    local[0] = -1
    table, ids = RangeMinimum(local), RangeMinimum(conv)
    made = size - local  # prefixes that begin at a row
    first = np.cumsum(made) - made
    row = np.repeat(np.arange(n), made)
    depth = np.arange(len(row)) - first[row] + local[row] + 1
    last = table.right(row, depth)
    left = table.left(row, depth)
    members = last - left + 1
    part_left = (left == 0) & (depth <= lcp[0])
    border = part_left | ((last == n - 1) & (depth <= next_lcp[-1]))

    # A row ends in a childless prefix if the row behind it does not go on with all of its turns.
    leaves = _sums(next_lcp < size)
    # Words of the prefixes that appear at a row for the first time anywhere.
    rows = np.arange(n)
    new = _sums(total - spoken(rows, np.maximum(lcp, 0)))
    spent = _sums(total)
    before = spoken(row, np.maximum(depth - 1, 0))
    begun = np.where(part_left, new[left + 1] - new[left], total[left] - before)
    saved = (spent[last + 1] - spent[left]) - members * before - (begun + new[last + 1] - new[left + 1])

    # A row's first new prefix is a child of the prefix it shares with the row before; the others are children of each other.
    opens = np.flatnonzero((size > lcp) & (lcp >= 0))
    above = table.left(opens, lcp[opens])
    children = np.where(part_left, 0, size[row] > depth).astype(np.int64)
    np.add.at(children, first[above] + lcp[opens] - local[above] - 1, 1)
    # Place of each prefix's parent in the block; a root has none.
    parent = np.arange(len(row)) - 1
    heads = first[local >= 0][made[local >= 0] > 0]
    top = row[heads]
    over = table.left(top, local[top])
    parent[heads] = first[over] + local[top] - local[over] - 1

    # Rows that end in a prefix follow each other, in the order of their ids.
    own_first = table.left(rows, size)
    ending = first[own_first] + size - local[own_first] - 1
    lists: dict[int, tuple[int, int]] = {}
    bounds = np.flatnonzero(np.diff(ending, prepend=-1))
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), n]):
        lists[int(ending[a])] = (a, b)
    texts = [b"%d" % c for c in conv.tolist()]
    smallest = ids.minimum(left, last)

    # Border prefixes are those of the first row and of the last one.
    keys: dict[int, bytes] = {}
    for of in {0, n - 1}:
        chain = prefix_keys(seqs[of])
        deep = np.arange(size[of] + 1)
        begins = table.left(np.full(len(deep), of), deep)
        for place, key in zip((first[begins] + deep - local[begins] - 1).tolist(), chain):
            keys[place] = key
    edge = np.flatnonzero(border).tolist()
    key = [None] * len(row)
    for place in edge:
        key[place] = keys[place]
    parent_key: list[bytes | None] = [None] * len(row)
    parent_conv: list[int | None] = smallest[parent].tolist()
    for place in np.flatnonzero((parent < 0) | border[parent]).tolist():
        parent_conv[place] = None
        if parent[place] >= 0:
            parent_key[place] = key[parent[place]]
    ends: list[bytes | None] = [None] * len(row)
    extra: list[tuple[bytes, int, int, bytes]] = []
    for place, (a, b) in lists.items():
        if not border[place]:
            ends[place] = hashlib.sha256(b",".join(texts[a:b])).digest()
        else:
            for at in range(a, b, END_IDS):
                extra.append((keys[place], int(depth[place]), int(conv[at]), b",".join(texts[at : min(at + END_IDS, b)])))
    more = len(extra)
    nothing = [None] * more
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((border.astype(np.int32), np.full(more, ENDS, np.int32)))),
        pa.array(np.concatenate((depth, np.array([e[1] for e in extra], np.int64)))),
        pa.array(key + [e[0] for e in extra], pa.binary()), pa.array(parent_key + nothing, pa.binary()),
        pa.array(np.concatenate((smallest, np.array([e[2] for e in extra], np.int64)))),
        pa.array(parent_conv + nothing, pa.int64()),
        *[pa.array(np.concatenate((x, np.zeros(more, np.int64)))) for x in (members, children, leaves[last + 1] - leaves[left], saved)],
        pa.array(ends + [e[3] for e in extra], pa.binary())], schema=_ROWS)


def blocks(rows: DataFrame, turns: int = BLOCK_TURNS) -> DataFrame:
    """Prefix rows of blocks of consecutive ``sorted_rows``; a block ends where the order has a gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        room, expected = turns, None
        for batch in batches:
            at = batch.column("at").to_numpy()
            cost = np.diff(batch.column("words").offsets.to_numpy()) + 1
            begin = 0
            for place in range(batch.num_rows):
                if (held or place > begin) and (room <= 0 or at[place] != expected):
                    held.append(batch.slice(begin, place - begin))
                    yield built(held)
                    held, begin, room = [], place, turns
                room -= int(cost[place])
                expected = at[place] + 1
            held.append(batch.slice(begin))
        if held:
            yield built(held)

    def built(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        words = whole.column("words").flatten().to_numpy().astype(np.int64)
        return block_rows(whole.column("conv_id").to_numpy(), whole.column("seq").to_pylist(), words,
                          whole.column("lcp").to_numpy(), whole.column("next_lcp").to_numpy())

    return rows.mapInArrow(run, _ROWS_SQL)


def end_hashes(parts: DataFrame) -> DataFrame:
    """key, depth, ends: the hash of each border prefix's end list, fed part by part in the order of ids."""
    dealt = parts.repartition("key").sortWithinPartitions("key", "depth", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashed = None, None
        done: list[tuple] = []
        for batch in batches:
            for key, depth, text in zip(*[batch.column(c).to_pylist() for c in ("key", "depth", "ends")]):
                if (key, depth) == current:
                    hashed.update(b"," + text)
                    continue
                if current:
                    done.append((*current, hashed.digest()))
                current, hashed = (key, depth), hashlib.sha256(text)
            yield written(done)
            done = []
        if current:
            yield written([(*current, hashed.digest())])

    def written(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64()),
            pa.array([d[2] for d in done], pa.binary())], names=["end_key", "end_depth", "ends"])

    return dealt.select("key", "depth", "conv_id", "ends").mapInArrow(run, "end_key binary, end_depth long, ends binary")


def trie(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Every distinct prefix of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    found = materialize(blocks(sorted_rows(rebuilt(turns)), block_turns))
    whole = found.filter(F.col("kind") == WHOLE).drop("kind", "key")
    parts = found.filter(F.col("kind") == PART)
    # A prefix in many blocks has one row per block; equal keys meet in partial sums first.
    merged = parts.groupBy("key", "depth").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    ends = end_hashes(found.filter(F.col("kind") == ENDS))
    merged = materialize(merged.join(ends, (F.col("key") == F.col("end_key")) & (F.col("depth") == F.col("end_depth")), "left").drop(
        "end_key", "end_depth"))
    named = whole.filter("parent_key IS NULL")
    # Children of prefixes that go on in other blocks; the root alone may have very many, so they are dealt over salts.
    rows = whole.filter("parent_key IS NOT NULL").unionByName(merged.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long")))
    salted = rows.withColumn("salt", F.pmod(F.hash("conv_id", "depth"), F.lit(SALTS)))
    above = merged.select(F.col("key").alias("above_key"), F.col("conv_id").alias("above_conv_id"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("above_salt"))
    linked = salted.join(above, (F.col("parent_key") == F.col("above_key")) & (F.col("salt") == F.col("above_salt")), "left").withColumn(
        "parent_conv_id", F.col("above_conv_id")).select(*named.columns)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return named.unionByName(linked).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce(F.lower(F.hex("ends")), nothing).alias("ends_sha256"))
