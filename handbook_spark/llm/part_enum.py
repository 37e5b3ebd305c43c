"""Near copies by the Jaccard similarity of word n-grams, joined on PartEnum signatures.

Two sets with |r n s| / |r u s| >= p / q differ in at most (q - p) / (q + p) * (|r| + |s|) elements. Sets are banded by size, each
band 4/3 as wide as the one before (for 3/4), so similar sets lie in the same or in neighbouring bands; a set takes part
in its own band's scheme and in the next one's. A scheme with at most k differing elements deals the
feature domain into n parts; the part of an element is fixed by its hash. At least n - k parts then hold no
difference, and the parts' contents, hashed with scheme and part number, are the signatures: similar sets share
n - k of them or more. (Second-level subsets of size one are the cheapest choice at this threshold.)

Work is bounded as follows; none of it drops a link.

* Copies (equal sets) are one class with one representative.
* A set with a partner has at most a quarter of its elements to itself. Elements are first counted across all sets, hashed
  and packed, half of the domain in the first round and all of it among what is left in the second; other sets
  leave.
* n is larger than k + 1, so a set may ignore n - k - 1 of its signatures, less its empty parts. It ignores those of
  the largest groups (such as the parts of a common passage), in one order for all sets: of the signatures that two
  similar sets share, the one of the smallest group has so many above it that neither set ignores it. A set that fills
  fewer than k + 1 parts ignores none of these: a partner that fills more of them shares one of them at least. Its empty parts are
  signatures of a kind of their own, by which it meets other such sets, and of which it may ignore n - k - 1.
* In each group all sets are compared with its smallest one. Only sets that this leaves in different components are
  compared with each other: pair by pair in groups of up to ``FEW`` members, and in tiles for larger ones. Large groups that overlap
  form a cluster, a cluster's sets are dealt out in blocks, and a tile counts the common elements of two
  blocks as matrix products. Only similar pairs leave a tile.

Results for odd input: null and empty texts have no n-grams and link with nothing; a text with fewer than n words is one
n-gram; equal rows are copies; a null doc_id links with nothing and is its own (null) component; rows that share
a doc_id are one node; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handbook_spark.llm.components import components, dealt_join
from handbook_spark.llm.packing import packed, step_key
from handbook_spark.llm.words import gather, hashes, lowered, mixed, split, steps
from handbook_spark.session import materialize

SIZE = 5
#: Similarity p / q.
ABOVE, BELOW = 75, 100
#: Parts of a scheme for each difference it allows.
SPARE = 2.0
#: Members of a group that are compared pair by pair.
FEW = 8
#: Tasks that the rows of one class are dealt to when they get its smallest id.
SALTS = 16
#: Sets and elements of a block at most, on average.
BLOCK_SETS, BLOCK_ELEMENTS = 512, 1 << 18

_FOLD = np.uint64(0xD6E8FEB86659FD93)


def shingles(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different n-gram hashes of each text, one text after the other, and their numbers."""
    offsets, words = split(lowered(texts))
    of_word = hashes(words.dictionary)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    total = len(of_word)
    grams = np.full(max(total - size + 1, 0), size, np.uint64)
    for k in range(size):
        grams = grams * _FOLD + of_word[k : k + len(grams)]
    grams = mixed(grams)
    counts = np.zeros(len(texts), np.int64)
    out: list[np.ndarray] = []
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if end - begin >= size:
            found = np.unique(grams[begin : end - size + 1])
        elif end > begin:
            value = np.full(1, end - begin, np.uint64)
            for word in of_word[begin:end]:
                value = value * _FOLD + word
            found = mixed(value)
        else:
            continue
        counts[row] = len(found)
        out.append(found)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of each row's values (wrapping)."""
    ends = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    at = np.concatenate(([0], np.cumsum(counts)))
    return ends[at[1:]] - ends[at[:-1]]


_COUNTED = "bucket int, step long, rows int, keys binary, places binary"


def _elements(grams: np.ndarray, counts: np.ndarray, step: int, share: int, number: int) -> pa.RecordBatch:
    """The elements of a step for counting: 32 hash bits of one in ``share`` elements, packed by bucket."""
    rows = np.repeat(np.arange(len(counts)), counts)
    used = grams % np.uint64(share) == 0
    grams, rows = grams[used], rows[used]
    buckets = ((grams >> np.uint64(33)) % np.uint64(number)).astype(np.int64)
    keys = ((grams >> np.uint64(1)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    found = list(packed(buckets, number, keys, rows.astype(np.uint16)))
    return pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], pa.int32()), pa.array([step] * len(found), pa.int64()),
         pa.array([len(counts)] * len(found), pa.int32()), pa.array([f[1] for f in found], pa.binary()),
         pa.array([f[2] for f in found], pa.binary())], names=["bucket", "step", "rows", "keys", "places"])


def _shared(elements: DataFrame) -> DataFrame:
    """step, place, shared: how many counted elements of each row some other row has, too."""
    def count(bucket: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k.as_py(), np.uint32) for k in bucket["keys"]]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint32)
        order = np.argsort(flat, kind="stable")
        sorted_keys = flat[order]
        same = np.zeros(len(flat), bool)
        if len(flat) > 1:
            equal = sorted_keys[1:] == sorted_keys[:-1]
            same[order[1:][equal]] = True
            same[order[:-1][equal]] = True
        out, at = [], 0
        for key, places, rows in zip(keys, bucket["places"], bucket["rows"]):
            place = np.frombuffer(places.as_py(), np.uint16)
            out.append(np.bincount(place[same[at : at + len(key)]], minlength=rows.as_py()).astype(np.uint32).tobytes())
            at += len(key)
        return pa.table({"step": bucket["step"], "counts": pa.array(out, pa.binary())})

    def add(step: pa.Table) -> pa.Table:
        total = np.zeros(len(step["counts"][0].as_py()) // 4, np.int64)
        for counts in step["counts"]:
            total += np.frombuffer(counts.as_py(), np.uint32)
        return pa.table({"step": pa.repeat(step["step"][0], len(total)), "place": pa.array(np.arange(len(total)), pa.int32()),
                         "shared": pa.array(total, pa.int64())})

    counted = elements.groupBy("bucket").applyInArrow(count, "step long, counts binary")
    return counted.groupBy("step").applyInArrow(add, "step long, place int, shared long")


def _survivors(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Rows whose elements could have a partner: at most (q - p) / q of all are known to be theirs alone."""
    return rows.join(_shared(elements), ["step", "place"]).filter(
        (F.col("counted") - F.col("shared")) * BELOW <= F.col("n") * (BELOW - ABOVE))


def bands(limit: int) -> np.ndarray:
    """First size of each band, up to one beyond ``limit``."""
    starts = [1]
    while starts[-1] <= limit:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * BELOW // ABOVE)))
    return np.array(starts + [-(-starts[-1] * BELOW // ABOVE) + 1], np.int64)


def scheme(band: int, starts: np.ndarray) -> tuple[int, int]:
    """Differences k that a band's scheme allows, and its number of parts."""
    largest = int(starts[band + 1]) - 1
    k = 2 * largest * (BELOW - ABOVE) // (BELOW + ABOVE)
    return k, int(SPARE * (k + 1)) + 1


def signatures(grams: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(scheme, spare, signatures) of one sorted set in its own and the next band's scheme.

    ``spare`` is how many of the signatures may be ignored. Empty parts give no signature unless they are
    more than may be ignored; then they are listed by themselves, under the complement of the scheme's number, and all
    other signatures are kept (``spare`` is -1).
    """
    own = int(np.searchsorted(starts, len(grams), "right")) - 1
    for band in (own, own + 1):
        k, parts = scheme(band, starts)
        part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        content = np.add.reduceat(mixed(grams + np.uint64(1)), first)
        number = part[first]
        spare = parts - k - 1 - (parts - len(first))
        named = mixed(content * _FOLD + number * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
        yield band, max(spare, -1), named
        if spare < 0:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), number)
            yield ~band, parts - k - 1, mixed(empty * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))


def classes(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(rows, sets): all documents with their class, and the sets of the classes that may have a partner.

    ``rows`` has doc_id, n and rep (smallest doc_id with the same set, null without n-grams); ``sets`` has doc_id, n, grams.
    """
    spark = docs.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    head = f"doc_id {id_type}, n long, f1 long, f2 long, counted long, step long, place int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = 0
        for batch in batches:
            for part in steps(batch):
                grams, counts = shingles(part.column("text"), size)
                step = step_key(counter)
                counter += 1
                prints = [per_row(mixed(grams * _FOLD + np.uint64(salt)), counts).view(np.int64) for salt in (1, 2)]
                counted = per_row((grams % np.uint64(2) == 0).astype(np.int64), counts)
                found = _elements(grams, counts, step, 2, number)
                numbers = {"n": counts, "f1": prints[0], "f2": prints[1], "counted": counted}
                yield _joined({"doc_id": part.column("doc_id")} | {k: pa.array(v) for k, v in numbers.items()}, step, found)

    both = materialize(docs.select("doc_id", "text").mapInArrow(read, f"{head}, packed array<struct<{_struct(_COUNTED)}>>"))
    rows = both.drop("packed")
    # Copies count as partners here, so all copies of a set stay or leave together.
    left = _survivors(rows.filter("n > 0 AND doc_id IS NOT NULL"), both.select(F.inline("packed")))
    # Only sets that several documents have; all other documents stand for themselves.
    reps = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    left = materialize(left.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    texts = docs.select("doc_id", "text").join(left.hint("shuffle_hash"), "doc_id", "left_semi")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = 0
        for batch in batches:
            for part in steps(batch):
                grams, counts = shingles(part.column("text"), size)
                step = step_key(counter)
                counter += 1
                found = _elements(grams, counts, step, 1, number)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                sets = pa.ListArray.from_arrays(offsets, pa.array(grams.view(np.int64)))
                yield _joined({"doc_id": part.column("doc_id"), "n": pa.array(counts), "grams": sets}, step, found)

    few = materialize(texts.mapInArrow(
        again, f"doc_id {id_type}, n long, grams array<long>, step long, place int, packed array<struct<{_struct(_COUNTED)}>>"))
    kept = _survivors(few.select("doc_id", "n", F.col("n").alias("counted"), "step", "place").filter("n > 0"),
                      few.select(F.inline("packed"))).select("step", "place")
    sets = few.select("doc_id", "n", "grams", "step", "place").join(kept, ["step", "place"]).select("doc_id", "n", "grams")
    rep = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    named = _with(rows.select("doc_id", "n", "f1", "f2"), reps, ["n", "f1", "f2"]).select("doc_id", "n", rep.alias("rep"))
    return named, materialize(sets)


def _with(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Left join with one row per key on the right; a key that very many rows have is dealt to ``SALTS`` tasks.

    Always a shuffled join: the optimizer's estimate of the right side does not see that salting multiplies it.
    """
    salted = few.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in few.columns if c not in on],
                        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("__salt"))
    same = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) == F.col("__salt")
    for c in on:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return rows.join(salted.hint("merge"), same, "left").drop("__salt", *[f"__{c}" for c in on])


def _struct(schema: str) -> str:
    return ", ".join(": ".join(field.split(" ")) for field in schema.split(", "))


def _joined(columns: dict[str, pa.Array], step: int, packed: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of a step with its packed elements in the first row."""
    rows = len(columns["doc_id"])
    table = pa.StructArray.from_arrays(packed.columns, names=packed.schema.names)
    offsets = np.full(rows + 1, len(table), np.int32)
    offsets[0] = 0
    return pa.RecordBatch.from_pydict(columns | {
        "step": pa.array([step] * rows, pa.int64()), "place": pa.array(np.arange(rows), pa.int32()),
        "packed": pa.ListArray.from_arrays(pa.array(offsets), table)})


def groups(sets: DataFrame) -> DataFrame:
    """Members of the groups that share a signature: gid, doc_id, members, scheme, spare, times.

    Groups with the same members are one; ``times`` is the number of signatures they stand for.
    """
    number = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = sets.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = bands(64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                signs, places, rows, schemes, spares = [], [], [], [], []
                for row, cell in enumerate(part.column("grams")):
                    grams = cell.values.to_numpy().view(np.uint64)
                    if len(grams) >= starts[-3]:
                        starts = bands(2 * len(grams))
                    for band, spare, found in signatures(grams, starts):
                        signs.append(found)
                        places.append(np.full(len(found), len(rows)))
                        rows.append(row)
                        schemes.append(band)
                        spares.append(spare)
                if not signs:
                    continue
                flat = np.concatenate(signs)
                buckets = ((flat >> np.uint64(40)) % np.uint64(number)).astype(np.int64)
                for bucket, values, where in packed(buckets, number, flat, np.concatenate(places).astype(np.uint16)):
                    used, inverse = np.unique(np.frombuffer(where, np.uint16), return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket], pa.int32()),
                         pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), part.column("doc_id").take(pa.array(np.array(rows)[used]))),
                         pa.array([np.array(schemes)[used].tolist()], pa.list_(pa.int32())),
                         pa.array([np.array(spares)[used].tolist()], pa.list_(pa.int32())),
                         pa.array([values], pa.binary()), pa.array([inverse.astype(np.uint16).tobytes()], pa.binary())],
                        names=["bucket", "doc_ids", "schemes", "spares", "signs", "places"])

    def meet(bucket: pa.Table) -> pa.Table:
        docs, schemes, spares, signs, owners, base = [], [], [], [], [], 0
        for doc_ids, scheme_row, spare_row, values, places in zip(*(bucket[c] for c in ("doc_ids", "schemes", "spares", "signs", "places"))):
            docs.append(doc_ids.values)
            schemes.append(scheme_row.values.to_numpy())
            spares.append(spare_row.values.to_numpy())
            signs.append(np.frombuffer(values.as_py(), np.uint64))
            owners.append(np.frombuffer(places.as_py(), np.uint16).astype(np.int64) + base)
            base += len(doc_ids.values)
        doc = pa.concat_arrays(docs)
        names = hashes(doc.cast(pa.string()).fill_null(""))
        scheme_of, spare_of = np.concatenate(schemes), np.concatenate(spares)
        sign, owner = np.concatenate(signs), np.concatenate(owners)
        order = np.lexsort((names[owner], sign))
        sign, owner = sign[order], owner[order]
        begin = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
        size = np.diff(np.append(begin, len(sign)))
        begin, size = begin[size > 1], size[size > 1]
        # Groups with the same members in the same scheme become one.
        key = mixed(per_row(mixed(gather(names[owner], begin, size)), size) + scheme_of[owner[begin]].astype(np.uint64)) \
            if len(begin) else np.zeros(0, np.uint64)
        gid, first, times = np.unique(key, return_index=True, return_counts=True)
        begin, size = begin[first], size[first]
        member = gather(owner, begin, size)
        return pa.table({
            "gid": pa.array(np.repeat(gid, size).view(np.int64)), "doc_id": doc.take(pa.array(member)),
            "members": pa.array(np.repeat(size, size), pa.int64()), "scheme": pa.array(scheme_of[member], pa.int32()),
            "spare": pa.array(spare_of[member], pa.int32()), "times": pa.array(np.repeat(times, size), pa.int64())})

    signed = sets.select("doc_id", "grams").mapInArrow(
        sign, f"bucket int, doc_ids array<{id_type}>, schemes array<int>, spares array<int>, signs binary, places binary")
    met = signed.groupBy("bucket").applyInArrow(
        meet, f"gid long, doc_id {id_type}, members long, scheme int, spare int, times long")
    return met.groupBy("gid", "doc_id", "members", "scheme", "spare").agg(F.sum("times").alias("times"))


def candidate_groups(members: DataFrame) -> DataFrame:
    """gid, doc_id without the memberships in the largest groups, as far as each set may ignore them."""
    order = Window.partitionBy("doc_id", "scheme").orderBy(F.col("members").desc(), "gid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return members.withColumn("upto", F.sum("times").over(order)).filter(F.col("upto") > F.col("spare")).select("gid", "doc_id")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are similar."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    sizes = sets.select("doc_id", "n")
    possible = (
        pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("sa")), "a")
        .join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("sb")), "b")
        .filter(F.least("sa", "sb") * BELOW >= F.greatest("sa", "sb") * ABOVE).select("a", "b"))
    both = possible.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("ga", "gb")))
    return both.filter(F.col("same") * BELOW >= (F.col("na") + F.col("nb") - F.col("same")) * ABOVE).select("a", "b")


def similar_classes(sets: DataFrame) -> DataFrame:
    """node, label of the representatives that are linked with others: label is the smallest of their component."""
    members = materialize(candidate_groups(materialize(groups(sets))))
    centres = members.groupBy("gid").agg(F.min("doc_id").alias("a"), F.count("*").alias("size")).filter("size > 1")
    stars = members.withColumnRenamed("doc_id", "b").join(centres, "gid").filter("a <> b").select("a", "b").distinct()
    links = materialize(verified(stars, sets))
    labels = components(links)
    # What is left: pairs of one group in different components.
    labelled = materialize(members.join(labels, members["doc_id"] == labels["node"], "left").select(
        "gid", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    open_groups = labelled.groupBy("gid").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.min("doc_id").alias("centre")).filter(
        "low <> high").select("gid", "size", "centre")
    open_rows = materialize(labelled.join(open_groups, "gid"))
    few = open_rows.filter(F.col("size") <= FEW)
    x = few.select("gid", F.col("doc_id").alias("a"), F.col("label").alias("la"))
    y = few.select("gid", F.col("doc_id").alias("b"), F.col("label").alias("lb"))
    rest = x.join(y, "gid").filter("a < b AND la <> lb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    more = materialize(verified(rest, sets).union(in_tiles(open_rows.filter(F.col("size") > FEW), sets)))
    return components(links.union(more))


def in_tiles(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs (a, b) with different labels among overlapping groups of ``rows`` (gid, doc_id, label, centre)."""
    clusters = components(rows.select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct())
    docs = rows.select("doc_id", "label").distinct().join(clusters.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster")), "doc_id")
    docs = materialize(docs.join(sets.select("doc_id", "n", "grams"), "doc_id"))
    sizes = docs.groupBy("cluster").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ELEMENTS)).alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    dealt = dealt_join(docs, "cluster", "doc_id", sizes.withColumnRenamed("cluster", "of"), "of").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).alias("second"), "doc_id", "label", "grams")
    id_type = sets.schema["doc_id"].dataType.simpleString()

    def tile(part: pa.Table) -> pa.Table:
        second = part["second"].to_numpy(zero_copy_only=False)
        low, high = part["low"][0].as_py(), part["high"][0].as_py()
        left = np.flatnonzero(~second)
        right = left if low == high else np.flatnonzero(second)
        doc = part["doc_id"].combine_chunks()
        label = np.unique(part["label"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        cells = [c.values.to_numpy() for c in part["grams"]]
        size = np.array([len(c) for c in cells], np.int64)
        same = common([cells[i] for i in left], [cells[i] for i in right])
        union = size[left][:, None] + size[right][None] - same
        a, b = np.nonzero((same * BELOW >= union * ABOVE) & (label[left][:, None] != label[right][None]))
        return pa.table({"a": doc.take(pa.array(left[a])), "b": doc.take(pa.array(right[b]))})

    return dealt.groupBy("cluster", "low", "high").applyInArrow(tile, f"a {id_type}, b {id_type}")


def common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Number of common elements of each set of ``left`` with each of ``right``.

    Elements that several sets of both sides have are columns of two matrices, multiplied some at a time; of elements that few
    have, the pairs are counted one by one.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return out
    values, index = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    cut = int(sizes[0].sum())
    sides = []
    for element, size in ((index[:cut], sizes[0]), (index[cut:], sizes[1])):
        order = np.argsort(element, kind="stable")
        row = np.repeat(np.arange(len(size)), size)[order]
        sides.append((row, np.searchsorted(element[order], np.arange(len(values) + 1))))
    counts = [np.diff(bounds) for _, bounds in sides]
    pairs = counts[0] * counts[1]
    few = np.flatnonzero((pairs > 0) & (pairs <= 256))
    for at in np.split(few, np.searchsorted(np.cumsum(pairs[few]), np.arange(1 << 19, int(pairs[few].sum()), 1 << 19))):
        # Each pair of an element: its left row repeated for all of its right rows.
        n = pairs[at]
        turn = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(counts[1][at], n)
        a = sides[0][0][np.repeat(sides[0][1][at], n) + turn // wide] if len(wide) else turn
        b = sides[1][0][np.repeat(sides[1][1][at], n) + turn % wide] if len(wide) else turn
        np.add.at(out.reshape(-1), a * len(right) + b, 1)
    many = np.flatnonzero(pairs > 256)
    for at in range(0, len(many), columns):
        part = many[at : at + columns]
        tables = []
        for (row, bounds), size in zip(sides, sizes):
            n = (bounds[part + 1] - bounds[part])
            table = np.zeros((len(size), len(part)), np.float32)
            table[gather(row, bounds[part], n), np.repeat(np.arange(len(part)), n)] = 1
            tables.append(table)
        out += np.rint(tables[0] @ tables[1].T).astype(np.int64)
    return out


def near_copies(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows, sets = classes(docs, size)
    labels = similar_classes(sets)
    return _with(rows, labels.withColumnRenamed("node", "rep"), ["rep"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep", "doc_id").alias("component_id"))
