"""Fill-in-the-middle transformation with a Roaring-style set of line boundaries.

A text's cut offsets are the places before, between and behind its lines (``[^\\n]*\\n|[^\\n]+``), in code points. They
are held as a set that is split by the upper bits of a value; each container keeps the lower 16 bits as a sorted
array, as a bitmap or as runs, whichever is smallest. Cumulative cardinalities lead from the number of a cut to its
container, and a select inside the container gives the offset; no container is unpacked for it.

Two hashes of the document's id choose the cuts, a third one whether the text is transformed, a fourth one the order
of the parts. Sentinels are plain strings, so texts that hold one stay as they are.

Results for odd input: a null text counts as an empty one, which has no line and stays plain; a null doc_id is hashed as an
empty one; a text without newline is one line, so each part is all or nothing; a text of any length is cut
over its whole length; repeated rows are transformed one by one, in the same way; extra columns are passed on if they
are named in ``keep`` and ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm.words import steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Values of a container, and the most that an array holds before a bitmap is smaller.
SPAN, ARRAY_MOST = 1 << 16, 4096


class ArrayContainer:
    """Up to 4 096 sorted values."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """65 536 bits as 64-bit words with the number of values before each word."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        word = int(self.words[at])
        for _ in range(k - int(self.before[at])):
            word &= word - 1  # drops the lowest value of the word
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    """Runs of consecutive values with the number of values before each run."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.cumsum(sizes) - sizes

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[at]) + k - int(self.before[at])


def container(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of different sorted values below 65 536: 2 bytes a value, 8 KB, or 4 bytes a run and 2 more."""
    opens = np.flatnonzero(np.diff(values, prepend=-2) != 1)
    if 4 * len(opens) + 2 < min(2 * len(values), SPAN // 8):
        return RunContainer(values[opens], np.diff(opens, append=len(values)))
    return ArrayContainer(values) if len(values) <= ARRAY_MOST else BitmapContainer(values)


class BoundarySet:
    """Sorted different offsets of any size, by containers with cumulative cardinalities."""

    def __init__(self, offsets: np.ndarray):
        keys = offsets >> 16
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys = keys[starts]
        self.before = np.concatenate((starts, [len(offsets)]))
        self.containers = [container(part & 0xFFFF) for part in np.split(offsets, starts[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The offset with ``k`` smaller ones."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << 16) + self.containers[at].select(k - int(self.before[at]))


def boundaries(texts: pa.Array) -> Iterator[np.ndarray]:
    """Cut offsets of each text in code points, its beginning first; a null text is an empty one."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # Code points before each byte, and before the first byte behind the data.
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    ends = np.flatnonzero(data == 10) + 1
    bounds = np.searchsorted(ends, offsets, "right")
    for row in range(len(texts)):
        first, last = offsets[row], offsets[row + 1]
        cuts = ends[bounds[row] : bounds[row + 1]]
        if last > first and (not len(cuts) or cuts[-1] != last):
            cuts = np.append(cuts, last)
        yield np.concatenate(([0], points[cuts] - points[first]))


def arranged(text: str, form: str, first: int, second: int) -> str:
    """The text with its parts marked and put into the order of ``form``."""
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def choice(doc_id: str, seed: int, group: int) -> Column:
    """The 8-digit group number ``group`` (from 0) of the hash of ``seed:doc_id``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, *keep: str, doc_id: str = "doc_id", text: str = "text", seed: int = 7, percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """``keep`` columns with n, form, prefix_chars, middle_chars and output.

    ``percent`` of the documents are transformed, ``spm_percent`` of those with the suffix first. ``n`` is the number of lines;
    the lengths are code points, null for a plain text, whose output is the text itself.
    """
    source = docs.select(*keep, F.col(text).alias("__text"), *[choice(doc_id, seed, g).alias(f"__h{g}") for g in range(4)])
    fields = source.schema.fields[:-5]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [
        "n long", "form string", "prefix_chars long", "middle_chars long", "output string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "__text"):
                chosen = zip(part.column("__text"), *[part.column(f"__h{g}").to_pylist() for g in range(4)])
                numbers, forms, prefixes, middles, outputs = [], [], [], [], []
                for offsets, (value, h1, h2, h3, h4) in zip(boundaries(part.column("__text")), chosen):
                    whole = value.as_py() or ""
                    numbers.append(len(offsets) - 1)
                    if not whole or h3 % 100 >= percent or any(mark in whole for mark in (PREFIX, SUFFIX, MIDDLE)):
                        forms.append("plain")
                        prefixes.append(None)
                        middles.append(None)
                        outputs.append(whole)
                        continue
                    cuts = BoundarySet(offsets)
                    first, second = sorted((h1 % len(cuts), h2 % len(cuts)))
                    first, second = cuts.select(first), cuts.select(second)
                    forms.append("spm" if h4 % 100 < spm_percent else "psm")
                    prefixes.append(first)
                    middles.append(second - first)
                    outputs.append(arranged(whole, forms[-1], first, second))
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in fields]
                    + [pa.array(numbers, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                       pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                    names=[f.name for f in fields] + ["n", "form", "prefix_chars", "middle_chars", "output"])

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of an output, from output and form alone.

    No part holds a sentinel, and a sentinel's first character occurs in none behind it, so the first match is the mark.
    """
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    inner, outer = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(len(PREFIX) + 1)
    at = F.position(inner, rest)
    one = F.substr(rest, outer, at - outer)
    two = F.substr(rest, at + F.lit(len(PREFIX)))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
