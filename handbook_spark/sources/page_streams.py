"""Scanner of page content streams: each stream is read once, from left to right, into a row of columnar arrays.

A stream is a list of operator lines. The scanner keeps the texts that are shown, with place, font and colour state, and the lines at
which fonts, boxes, blocks and exam lists change; the readers of ``operators.pages`` work on these alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# Fixed forms of the stream lines.
_SHOWN = r"^(?P<lead>.*?)(?:1 0 0 -1 (?P<x>\d+(?:\.\d+)?) (?P<y>\d+(?:\.\d+)?)|) Tm(?P<gap>\s?)\[\((?P<rest>.*)$"
_HEADER = r"^Modul (?P<code>[A-ZÄÖÜ]{2,}-\d{3,})"
_GRAY, _BLACK = r"^\d+(?:\.\d+)? g", "0 0 1 rg"
#: Words whose lines are kept, shown or not.
KEYWORDS = ("Inhaltsverzeichnis", "Modulhandbuch")

#: Columns of a scanned page. Numbers of lines and characters count from the beginning of the stream.
FRAGMENT = ("line int, at int, x double, y double, leads boolean, shown boolean, text string, code string, font string, fresh boolean,"
            " gray_line int")
PAGE = f"code string, footer string, fragments array<struct<{FRAGMENT.replace(' ', ':').replace(',:', ', ')}>>, " \
       "fonts array<struct<line:int, at:int, font:string>>, boxes array<struct<line:int, at:int>>, blocks array<int>, rules array<int>, " \
       "marks array<struct<line:int, word:string>>"


def _bools(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, False).to_numpy(zero_copy_only=False).astype(bool)


def _strings(values: pa.Array, places: np.ndarray) -> pa.Array:
    """Values at ``places``, null where the place is negative."""
    return values.take(pa.array(places, pa.int64(), mask=places < 0)).cast(pa.string())


def scan(streams: pa.Array) -> list[pa.Array]:
    """The ``PAGE`` columns of an array of streams; a null stream is an empty one."""
    streams = pc.fill_null(streams.cast(pa.large_string()), "")
    if _bools(pc.match_substring_regex(streams, r"\)\] TJ[^\n]")).any():  # one shown text a line
        streams = pc.replace_substring_regex(streams, r"(\)\] TJ)([^\n])", "\\1\n\\2")
    lists = pc.split_pattern(streams, "\n")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    lines = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    n, first, last = len(lines), bounds[:-1], bounds[1:]
    page = np.repeat(np.arange(len(streams)), np.diff(bounds))
    number = np.arange(n) - first[page]
    sizes = pc.utf8_length(lines).to_numpy() + 1
    begun = np.cumsum(sizes) - sizes
    offset = begun - begun[first[page]]

    def following(hits: np.ndarray, steps: int) -> np.ndarray:
        """Whether the line ``steps`` further on in the same page is a hit."""
        out = np.zeros(n, bool)
        if steps < n:
            out[: n - steps] = hits[steps:] & (page[steps:] == page[: n - steps])
        return out

    def latest(hits: np.ndarray) -> np.ndarray:
        """The last hit up to each line, -1 if the page has none before."""
        found = np.maximum.accumulate(np.where(hits, np.arange(n), -1)) if n else np.zeros(0, np.int64)
        return np.where(found >= first[page], found, -1)

    is_font = _bools(pc.match_substring(lines, " Tf"))
    gray = _bools(pc.match_substring_regex(lines, _GRAY))
    color = gray | _bools(pc.starts_with(lines, _BLACK))
    boxes = _bools(pc.starts_with(lines, "ET"))
    ends, bars = _bools(pc.equal(lines, "ET")), _bools(pc.equal(lines, "Q"))
    blocks = ends & following(_bools(pc.starts_with(lines, "Q")), 1)
    any_line = np.ones(n, bool)
    rules = bars & following(bars, 1) & following(any_line, 2)

    at = np.flatnonzero(_bools(pc.match_substring(lines, "[(")))
    parsed = pc.extract_regex(lines.take(pa.array(at)), _SHOWN)
    hit = parsed.is_valid().to_numpy(zero_copy_only=False)
    at, parsed = at[hit], parsed.filter(pa.array(hit))
    lead, x, y, gap, rest = (parsed.field(k) for k in range(5))
    closed = pc.split_pattern(rest, ")] TJ", max_splits=1)
    is_closed = pc.list_value_length(closed).to_numpy() == 2
    opened = pc.split_pattern(rest, ")", max_splits=1)
    text = pc.if_else(pa.array(is_closed), pc.list_element(closed, 0), pc.list_element(opened, 0))
    kept = is_closed | (pc.list_value_length(opened).to_numpy() == 2)
    positioned = _bools(pc.not_equal(x, ""))
    spaced, returned = _bools(pc.equal(gap, " ")), _bools(pc.match_substring(text, "\r"))
    shown = is_closed & spaced & ~returned
    header = pc.extract_regex(text, _HEADER)
    code = pc.if_else(pa.array(spaced & _bools(header.is_valid())), header.field(0), None)
    tail = np.zeros(len(at), bool)
    tail[is_closed] = _bools(pc.equal(pc.list_element(closed.filter(pa.array(is_closed)), 1), ""))
    footer = tail & spaced & _bools(pc.match_substring_regex(text, r"^\d+$"))
    footer &= (following(ends, 1) & following(bars, 2) & following(any_line, 3))[at]

    font_of, color_of = latest(is_font)[at], latest(color)[at]
    gray_line = np.where((color_of >= 0) & gray[color_of], number[color_of], -1)
    above = at - 1
    fresh = (above >= first[page[at]]) & is_font[np.maximum(above, 0)]

    def per_page(places: np.ndarray, fields: list[tuple[str, pa.Array]]) -> pa.Array:
        counts = np.searchsorted(places, bounds).astype(np.int32)
        values = fields[0][1] if len(fields) == 1 else pa.StructArray.from_arrays([v for _, v in fields], names=[k for k, _ in fields])
        return pa.ListArray.from_arrays(pa.array(counts), values)

    def ints(values: np.ndarray) -> pa.Array:
        return pa.array(values.astype(np.int32))

    def edge(places: np.ndarray, values: pa.Array, rows: np.ndarray, take_last: bool) -> pa.Array:
        """First or last of some fragments' values on each page."""
        chosen = np.full(len(streams), -1, np.int64)
        order = rows if take_last else rows[::-1]
        chosen[page[places[order]]] = order
        return _strings(values, chosen)

    headed = np.flatnonzero(_bools(pc.is_valid(code)))
    codes = edge(at, code, headed, False)
    footers = edge(at, text, np.flatnonzero(footer), True)
    keep = np.flatnonzero(kept)
    take = pa.array(keep)
    number_or_null = lambda v: pc.if_else(pa.array(positioned), v, None).cast(pa.float64()).take(take)
    fragments = per_page(at[keep], [
        ("line", ints(number[at][keep])), ("at", ints((offset[at] + pc.utf8_length(lines.take(pa.array(at))).to_numpy()
                                                       - pc.utf8_length(rest).to_numpy())[keep])),
        ("x", number_or_null(x)), ("y", number_or_null(y)), ("leads", pa.array((positioned & _bools(pc.equal(lead, "")))[keep])),
        ("shown", pa.array(shown[keep])), ("text", text.take(take).cast(pa.string())), ("code", code.take(take).cast(pa.string())),
        ("font", _strings(lines, font_of[keep])), ("fresh", pa.array(fresh[keep])), ("gray_line", ints(gray_line[keep]))])
    marks = [np.flatnonzero(m) for m in (is_font, boxes, blocks, rules)]
    fonts = per_page(marks[0], [("line", ints(number[marks[0]])), ("at", ints(offset[marks[0]])), ("font", _strings(lines, marks[0]))])
    words = [(np.flatnonzero(_bools(pc.match_substring(lines, word))), word) for word in KEYWORDS]
    held, of = (np.concatenate(x) for x in zip(*[(at, np.full(len(at), k)) for k, (at, _) in enumerate(words)]))
    order = np.argsort(held, kind="stable")
    named = pa.array(KEYWORDS).take(pa.array(of[order]))
    return [codes, footers, fragments, fonts,
            per_page(marks[1], [("line", ints(number[marks[1]])), ("at", ints(offset[marks[1]]))]),
            *[per_page(m, [("line", ints(number[m]))]) for m in marks[2:]],
            per_page(held[order], [("line", ints(number[held[order]])), ("word", named)])]


#: Bytes of streams that are held as lines at once; a longer single stream is a step of its own.
STEP_BYTES = 4 << 20


def scan_pages(streams: DataFrame, stream: str = "stream") -> DataFrame:
    """The other columns of ``streams`` with the ``PAGE`` columns in place of the stream; no shuffle."""
    kept = [f for f in streams.schema.fields if f.name != stream]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept]) + ", " + PAGE
    names = [f.name for f in kept] + ["code", "footer", "fragments", "fonts", "boxes", "blocks", "rules", "marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(stream)), 0).to_numpy(zero_copy_only=False)
            step = np.cumsum(sizes) // STEP_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + scan(part.column(stream)), names=names)

    return streams.select(*[F.col(f"`{f.name}`") for f in kept], F.col(stream)).mapInArrow(run, schema)
