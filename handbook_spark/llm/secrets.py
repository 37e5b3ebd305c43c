"""Secret scan: fixed patterns, and literals assigned to sensitive names.

Spans are (kind, start, end) in code points, end exclusive. ``assign``, ``access`` and ``hex`` come from
fixed patterns. ``literal`` comes from an assignment-aware lexer: it reads names, quoted strings, bare
configuration values and operators, pairs each literal with the name it is assigned to (``name = "x"``,
``"name": "x"``, ``NAME=x``, ``table["name"] = "x"``, ``name: Type = "x"``, concatenations with ``+``), follows names that stand for such literals, and scores
a literal by the name it ends up under and by its own form.

Results for odd input: null and empty texts have no spans; a span is reported once per kind; equal
starts are ordered by kind as listed in ``KINDS``; repeated rows are scanned one by one; very long
texts are scanned whole, in time proportional to their length; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm.words import lowered, steps

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

#: Parts of names that hold secrets, and how much each part says (1: always a secret).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "token": 0.8, "apikey": 1.0,
    "api_key": 1.0, "private_key": 1.0, "privatekey": 1.0, "access_key": 1.0, "accesskey": 1.0, "auth_key": 0.9,
    "authorization": 0.7, "credential": 0.8, "client_key": 0.8, "signing_key": 0.9, "encryption_key": 0.9,
    "connection_string": 0.7,
}
#: Literals that stand for a missing secret.
PLACEHOLDERS = frozenset((
    "changeme", "example", "placeholder", "none", "null", "true", "false", "undefined", "redacted", "todo",
    "password", "secret", "token", "string", "your_password", "your_token", "your_api_key", "xxxxxx", "xxxxxxxx",
))
MIN_LENGTH, MIN_SCORE = 6, 0.5

_NAMED = "|".join(sorted(SENSITIVE, key=len, reverse=True))
#: What a text must hold, in lower case, before any of the scans can find a span in it.
#: ``sensitivity`` reads ``.``, ``-`` and the border of a camel-case part as ``_``, and the Kelvin sign as k.
_ANY = f"{_NAMED.replace('_', '[_.-]?').replace('k', '[k\u212a]')}|akia[a-z0-9]{{16}}|[0-9a-f]{{24}}"
_SENSITIVE = re.compile(_NAMED)
_LEXEMES = re.compile(
    r'''(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`)'''
    r"""|(?P<name>[^\W\d][\w.\-]*)|(?P<number>\d[\w.+/=\-]*)|(?P<bind>:=|=>|={1,3}|:)|(?P<join>\+|\.\.)|(?P<line>\n)|(?P<other>[^\s])""")
#: Parts of a declared type; a single colon, a quote or a line's end is none.
_TYPE = re.compile(r"""(?P<space>[ \t]+)|(?P<word>[^\W\d][\w.]*+(?:::[\w.]++)*+)|(?P<open>[\[<(])|(?P<close>[\])>])"""
                   r"""|(?P<mark>'\w++(?!')|[&*?|])|(?P<inner>,|\d++|::|->)|(?P<equals>=(?![=>]))""")
_FOLLOWS, _QUOTES = re.compile(r"[ \t]*+(\S)"), "'\"`"
#: Words of a type that another word follows.
_BEFORE_TYPE = frozenset(("mut", "const", "dyn", "impl", "readonly", "static", "unsigned", "signed", "long", "short"))
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>#]+")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    spans = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]


def sensitivity(name: str) -> float:
    """How surely a name holds a secret, from its parts (``dbPassword``, ``DB-PASSWD`` and ``db.password`` alike)."""
    plain = re.sub(r"[.\-]", "_", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name)).lower()
    return max((SENSITIVE[m] for m in _SENSITIVE.findall(plain)), default=0.0)


def secrecy(literal: str) -> float:
    """From 0 to 1: how much a literal looks like a secret value rather than a word or a placeholder."""
    if len(literal) < MIN_LENGTH or literal.lower() in PLACEHOLDERS or re.search(r"\s|^[$<{%]|^https?:", literal):
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    return min(1.0, entropy / 3.0) * (0.6 + 0.2 * min(kinds - 1, 2))


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Names with the spans of the literals assigned to them, in text order.

    A closing bracket may stand between name and operator (``table["name"] = "x"``), and a type behind a colon
    (``name: Type = "x"``). Behind ``)`` only an assignment counts: ``:`` and ``=>`` there begin a body or a result type.
    A value is a string, a bare configuration value, or a name; parts joined by ``+`` belong together. A
    name as value stands for the literals last assigned to it before (constants are propagated).
    """
    constants: dict[str, list[tuple[int, int]]] = {}
    target, target_end, closed, at, size = None, -1, "", 0, len(text)
    while at < size:
        m = _LEXEMES.search(text, at)
        if m is None:
            return
        kind, at = m.lastgroup, m.end()
        if kind == "name":
            target, target_end, closed = m[0], at, ""
        elif kind == "string":
            target, target_end, closed = m[0][1:-1], at, ""
        elif target is None or text[target_end : m.start()].strip(" \t"):
            target = None
        elif kind == "other" and m[0] in "])":
            target_end, closed = at, m[0]
        elif kind == "bind":
            typed = _typed(text, at) if m[0] == ":" else None
            if closed == ")" and typed is None and m[0] in (":", "=>"):
                target = None
                continue
            if typed is not None:
                if text[typed] not in _QUOTES and (parts := _value(text, at, constants)[0]):
                    yield target, parts  # ``password: x = y`` can also be a bare value with a remark
                at = typed
            parts, at = _value(text, at, constants)
            if parts:
                constants[target] = parts
                yield target, parts
            target = None
        else:
            target = None


def _typed(text: str, at: int) -> int | None:
    """Where the value begins if a type and ``=`` stand at ``at``.

    A bare value that holds ``=`` itself (base64, ``key=value``) is no type: without a space before ``=`` a quote has to follow.
    """
    depth, words, last = 0, 0, ""
    if text.startswith(":", at):
        return None
    while m := _TYPE.match(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "equals":
            spaced, value = text[m.start() - 1] in " \t", _FOLLOWS.match(text, at)
            return value.start(1) if value and words and not depth and (spaced or value[1] in _QUOTES) else None
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
        elif kind == "inner" and not depth or kind == "word" and not depth and last == "word":
            return None
        if depth < 0:
            return None
        if kind == "word":
            words += 1
            kind = "" if m[0] in _BEFORE_TYPE else kind
        if kind != "space":
            last = kind
    return None


def _value(text: str, at: int, constants: dict[str, list[tuple[int, int]]]) -> tuple[list[tuple[int, int]], int]:
    """Literal spans of the expression at ``at`` and where it ends."""
    parts: list[tuple[int, int]] = []
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        m = _LEXEMES.match(text, at)
        if m is None or m.lastgroup in ("line", "bind", "join", "other"):
            return parts, at
        if m.lastgroup == "string":
            parts.append((m.start() + 1, m.end() - 1))
            at = m.end()
        else:
            bare = _BARE.match(text, at)
            word, at = bare[0], bare.end()
            if word in constants:
                parts += constants[word]
            else:
                parts.append((bare.start(), bare.start() + len(word.rstrip(".:"))))
        follow = at
        while follow < len(text) and text[follow] in " \t":
            follow += 1
        m = _LEXEMES.match(text, follow)
        if m is None or m.lastgroup != "join":
            return parts, at
        at = m.end()


def literal_spans(text: str) -> list[tuple[int, str, int]]:
    found = set()
    for name, parts in pairs(text):
        weight = sensitivity(name)
        if not weight:
            continue
        whole = "".join(text[a:b] for a, b in parts)
        if weight * secrecy(whole) >= MIN_SCORE:
            found.update((a, "literal", b) for a, b in parts if b > a)
    return list(found)


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """All spans of a text by start, then kind as listed."""
    if not text:
        return []
    return sorted(base_spans(text) + literal_spans(text), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, str, int]], mark: str = "[secret]") -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for start, _, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def scan_documents(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns with ``spans`` (array of kind, start, end) and ``clean``, the redacted text; one pass.

    Texts without any sensitive word, key prefix or long run of hex digits are passed over as arrays;
    only the others are lexed.
    """
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    span = "array<struct<kind: string, start: int, end: int>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"spans {span}", "clean string"])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "__text"):
                texts = part.column("__text")
                worth = pc.fill_null(pc.match_substring_regex(lowered(texts), _ANY), False).to_pylist()
                spans = [scan(texts[i].as_py()) if hit else [] for i, hit in enumerate(worth)]
                clean = texts
                if any(spans):
                    clean = pa.array([redacted(texts[i].as_py(), s) if s else texts[i].as_py()
                                      for i, s in enumerate(spans)], texts.type)
                rows = [[{"kind": k, "start": a, "end": b} for a, k, b in s] for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in fields] + [pa.array(rows, arrow_span), clean.cast(pa.string())],
                    names=[f.name for f in fields] + ["spans", "clean"])

    return source.mapInArrow(run, schema)
