"""Plain Python versions of what the queries return, one row at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


class Tokenizers:
    def __init__(self):
        self.word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        self.byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None) -> set[tuple]:
    words = WORDS.findall(lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(rows: list[tuple]) -> dict:
    """doc_id -> (n_shingles, component_id); rows without id link with nothing."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for n, (i, a) in enumerate(known):
        for j, b in known[:n]:
            same = len(a & b)
            if 100 * same >= 75 * (len(a) + len(b) - same):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i) if i is not None else None) for i, s in sets}


def secret_spans(text: str | None) -> list[str]:
    found = []
    for order, (kind, pattern, good) in enumerate((
            ("assign", ASSIGN, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
            ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))):
        found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if good(m)]
    return [s for *_, s in sorted(found)]


def base_scores(rows: list[tuple], train) -> list[tuple]:
    """(n_tokens, n_known, train_tokens, base_score) per row."""
    words = [[*WORDS.findall(lower(t)), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, words) if train(i) for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), total,
             sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws)) for ws in words]


def crc(doc_id) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def sha(ids: list[int]) -> str:
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def best_rows(rows: list[tuple], score, usable, k: int = 5) -> set[tuple]:
    """(query, rank, id, score) of the k best; equal rows count once, equal scores go to the smaller id."""
    used = list({(i, tuple(v)) for i, v in rows if i is not None and v and usable(v)})
    out = set()
    for q, vector in used:
        if q % 50 == 0:
            found = sorted({(-score(vector, v), i) for i, v in used if i != q})[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found, 1)}
    return out


def mix_targets(sizes: dict) -> dict:
    """Targets of sources by sharing the excess again until no source is above its limit."""
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    left, open_sources = 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_sources:
        total = sum(weight[s] for s in open_sources)
        for s in open_sources:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_sources):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_sources.discard(s)
    return target


def filled_in_middle(doc_id, text: str | None) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text cut into lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rebuilt_conversations(rows: list[tuple]) -> dict:
    """conv_id -> its turns (role, text) after rebuilding; ``rows`` are (conv_id, turn, role, text)."""

    def order(row):
        role, text = row[2] or "", row[3] or ""
        return row[1] is not None, row[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()

    own: dict = {}
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        found[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return found


def trie(rows: list[tuple]) -> set[tuple]:
    """All columns of each prefix, by walking every prefix of every conversation."""
    paths = rebuilt_conversations(rows)
    members: dict[tuple, list] = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ids in members.items():
        weight = (len(ids) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += weight
    return {(min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(c for c in ids if len(paths[c]) == len(p)))).encode()).hexdigest())
            for p, ids in members.items()}


def language_model_score(model, ids: list[int]) -> float:
    """log10 probability of a text's ids (its end with them), one place after the other."""
    from handbook_spark.llm import lm_scoring as lm

    p = {k: v.astype(np.float64) for k, v in model.attention.p.items()}
    bucket = [int(model.bucket_of[i]) for i in ids]
    before = [0, *bucket[:-1]]
    total = 0.0
    for at, i in enumerate(ids):
        first = at // lm.SCORED * lm.SCORED - (lm.WINDOW - lm.SCORED)  # the window that scores the place
        seen = range(max(first, 0), at + 1)
        own = p["embed"][before[at]]
        query = own @ p["q"] / math.sqrt(lm.WIDTH)
        logits = [query @ (p["embed"][before[j]] @ p["k"]) + p["place"][at % lm.SCORED, j - first] for j in seen]
        weights = np.exp(np.array(logits) - max(logits))
        weights /= weights.sum()
        value = sum(w * (p["embed"][before[j]] @ p["v"]) for w, j in zip(weights, seen))
        hidden = np.maximum(np.concatenate((own, value)) @ p["hidden"] + p["hidden_add"], 0)
        out = hidden @ p["out"] + p["out_add"]
        log = out - out.max() - math.log(np.exp(out - out.max()).sum())
        total += log[model.class_of[bucket[at]]] + model.bigram[before[at], bucket[at]] + model.id_log[i]
    return total / math.log(10)
