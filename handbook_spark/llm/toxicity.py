"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

A word is compared with another by the letter triples they share as subsequences: a triple may leave out up to
three letters between its own, and each left-out letter lowers its weight. So ``idxiot`` and ``stuupid`` stay close to the
insults they hide. Landmark words span the kernel's space (Nyström), and a linear machine in that space separates the
words that make sentences toxic from all others.

Only documents are labelled. Sentences of clean documents are clean; in a toxic document the sentence with the
highest scoring word is taken as its toxic one, and both choices and machine are improved in turn. A
sentence scores as its best word, a document as its best sentence, and a logistic curve gives the probability.

A kernel sum over landmarks is linear in the triples, so the trained machine is kept as one weight per triple; scoring
needs neither landmarks nor a memo. Long words are scored in overlapping windows.

Results for odd input: null and empty texts, and texts without letters, get the lowest score; without both labels in the training rows
every text scores 0; a document with several labels counts as toxic if one says so; repeated rows are scored one by one; extra
columns are ignored; texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm.words import split, steps

#: Training sample: documents of each label at most, and characters of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 1200, 20_000
#: A word or the beginning of words is taken as toxic at first if its likelihood ratio's root is so large, and if it is
#: so many times as frequent in toxic documents as in clean ones.
SURPLUS, RATIO = 5.5, 8.0
#: The same for the toxic documents that no such word explains, one word or stem after the other.
REST_SURPLUS = 4.2
#: Letters of beginnings.
STEMS = range(4, 9)
#: Symbols of the kernel: 0 for none, a to z, edges of a word, then other letters' bytes.
ALPHABET, BEGIN, END = 40, 27, 28
DECAY = 0.6
#: Places of a triple's second and third letter behind its first.
OFFSETS = [(a, b) for b in range(2, 6) for a in range(1, b)]
WINDOW, STRIDE = 18, 9
LANDMARKS = 256
TURNS, NEGATIVES = 4, 6000
#: Single letters in a row that are read as one word.
SPELLED = 4

_CODES = np.zeros(256, np.int64)
_CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODES[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_CODES[0x80:] = 29 + np.arange(128) % 11
_SENTENCE = re.compile(r"[.!?\n]+\s*")


class Pieces:
    """Words as coded windows, one after the other, with an edge symbol at both ends of a word."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        codes = _CODES[data]
        letters = codes > 0
        kept = np.concatenate(([0], np.cumsum(letters)))[offsets - offsets[0]]
        codes, size = codes[letters], np.diff(kept)
        # Windows of all words: most have one, long ones several that overlap.
        number = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
        word = np.repeat(np.arange(len(size)), number)
        turn = np.arange(len(word)) - np.repeat(np.cumsum(number) - number, number)
        start = kept[:-1][word] + turn * STRIDE
        length = np.minimum(size[word] - turn * STRIDE, WINDOW)
        first, last = turn == 0, turn == number[word] - 1
        total = length + 2
        ends = np.cumsum(total)
        self.begin = ends - total
        self.codes = np.zeros(int(ends[-1]) + 8 if len(ends) else 8, np.int64)
        inner = np.repeat(start - self.begin - 1, total) + np.arange(int(ends[-1]) if len(ends) else 0)
        at = np.arange(len(inner))
        body = np.ones(len(inner), bool)
        body[self.begin], body[ends - 1] = False, False
        self.codes[at[body]] = codes[inner[body]]
        self.codes[self.begin] = np.where(first, BEGIN, 0)
        self.codes[ends - 1] = np.where(last, END, 0)
        self.length, self.word, self.size = total, word, size
        self.first_of_word = np.cumsum(number) - number
        self.piece = np.repeat(np.arange(len(total)), total)
        self.end = np.repeat(ends, total)

    def triples(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(triple, piece, weight) for each pair of offsets."""
        codes, place = self.codes, np.arange(len(self.piece))
        for a, b in OFFSETS:
            ok = place + b < self.end
            one, two, three = codes[place[ok]], codes[place[ok] + a], codes[place[ok] + b]
            whole = (one > 0) & (two > 0) & (three > 0)
            yield ((one * ALPHABET + two) * ALPHABET + three)[whole], self.piece[ok][whole], DECAY ** (b - 2)

    def norms(self) -> np.ndarray:
        """Length of a window's triple vector when no triple occurs twice."""
        squares = sum(np.maximum(self.length - b, 0) * DECAY ** (2 * (b - 2)) for _, b in OFFSETS)
        return np.sqrt(np.maximum(squares, 1e-9))

    def linear(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's triples, normed; the best window of each word."""
        total = np.zeros(len(self.length))
        for triple, piece, weight in self.triples():
            total += weight * np.bincount(piece, weights[triple], minlength=len(total))
        total /= self.norms()
        return np.maximum.reduceat(total, self.first_of_word) if len(total) else total


def _listed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(triple, word, normed weight) of each word's first window, by word."""
    pieces = Pieces(pa.array(words, pa.large_string()))
    parts = [(t, p, np.full(len(t), w)) for t, p, w in pieces.triples()]
    triple, piece, weight = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(piece, kind="stable")
    triple, piece, weight = triple[order], piece[order], weight[order] / pieces.norms()[piece[order]]
    first = np.isin(piece, pieces.first_of_word)
    return triple[first], pieces.word[piece[first]], weight[first], len(words)


def dense(words: list[str]) -> np.ndarray:
    """Normed triple vectors of a few words, one row per word."""
    triple, word, weight, rows = _listed(words)
    width = ALPHABET ** 3
    return np.bincount(word * width + triple, weight, rows * width).reshape(rows, width).astype(np.float32)


def kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each word with each landmark (columns of ``landmarks``, a triple by landmark table)."""
    out = np.zeros((len(words), landmarks.shape[1]))
    for at in range(0, len(words), 512):
        triple, word, weight, _ = _listed(words[at : at + 512])
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else word
        out[at + word[begin]] = np.add.reduceat(landmarks[triple] * weight[:, None].astype(np.float32), begin)
    return out


class Machine:
    """A trained scorer: triple weights, the intercept, and the logistic curve of documents' features."""

    def __init__(self, weights: np.ndarray, intercept: float, curve: np.ndarray):
        self.weights, self.intercept, self.curve = weights.astype(np.float32), intercept, curve

    def words(self, words: pa.Array) -> np.ndarray:
        return _scored(words, self.weights, self.intercept)

    def probability(self, best: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features(best, hits, words) @ self.curve, -30, 30)))

    def documents(self, texts: pa.Array) -> np.ndarray:
        """Probability of each text."""
        offsets, words = split(texts)
        best, hits = np.full(len(texts), LOWEST), np.zeros(len(texts))
        if len(words):
            score = self.words(words.dictionary)[words.indices.to_numpy()]
            filled = np.flatnonzero(np.diff(offsets))
            best[filled] = np.maximum.reduceat(score, offsets[:-1][filled])
            hits = np.diff(np.concatenate(([0], np.cumsum(score > 0)))[offsets]).astype(float)
            self._spelled(offsets, words, best, hits)
        return self.probability(best, hits, np.diff(offsets))

    def _spelled(self, offsets: np.ndarray, words: pa.DictionaryArray, best: np.ndarray, hits: np.ndarray) -> None:
        """Words written as single letters with spaces between them."""
        one = pc.match_substring_regex(words.dictionary, "^[A-Za-z][.,!*_-]?$").to_numpy(zero_copy_only=False)[
            words.indices.to_numpy()]
        if not one.any():
            return
        edge = np.flatnonzero(np.diff(np.concatenate(([0], one.astype(np.int8), [0]))))
        text = np.searchsorted(offsets, np.arange(len(one)), "right") - 1
        runs, rows = [], []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= SPELLED and text[a] == text[b - 1]:
                runs.append("".join(words[i].as_py()[0] for i in range(a, b)))
                rows.append(text[a])
        if runs:
            score = self.words(pa.array(runs, pa.large_string()))
            np.maximum.at(best, np.array(rows), score)
            np.add.at(hits, np.array(rows), score > 0)


LOWEST = -3.0


def _scored(words: pa.Array, weights: np.ndarray, intercept: float) -> np.ndarray:
    """Score of each word; single letters and words without letters get the lowest one."""
    pieces = Pieces(words)
    return np.where(pieces.size > 1, pieces.linear(weights) + intercept, LOWEST)


def _inserted(word: str) -> list[str]:
    """Forms of an insult with one more character, as training examples."""
    middle = max(len(word) // 2, 1)
    return [word[:middle] + "x" + word[middle:], word[:middle] + word[middle - 1] + word[middle:],
            word[: middle - 1] + "q" + word[middle - 1 :]]


def _solve(rows: np.ndarray, signs: np.ndarray, weights: np.ndarray, c: float = 20.0, rounds: int = 40) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps on the rows inside the margin; the last entry is the intercept."""
    x = np.concatenate((rows, np.ones((len(rows), 1))), axis=1)
    pull = np.ones(x.shape[1])
    pull[-1] = 0.01
    v, inside = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(rounds):
        part = x[inside] * (2 * c * weights[inside])[:, None]
        v = np.linalg.solve(np.diag(pull) + part.T @ x[inside], part.T @ signs[inside])
        now = signs * (x @ v) < 1.0
        if (now == inside).all():
            break
        inside = now
    return v


def _first_of_copies(texts: list[str]) -> list[int]:
    """Texts that are no near copy of an earlier one: they share at most two of eight minimal trigram hashes with any."""
    salts = np.random.default_rng(3).integers(1, 1 << 32, 8, dtype=np.uint64) | np.uint64(1)
    known: list[dict[int, list[int]]] = [{} for _ in salts]
    kept = []
    for row, text in enumerate(texts):
        words = text.lower().split()
        grams = {zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(len(words) - 2, 1))}
        minima = ((np.fromiter(grams, np.uint64)[:, None] * salts) >> np.uint64(20)).min(0).tolist()
        shared = Counter(r for table, m in zip(known, minima) for r in table.get(m, ()))
        if not any(n > 2 for n in shared.values()):
            kept.append(row)
            for table, m in zip(known, minima):
                table.setdefault(m, []).append(row)
    return kept


def _surplus(toxic: int, clean: int, toxic_all: int, clean_all: int) -> float:
    """Signed root of the log likelihood ratio between a key's own rates in both labels and one common rate."""
    total, both = toxic_all + clean_all, toxic + clean

    def part(seen: float, of: float) -> float:
        return seen * math.log(seen / of) if seen else 0.0

    ratio = (part(toxic, toxic_all) + part(toxic_all - toxic, toxic_all) + part(clean, clean_all) + part(clean_all - clean, clean_all)
             - part(both, total) - part(total - both, total))
    return math.sqrt(max(2 * ratio, 0.0)) * (1 if toxic * clean_all >= clean * toxic_all else -1)


def _toxic_words(toxic: list[set[str]], clean: list[set[str]]) -> set[str]:
    """Words that toxic documents have more often than chance allows, or that have such a beginning.

    Clear cases come first. Then, as long as toxic documents are left without any of them, the word or beginning
    that most of the rest have is added, if it is rare enough in clean documents.
    """
    sizes = len(toxic), max(len(clean), 1)
    ratio = sizes[0] / sizes[1]

    def keys(word: str) -> list[str]:
        return [f"={word}", *(word[:n] for n in STEMS if n < len(word))]

    toxic_keys = [frozenset(sys.intern(k) for w in words for k in keys(w)) for words in toxic]
    in_toxic = Counter(k for row in toxic_keys for k in row)
    # Only keys of toxic documents matter.
    in_clean = Counter(k for words in clean for k in {k for w in words for k in keys(w)} if k in in_toxic)

    def rare(key: str) -> bool:
        return in_toxic[key] >= RATIO * ratio * (in_clean[key] + 0.5)

    found = {k for k, n in in_toxic.items() if rare(k) and _surplus(n, in_clean[k], *sizes) >= SURPLUS}
    rest = [row for row in toxic_keys if not row & found]
    while rest:
        counts = Counter(k for row in rest for k in row if rare(k))
        best = max(counts, key=lambda k: (_surplus(counts[k], in_clean[k], *sizes), k), default=None)
        if best is None or _surplus(counts[best], in_clean[best], *sizes) < REST_SURPLUS:
            break
        found.add(best)
        rest = [row for row in rest if best not in row]
    return {w for words in toxic for w in words
            if any(k in found for k in keys(w)) and (in_clean[f"={w}"] <= 1 or rare(f"={w}"))}


def fit(documents: list[tuple[str, int]]) -> Machine:
    """Machine from labelled texts."""
    labels = np.array([y for _, y in documents])
    nothing = Machine(np.zeros(ALPHABET ** 3), 0.0, np.array([0.0, 0.0, 0.0, -30.0]))
    if not len(labels) or labels.min() == labels.max():
        return nothing
    sentences: list[tuple[int, list[str]]] = []
    seen: list[set[str]] = []
    first = _first_of_copies([text for text, _ in documents])
    for row, (text, _) in enumerate(documents):
        seen.append(set())
        for sentence in _SENTENCE.split(text.lower()):
            words = [w for w in ("".join(filter(str.isalpha, x)) for x in sentence.split()) if len(w) > 1]
            if words:
                sentences.append((row, words))
                seen[-1].update(words)
    in_words = [Counter(w for row in first if labels[row] == y for w in seen[row]) for y in (0, 1)]
    known = sorted(set().union(*seen))
    place = {w: i for i, w in enumerate(known)}
    sure = np.zeros(len(known), bool)
    sure[[place[w] for w in _toxic_words([seen[r] for r in first if labels[r]], [seen[r] for r in first if not labels[r]])]] = True
    if not sure.any():
        return nothing
    rng = np.random.default_rng(7)
    listed = pa.array(known, pa.large_string())
    clean_words = np.array([i for i, w in enumerate(known) if in_words[0][w]], np.int64)
    frequent = np.flatnonzero(sure)[np.argsort([-in_words[1][known[i]] for i in np.flatnonzero(sure)], kind="stable")]
    background = rng.choice(clean_words, min(LANDMARKS // 2, len(clean_words)), replace=False)
    landmarks = dense([known[i] for i in dict.fromkeys([*frequent[: LANDMARKS // 2].tolist(), *background.tolist()])]).T
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    kept = values > 1e-3
    root = vectors[:, kept] / np.sqrt(values[kept])  # Nyström: kernel(words) @ root
    by_sentence = [(row, np.array([place[w] for w in words])) for row, words in sentences]
    negatives = set(rng.choice(clean_words, min(NEGATIVES // 2, len(clean_words)), replace=False).tolist())
    positives = set(np.flatnonzero(sure).tolist())
    for turn in range(TURNS):
        chosen = sorted(positives)
        positive = [known[i] for i in chosen]
        forms = [f for w in positive for f in _inserted(w)]
        counts = np.sqrt([max(in_words[1][w], 1) for w in positive])
        negative = [known[i] for i in sorted(negatives - positives)]
        x = kernel(positive + forms + negative, landmarks) @ root
        signs = np.concatenate((np.ones(len(positive) + len(forms)), -np.ones(len(negative))))
        weight = np.concatenate((counts, np.repeat(0.3 * counts, 3), np.full(len(negative), 2.0)))
        v = _solve(x, signs, weight / weight.mean())
        triples, intercept = landmarks.astype(np.float64) @ (root @ v[:-1]), float(v[-1])
        score = np.concatenate([_scored(listed.slice(at, 20_000), triples, intercept) for at in range(0, len(listed), 20_000)])
        # Clean words that score highest are learned as such in the next turn.
        negatives |= set(clean_words[np.argsort(-score[clean_words], kind="stable")[: NEGATIVES // TURNS // 2]].tolist())
        # A toxic document without any toxic word yet: its best sentence's best word, if that is near the border.
        best: dict[int, tuple[float, int]] = {}
        for row, words in by_sentence:
            if labels[row]:
                top = int(words[np.argmax(score[words])])
                best[row] = max(best.get(row, (LOWEST, -1)), (float(score[top]), top))
        positives |= {i for value, i in best.values() if -0.5 < value < 0.5 and not in_words[0][known[i]]}
    values, hits, words_of = np.full(len(labels), LOWEST), np.zeros(len(labels)), np.zeros(len(labels))
    for row, words in by_sentence:
        values[row] = max(values[row], float(score[words].max()))
        hits[row] += (score[words] > 0).sum()
        words_of[row] += len(words)
    return Machine(triples, intercept, _logistic(features(values, hits, words_of), labels))


def features(best: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What a document's probability depends on: its best word, how many are on the toxic side, and how many there are."""
    return np.stack((best, np.log1p(hits), np.log1p(words), np.ones(len(best))), 1)


def _logistic(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, by damped Newton steps; targets leave some doubt at both ends."""
    n1, n0 = labels.sum(), (labels == 0).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    # Clean documents count more than toxic ones: most of a corpus is clean.
    weight = np.where(labels == 1, 0.3 / n1, 0.7 / n0)
    v = np.zeros(x.shape[1])
    v[0] = 1.0
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * v
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(v))
        v = v - np.clip(np.linalg.solve(curve, gradient), -1, 1)
        v[:2] = np.maximum(v[:2], 0.5)  # a more toxic word never lowers the probability
    return v


def sample(docs: DataFrame, labels: DataFrame, training: Column) -> list[tuple[str, int]]:
    """At most ``SAMPLE_DOCUMENTS`` labelled texts of each label, those of the smallest id hash in each hash cell.

    Ids are chosen from ``labels`` (doc_id, toxic) alone; one scan of ``docs`` then picks the texts.
    """
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_DOCUMENTS))
    one = labels.filter(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    # Hash first: the struct's minimum is the id with the smallest hash.
    chosen = one.groupBy("toxic", cell.alias("cell")).agg(
        F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id")).alias("m")).select("m.doc_id", "toxic")
    texts = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.filter(F.col("text").isNotNull()).groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return [(r.text, int(r.toxic == 1)) for r in sorted(found, key=lambda r: r.doc_id)]


def score_documents(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """``keep`` columns with ``score``, the probability that the text is toxic; one pass, no shuffle."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "__text", 2 << 20):
                texts = pc.fill_null(pc.utf8_lower(part.column("__text")), "")
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in fields] + [pa.array(machine.documents(texts))],
                    names=[f.name for f in fields] + ["score"])

    return source.mapInArrow(run, schema)
