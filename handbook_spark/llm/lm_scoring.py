"""Language-model scores: corpus word counts, and a causal self-attention model on subword ids.

Corpus counts. Words are hashed and packed by bucket, so each bucket sees all occurrences of its words and can return, for
every document, the sum of its tokens' log counts. Nothing but these sums goes back to the documents.

The model. A subword id belongs to a bucket (the most frequent ids of all training documents have one each) and a bucket to a class
(buckets that follow alike ones, counted over all training documents). The class of the
next id comes from causal self-attention over the ids before it; the bucket
within the class from the bucket before it, and the id within the bucket from its frequency, both counted over all training documents.
Texts are read in overlapping windows: a window scores its last ``SCORED`` places, and the places before them
are context, so each id is scored once. Windows of many documents are one batch with one causal mask.

Training. The attention weights are trained where the documents lie: in each of ``ROUNDS`` rounds every task starts from the common
weights, takes those windows of its training documents, at any depth, whose hash is the round's, and steps along them; the weights
of all tasks are then averaged by their windows, in two levels of tables of fixed size. Every window of every training document belongs to
one round, so after the last one each has been stepped along. The work grows with the corpus; a task with few windows steps along them several times.

The score is the model's log probability of the text. ``mixed_score`` is that of an even mixture of the model and the word counts.

Results for odd input: a null text is an empty one and has only its end token; documents without a single training document
get base scores from the 0.1 alone and an untrained model; repeated rows are scored one by one and each counts in training; extra columns
are ignored; texts of any length are learned from and scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbook_spark.llm.packing import packed, step_key
from handbook_spark.llm.token_files import library_encoder
from handbook_spark.llm.words import hashes, lowered, mixed, split, steps
from handbook_spark.session import materialize

#: Added to every token's count.
ADD = 0.1
BUCKETS, CLASSES, WIDTH = 512, 32, 16
WINDOW, SCORED = 32, 24
#: Rounds of training, which share all windows among them, windows of a step, and steps that a task makes at least in a round.
ROUNDS, BATCH, LEAST_STEPS = 4, 256, 48
#: Different words whose ids a task remembers.
MEMO_CHUNKS = 400_000
#: Windows whose arrays are held at once in training, so few that they stay in a core's cache, and windows that are scored together.
SLICE, SCORE_BATCH = 64, 96
#: Ids at a window's first scored places that make its hash.
_HASHED_IDS = 5
_BEGIN = 0  # bucket of the place before a text, 1 is the end token's


# --- word counts over the corpus ---------------------------------------------------------------------------------


def word_scores(docs: DataFrame) -> DataFrame:
    """text_id, n_tokens, n_known, train_tokens, base_score for ``docs`` (text_id, text, train).

    ``text_id`` comes back as it is. Training counts are those of the rows with ``train``.
    """
    number = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema["text_id"].dataType.simpleString()
    source = docs.select("text_id", "text", "train")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = 0
        for batch in batches:
            for part in steps(batch):
                step, rows = step_key(counter), part.num_rows
                counter += 1
                offsets, words = split(lowered(part.column("text")))
                n = np.diff(offsets)
                width = max(len(words.dictionary), 1)
                key, times = np.unique(np.repeat(np.arange(rows), n) * width + words.indices.to_numpy(), return_counts=True)
                word = hashes(words.dictionary)[key % width] if len(words) else np.zeros(0, np.uint64)
                buckets = ((word >> np.uint64(40)) % np.uint64(number)).astype(np.int64)
                train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                found = list(packed(buckets, number, word, (key // width).astype(np.uint16), times.astype(np.uint32)))
                size = len(found)
                none = pa.nulls(size, part.column("text_id").type)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found] + [step % number], pa.int32()), pa.array([step] * (size + 1), pa.int64()),
                     *(pa.array([f[i] for f in found] + [None], pa.binary()) for i in (1, 2, 3)),
                     pa.array([np.packbits(train).tobytes()] * (size + 1), pa.binary()),
                     pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0] * (size + 1), pa.int32()), none.slice(0, 0)),
                                       pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), part.column("text_id"))]),
                     pa.array([None] * size + [n.tolist()], pa.list_(pa.int64()))],
                    names=["bucket", "step", "words", "places", "times", "train", "text_ids", "sizes"])

    def count(bucket: pa.Table) -> pa.Table:
        rows = [r for r in range(bucket.num_rows) if bucket["words"][r].is_valid]
        words = [np.frombuffer(bucket["words"][r].as_py(), np.uint64) for r in rows]
        places = [np.frombuffer(bucket["places"][r].as_py(), np.uint16) for r in rows]
        times = [np.frombuffer(bucket["times"][r].as_py(), np.uint32) for r in rows]
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        trained = [t * _bits(bucket["train"][r].as_py())[p] for r, p, t in zip(rows, places, times)]
        values, index = np.unique(flat, return_inverse=True)
        total = np.bincount(index, np.concatenate(trained), minlength=len(values)) if words else np.zeros(0)
        log = np.log10(total + ADD)
        partial, at = [], 0
        for place, time in zip(places, times):
            of = index[at : at + len(place)]
            at += len(place)
            used, where = np.unique(place, return_inverse=True)
            partial.append((used.tobytes(), np.bincount(where, log[of] * time).astype(np.float64).tobytes(),
                            np.bincount(where, (total[of] > 0) * time).astype(np.int64).tobytes()))
        size = bucket.num_rows
        back = {r: p for r, p in zip(rows, partial)}
        numbers = [(float(total.sum()), int((total > 0).sum()))] + [(0.0, 0)] * (size - 1)
        return pa.table({
            "step": bucket["step"], **{name: pa.array([back.get(r, (None,) * 3)[i] for r in range(size)], pa.binary())
                                       for i, name in enumerate(("places", "logs", "known"))},
            "train": bucket["train"], "text_ids": bucket["text_ids"], "sizes": bucket["sizes"],
            "train_words": pa.array([int(n[0]) for n in numbers], pa.int64()),
            "train_kinds": pa.array([n[1] for n in numbers], pa.int64())})

    def add(step: pa.Table) -> pa.Table:
        head = next(r for r in range(step.num_rows) if step["sizes"][r].is_valid)
        sizes = np.array(step["sizes"][head].as_py(), np.int64)
        logs, known = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
        # In one order, whatever the order in which the buckets arrive, so that sums are the same in every run.
        for place, log, hit in sorted((p.as_py(), g.as_py(), k.as_py()) for p, g, k in zip(
                step["places"], step["logs"], step["known"]) if p.is_valid):
            at = np.frombuffer(place, np.uint16)
            logs[at] += np.frombuffer(log, np.float64)
            known[at] += np.frombuffer(hit, np.int64)
        return pa.table({
            "text_id": step["text_ids"][head].values, "words": pa.array(sizes), "known": pa.array(known), "logs": pa.array(logs),
            "train": pa.array(_bits(step["train"][head].as_py())[: len(sizes)].astype(bool))})

    packs = source.mapInArrow(
        pack, f"bucket int, step long, words binary, places binary, times binary, train binary, text_ids array<{id_type}>, sizes array<long>")
    counted = materialize(packs.groupBy("bucket").applyInArrow(
        count, "step long, places binary, logs binary, known binary, train binary, "
               f"text_ids array<{id_type}>, sizes array<long>, train_words long, train_kinds long"))
    rows = materialize(counted.drop("train_words", "train_kinds").groupBy("step").applyInArrow(
        add, f"text_id {id_type}, words long, known long, logs double, train boolean"))
    totals = counted.agg(F.coalesce(F.sum("train_words"), F.lit(0)).alias("w"), F.coalesce(F.sum("train_kinds"), F.lit(0)).alias("v")).first()
    ends = rows.filter("train").count()
    tokens, kinds = totals.w + ends, totals.v + (1 if ends else 0)
    size = F.col("words") + 1
    base = F.col("logs") + float(np.log10(ends + ADD)) - size * float(np.log10(tokens + ADD * (kinds + 1)))
    return rows.select("text_id", size.alias("n_tokens"), (F.col("known") + (1 if ends else 0)).alias("n_known"),
                       F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"))


def _bits(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8)).astype(np.uint32)


# --- the attention model -----------------------------------------------------------------------------------------


class Attention:
    """One layer of causal self-attention that predicts the class of the next id; weights in a dictionary of arrays."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def near_zero(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.2).astype(np.float32)

        self.p = {
            "embed": near_zero(BUCKETS, WIDTH), "q": near_zero(WIDTH, WIDTH), "k": near_zero(WIDTH, WIDTH), "v": near_zero(WIDTH, WIDTH),
            "place": np.zeros((SCORED, WINDOW), np.float32), "hidden": near_zero(2 * WIDTH, 2 * WIDTH), "hidden_add": near_zero(2 * WIDTH),
            "out": near_zero(2 * WIDTH, CLASSES), "out_add": np.zeros(CLASSES, np.float32)}

    def tables(self, size: int) -> dict[str, np.ndarray]:
        """What the weights make of each bucket (its embedding with a one behind, what it asks of the places before it, its part of the
        hidden layer), products of weights, and what is added to the places of up to ``size`` windows.

        There are far fewer buckets than places, so places look these up instead of multiplying. Query and key weights meet only
        in their product, and so do those of values and of the hidden layer: places attend to embeddings, and the products are applied once.
        """
        p = self.p
        kind = p["embed"].dtype
        ask, use = p["q"] @ p["k"].T * kind.type(WIDTH ** -0.5), p["v"] @ p["hidden"][WIDTH:]
        return {
            "embed": np.concatenate((p["embed"], np.ones((BUCKETS, 1), kind)), axis=1), "use": use,
            "asked": p["embed"] @ ask, "begun": p["embed"] @ p["hidden"][:WIDTH] + p["hidden_add"],
            "ask_back": ask.T.copy(), "use_back": use.T.copy(), "own_back": p["hidden"][:WIDTH].T.copy(), "out_back": p["out"].T.copy(),
            "place": p["place"] + _MASK.astype(kind), "out_add": np.tile(p["out_add"], (size * SCORED, 1)),
            "zero": np.zeros((size * SCORED, 2 * WIDTH), kind)}

    def _forward(self, t: dict[str, np.ndarray], buckets: np.ndarray, absent: np.ndarray) -> dict[str, np.ndarray]:
        """Logits of the classes behind each of the last places of windows, and what they are made of.

        Exponentials are kept as they are beside their sums: a value is divided once, where its row is added up.
        """
        flat, last = len(buckets) * SCORED, buckets[:, -SCORED:]
        x, asked = t["embed"].take(buckets, axis=0), t["asked"].take(last, axis=0)
        # Products of many small matrices are fastest if none of them has to be read across.
        across = x.transpose(0, 2, 1).copy()
        some = np.flatnonzero(absent[:, 0])  # absent places come first

        def scores() -> np.ndarray:
            out = asked @ across[:, :WIDTH]
            out += t["place"]
            if len(some):
                out[some] += np.where(absent[some], np.float32(-1e9), np.float32(0))[:, None, :]
            return out

        weight = scores()
        with np.errstate(over="ignore", invalid="ignore"):
            np.exp(weight, out=weight)
            seen = weight @ x
        if not _exact(seen[:, :, WIDTH]):
            weight = scores()
            weight -= weight.max(-1, keepdims=True)
            np.exp(weight, out=weight)
            seen = weight @ x
        total = seen[:, :, WIDTH:]
        context = np.divide(seen[:, :, :WIDTH], total).reshape(flat, WIDTH)
        hidden = context @ t["use"]
        hidden += t["begun"].take(last, axis=0).reshape(hidden.shape)
        np.maximum(hidden, t["zero"][:flat], out=hidden)  # much faster than with a single zero
        logits = hidden @ self.p["out"]
        logits += t["out_add"][:flat]
        return {"x": x, "across": across, "asked": asked, "weight": weight, "total": total, "context": context, "hidden": hidden, "logits": logits}

    def forward(self, buckets: np.ndarray, absent: np.ndarray) -> dict[str, np.ndarray]:
        """Class log probabilities (``log``) behind each of the last places of windows (rows of input buckets).

        A place attends to itself and to places before it that are not ``absent``.
        """
        logits = _shifted(self._forward(self.tables(len(buckets)), buckets, absent)["logits"])
        return {"log": logits - np.log(np.exp(logits).sum(1, keepdims=True))}

    def target_log(self, buckets: np.ndarray, absent: np.ndarray, targets: np.ndarray, tables: dict[str, np.ndarray] | None = None) -> np.ndarray:
        """Log probability of each scored place's class; ``tables`` are those of at least as many windows."""
        logits = _shifted(self._forward(tables or self.tables(len(buckets)), buckets, absent)["logits"])
        log = logits.reshape(-1)[np.arange(0, logits.size, CLASSES) + targets.reshape(-1)]
        np.exp(logits, out=logits)
        return (log - np.log(logits @ np.ones(CLASSES, logits.dtype))).reshape(-1, SCORED)

    def gradient(self, buckets: np.ndarray, absent: np.ndarray, targets: np.ndarray, used: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over used places and its gradient, added up over slices of windows."""
        n = max(int(used.sum()), 1)
        t, p = self.tables(min(SLICE, len(buckets))), self.p
        loss, g = 0.0, {k: np.zeros_like(v) for k, v in p.items()} | {"ask": np.zeros_like(p["q"]), "use": np.zeros_like(t["use"])}
        for at in range(0, len(buckets), SLICE):
            rows = slice(at, at + SLICE)
            loss += self._gradient(t, g, buckets[rows], absent[rows], targets[rows], used[rows], n)
        ask, use = g.pop("ask") * p["q"].dtype.type(WIDTH ** -0.5), g.pop("use")
        g["q"], g["k"] = ask @ p["k"], ask.T @ p["q"]
        g["v"], g["hidden"][WIDTH:] = use @ p["hidden"][WIDTH:].T, p["v"].T @ use
        return loss, g

    def _gradient(self, t: dict[str, np.ndarray], g: dict[str, np.ndarray], buckets: np.ndarray, absent: np.ndarray, targets: np.ndarray,
                  used: np.ndarray, n: int) -> float:
        """Adds the share of some windows in the gradient over ``n`` places to ``g``; returns their share in the loss."""
        p, f, size = self.p, self._forward(t, buckets, absent), len(buckets)
        kind, flat = p["embed"].dtype, size * SCORED
        hidden, context, weight = f["hidden"], f["context"], f["weight"]
        cell = np.arange(0, flat * CLASSES, CLASSES) + targets.reshape(-1)
        part = used.reshape(-1) * kind.type(1 / n)
        d = _shifted(f["logits"])
        chosen = d.reshape(-1)[cell]
        np.exp(d, out=d)
        total = d @ np.ones(CLASSES, kind)
        loss = float((np.log(total) - chosen) @ part)
        d *= (part / total)[:, None]
        d.reshape(-1)[cell] -= part
        one = np.ones(flat, kind)
        g["out"] += hidden.T @ d
        g["out_add"] += one @ d
        dh = d @ t["out_back"]
        dh *= (hidden > 0).astype(kind)
        g["hidden_add"] += one @ dh
        g["use"] += context.T @ dh
        # Of what was seen, and behind it of the sums by which it was divided.
        dc = np.empty((size, SCORED, WIDTH + 1), kind)
        np.divide((dh @ t["use_back"]).reshape(size, SCORED, WIDTH), f["total"], out=dc[:, :, :WIDTH])
        context *= dc[:, :, :WIDTH].reshape(flat, WIDTH)
        np.negative((context @ one[:WIDTH]).reshape(size, SCORED), out=dc[:, :, WIDTH])
        ds = dc @ f["across"]
        ds *= weight
        g["place"] += ds.sum(0)
        da = (ds @ f["x"][:, :, :WIDTH]).reshape(flat, WIDTH)
        last = f["x"][:, -SCORED:, :WIDTH].reshape(flat, WIDTH)
        g["ask"] += last.T @ da
        g["hidden"][:WIDTH] += last.T @ dh
        dx = ds.transpose(0, 2, 1) @ f["asked"]
        dx += weight.transpose(0, 2, 1) @ dc[:, :, :WIDTH]
        own = da @ t["ask_back"]
        own += dh @ t["own_back"]
        dx[:, -SCORED:] += own.reshape(size, SCORED, WIDTH)
        # Two neighbouring numbers are added as one complex number.
        two = np.dtype(f"c{2 * kind.itemsize}")
        np.add.at(g["embed"].reshape(-1).view(two), _CELLS.take(buckets, axis=0).reshape(-1), dx.reshape(-1).view(two))
        return loss

    def step(self, state: dict, windows: tuple[np.ndarray, ...], rate: float) -> float:
        """One Adam step along the mean gradient of some windows; ``state`` keeps the moments of the steps before."""
        loss, g = self.gradient(*windows)
        v = np.concatenate([g[k].reshape(-1) for k in sorted(self.p)])
        if not state:
            state |= {"steps": 0, "mean": np.zeros_like(v), "square": np.zeros_like(v)}
        state["steps"] += 1
        first, second = 1 - 0.9 ** state["steps"], 1 - 0.99 ** state["steps"]
        mean, square = state["mean"], state["square"]
        mean += 0.1 * (v - mean)
        square += 0.01 * (v * v - square)
        change, at = rate / first * mean / (np.sqrt(square / second) + 1e-6), 0
        for k in sorted(self.p):
            self.p[k] -= change[at : at + self.p[k].size].reshape(self.p[k].shape)
            at += self.p[k].size
        return loss

    def vector(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)])

    def set_vector(self, values: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = values[at : at + size].astype(np.float32).reshape(self.p[k].shape)
            at += size


#: A place sees itself and what lies before it.
_MASK = np.where(np.arange(WINDOW)[None] <= np.arange(SCORED)[:, None] + WINDOW - SCORED, 0, -1e9).astype(np.float32)


#: Places of each bucket's embedding among all, two numbers each.
_CELLS = np.arange(BUCKETS * WIDTH // 2).reshape(BUCKETS, WIDTH // 2)


def _exact(total: np.ndarray) -> bool:
    """Whether sums of exponentials lie in the range in which they are exact."""
    return not total.size or bool(1e-20 < total.min() and total.max() < 1e20)


def _shifted(logits: np.ndarray) -> np.ndarray:
    """Logits whose exponentials add up within the range in which they are exact: maxima are taken off only if they would not."""
    if logits.size and not (-40 < logits.min() and logits.max() < 40):
        logits -= logits.max(-1, keepdims=True)
    return logits


def windows(counts: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input places of the windows of texts with ``counts`` ids, one text after the other.

    Returns places (windows x WINDOW), which of them lie before or behind the window's text, and which of the scored places
    exist. Place i of the inputs stands before place i of the targets. ``keep`` says which windows are wanted, from the first scored place
    of each and the last place of its text.
    """
    number = -(-counts // SCORED)
    text = np.repeat(np.arange(len(counts)), number)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    start = np.cumsum(counts) - counts
    if keep is not None:
        wanted = keep(start[text] + turn * SCORED, start[text] + counts[text] - 1)
        text, turn = text[wanted], turn[wanted]
    inside = (turn * SCORED - (WINDOW - SCORED))[:, None] + np.arange(WINDOW)
    absent = (inside < 0) | (inside >= counts[text][:, None])
    return start[text][:, None] + np.clip(inside, 0, counts[text][:, None] - 1), absent & (inside < 0), ~absent[:, -SCORED:]


class Model:
    """Attention, buckets and classes of ids, and the counted parts of the distribution."""

    def __init__(self, bucket_of: np.ndarray, class_of: np.ndarray, attention: Attention):
        self.bucket_of, self.class_of, self.attention = bucket_of, class_of, attention
        self.bigram = self.id_log = None

    def set_counts(self, pairs: np.ndarray, ids: np.ndarray) -> None:
        """``pairs``: how often a bucket follows a bucket; ``ids``: how often each id (the last is the end) occurs."""
        same = np.zeros((CLASSES, BUCKETS))
        same[self.class_of, np.arange(BUCKETS)] = 1
        alone = pairs.sum(0) + 0.1
        alone /= (same.T @ (same @ alone))
        in_class = pairs @ same.T  # bucket before x class
        rate = (pairs + 8.0 * alone) / (in_class[:, self.class_of] + 8.0)
        self.bigram = np.log(rate).astype(np.float32)
        weight = ids + 0.05  # every id has some
        self.id_log = (np.log(weight) - np.log(np.bincount(self.bucket_of, weight, BUCKETS)[self.bucket_of])).astype(np.float32)

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each text; ``ids`` holds all texts' ids, ``counts`` how many each has (the end id with them)."""
        bucket = self.bucket_of[ids]
        before = np.concatenate(([_BEGIN], bucket[:-1]))
        before[np.cumsum(counts) - counts] = _BEGIN
        log = self.bigram[before, bucket] + self.id_log[ids]
        kind = self.class_of[bucket]
        places, absent, used = windows(counts)
        tables = self.attention.tables(SCORE_BATCH)
        for at in range(0, len(places), SCORE_BATCH):
            rows = slice(at, at + SCORE_BATCH)
            scored = places[rows][:, -SCORED:]
            value = self.attention.target_log(before[places[rows]], absent[rows], kind[scored], tables)
            log[scored[used[rows]]] += value[used[rows]]
        sums = np.add.reduceat(log.astype(np.float64), np.cumsum(counts) - counts) if len(counts) else np.zeros(0)
        return sums / np.log(10)


def buckets(counts: np.ndarray) -> np.ndarray:
    """Bucket of each id from its number; the last id is the end. Three quarters of the buckets have one frequent id each."""
    vocabulary = len(counts) - 1
    frequent = [i for i in np.argsort(-counts[:vocabulary], kind="stable")[: BUCKETS // 2 + BUCKETS // 4].tolist() if counts[i]]
    bucket_of = 2 + len(frequent) + np.arange(vocabulary + 1) % max(BUCKETS - 2 - len(frequent), 1)
    bucket_of[frequent] = 2 + np.arange(len(frequent))
    bucket_of[vocabulary] = 1
    return bucket_of


def classes(pairs: np.ndarray) -> np.ndarray:
    """Buckets that follow alike ones are one class: k-means on the left neighbours' counts (``pairs``: before x bucket)."""
    table = pairs.T.astype(np.float64)
    rows = np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1))
    weight = table.sum(1) + 1e-3
    centres = rows[np.argsort(-weight, kind="stable")[:CLASSES]].copy()
    for _ in range(25):
        kind = ((rows ** 2).sum(1)[:, None] - 2 * rows @ centres.T + (centres ** 2).sum(1)[None]).argmin(1)
        for c in range(CLASSES):
            mine = kind == c
            if mine.any():
                centres[c] = np.average(rows[mine], axis=0, weights=weight[mine])
    return kind


# --- the whole corpus --------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Stored ids of ``docs`` (text_id, text, train): text_id, train, ids (binary, 16 or 32 bits each)."""
    id_type = docs.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path, MEMO_CHUNKS)
        kind = "<u2" if encoder.vocabulary <= 65536 else "<u4"
        for batch in batches:
            for part in steps(batch):
                ids, counts = encoder.encode(part.column("text"))
                data = ids.astype(kind)
                ends = np.concatenate(([0], np.cumsum(counts))) * data.itemsize
                cells = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("text_id"), part.column("train"), cells.cast(pa.binary())], names=["text_id", "train", "ids"])

    return materialize(docs.select("text_id", "text", "train").mapInArrow(run, f"text_id {id_type}, train boolean, ids binary"))


def _kind(path: str) -> str:
    return "<u2" if library_encoder(path, MEMO_CHUNKS).vocabulary <= 65536 else "<u4"


def _texts(batch: pa.RecordBatch, kind: str, end: int, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of stored ids with their ids, each text closed by ``end``."""
    for part in steps(batch, "ids", limit):
        cells = part.column("ids").cast(pa.large_binary())
        offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
        data = cells.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind).astype(np.int64) if data else np.zeros(0, np.int64)
        counts = np.diff(offsets) // np.dtype(kind).itemsize
        yield part, np.insert(flat, np.cumsum(counts), end), counts + 1


#: Pieces of a table that are added up separately, and groups of tasks whose tables are added first.
_PIECES, _TASK_GROUPS = 16, 64


def summed(training: DataFrame, length: int, kind: str, table_of) -> np.ndarray:
    """Sum over tasks of the table that ``table_of`` makes of a task's batches, ``length`` numbers of one kind.

    Tables are cut into pieces and added in two levels; the driver gets one table.
    """
    piece = -(-length // _PIECES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(_PIECES * piece, kind)
        table[:length] = table_of(batches)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_PIECES), pa.int32()), pa.array([step_key(0) >> 32] * _PIECES, pa.int64()),
             pa.array([r.tobytes() for r in table.reshape(_PIECES, piece)], pa.binary())], names=["piece", "task", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(piece, kind)
        for cell in group.sort_by("task")["counts"]:
            total += np.frombuffer(cell.as_py(), kind)
        return pa.table({"piece": pa.array([group["piece"][0].as_py()], pa.int32()), "task": pa.array([group["task"][0].as_py()], pa.int64()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, task long, counts binary"
    tables = training.select("ids").mapInArrow(count, schema)
    grouped = tables.groupBy("piece", F.pmod("task", F.lit(_TASK_GROUPS))).applyInArrow(add, schema)
    rows = grouped.groupBy("piece").applyInArrow(add, schema).collect()  # _PIECES rows of fixed size
    table = np.zeros(_PIECES * piece, kind)
    for row in rows:
        table[row.piece * piece : (row.piece + 1) * piece] = np.frombuffer(bytes(row.counts), kind)
    return table[:length]


def id_counts(training: DataFrame, vocabulary: int, kind: str) -> np.ndarray:
    """How often each id occurs in the training texts; the last one is the end."""

    def table_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(vocabulary + 1, np.int64)
        for batch in batches:
            for _, ids, _ in _texts(batch, kind, vocabulary):
                table += np.bincount(ids, minlength=vocabulary + 1)
        return table

    return summed(training, vocabulary + 1, "<i8", table_of)


def _before(bucket: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bucket before each place of texts that follow each other."""
    before = np.concatenate(([_BEGIN], bucket[:-1]))
    before[np.cumsum(counts) - counts] = _BEGIN
    return before


def pair_counts(training: DataFrame, bucket_of: np.ndarray, kind: str) -> np.ndarray:
    """How often a bucket (column) follows a bucket (row) in the training texts."""
    end = len(bucket_of) - 1

    def table_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(BUCKETS * BUCKETS, np.int64)
        for batch in batches:
            for _, ids, counts in _texts(batch, kind, end):
                bucket = bucket_of[ids]
                table += np.bincount(_before(bucket, counts) * BUCKETS + bucket, minlength=BUCKETS * BUCKETS)
        return table

    return summed(training, BUCKETS * BUCKETS, "<i8", table_of).reshape(BUCKETS, BUCKETS)


def chosen_windows(ids: np.ndarray, counts: np.ndarray, turn: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``windows`` of texts whose hash is the round's; ``every`` rounds take each window once.

    The hash is that of the window's first scored ids, so no depth of a text is preferred and the result doesn't depend on how texts are dealt out.
    """

    def keep(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        hashed = np.zeros(len(first), np.uint64)
        for k in range(_HASHED_IDS):
            hashed = mixed(hashed + ids[np.minimum(first + k, last)].astype(np.uint64) + np.uint64(1))
        return hashed % np.uint64(every) == np.uint64(turn % every)

    return windows(counts, keep)


def trained_round(training: DataFrame, model: Model, kind: str, turn: int, rounds: int, every: int) -> Attention:
    """The average of the weights that all tasks reach in a round."""
    bucket_of, class_of, weights = model.bucket_of, model.class_of, model.attention.vector()
    end = len(bucket_of) - 1
    rate = 0.01 * (1 - 0.9 * turn / rounds)

    def table_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        attention, state, rng = Attention(), {}, np.random.default_rng(turn)
        attention.set_vector(weights)
        number = steps_made = 0
        kept: list[tuple[np.ndarray, ...]] = []

        def walk(parts: tuple[np.ndarray, ...]) -> None:
            nonlocal steps_made
            order = rng.permutation(len(parts[0]))
            for at in range(0, len(order), BATCH):
                attention.step(state, tuple(x[order[at : at + BATCH]] for x in parts), rate)
                steps_made += 1

        for batch in batches:
            for _, ids, counts in _texts(batch, kind, end):
                places, absent, used = chosen_windows(ids, counts, turn, every)
                if not len(places):
                    continue
                # Buckets are looked up at the chosen places only.
                opens = np.zeros(len(ids), bool)
                opens[np.cumsum(counts) - counts] = True
                inputs = np.where(opens[places], _BEGIN, bucket_of[ids[places - 1]])
                parts = (inputs, absent, class_of[bucket_of[ids[places[:, -SCORED:]]]], used)
                number += len(places)
                walk(parts)
                if steps_made < LEAST_STEPS:  # a task with more windows never needs them again
                    kept.append(parts)
        if number and steps_made < LEAST_STEPS:
            again = tuple(np.concatenate(x) for x in zip(*kept))
            while steps_made < LEAST_STEPS:
                walk(again)
        return np.append(attention.vector().astype(np.float64) * number, number)

    total = summed(training, len(weights) + 1, "<f8", table_of)
    out = Attention()
    if total[-1]:
        out.set_vector(total[:-1] / total[-1])
    else:
        out.set_vector(weights)
    return out


def fit(stored: DataFrame, path: str, rounds: int = ROUNDS, every: int | None = None) -> Model:
    """Buckets, classes, counts and attention from all training texts of ``stored`` (train, ids).

    A round takes one window in ``every``; the rounds share all windows unless it is given.
    """
    every = rounds if every is None else every
    vocabulary, kind = library_encoder(path, MEMO_CHUNKS).vocabulary, _kind(path)
    training = stored.filter("train")
    ids = id_counts(training, vocabulary, kind)
    bucket_of = buckets(ids)
    pairs = pair_counts(training, bucket_of, kind)
    model = Model(bucket_of, classes(pairs), Attention())
    model.set_counts(pairs, ids)
    for turn in range(rounds):
        model.attention = trained_round(training, model, kind, turn, rounds, every)
    return model


def attention_scores(stored: DataFrame, model: Model, path: str) -> DataFrame:
    """text_id, model_score (log10) of stored texts; one pass, no shuffle."""
    kind, end = _kind(path), len(model.bucket_of) - 1
    id_type = stored.schema["text_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, counts in _texts(batch, kind, end):
                yield pa.RecordBatch.from_arrays(
                    [part.column("text_id"), pa.array(model.scores(ids, counts))], names=["text_id", "model_score"])

    return stored.select("text_id", "ids").mapInArrow(run, f"text_id {id_type}, model_score double")


def score(docs: DataFrame, training: Column, path: str) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, mixed_score of every row of ``docs`` (doc_id, text)."""
    # Rows with the same id and text have the same scores, so both parts meet by these two.
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("text_id"), "text",
                       F.coalesce(training, F.lit(False)).alias("train"))
    stored = encoded(rows, path)
    model = fit(stored, path)
    by_words = word_scores(rows)
    scored = attention_scores(stored, model, path).select(F.col("text_id").alias("__id"), "model_score").groupBy("__id").agg(
        F.max("model_score").alias("score"))
    both = by_words.join(scored, by_words["text_id"].eqNullSafe(scored["__id"]))
    high, low = F.greatest("base_score", "score"), F.least("base_score", "score")
    mixture = high + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), low - high)) - float(np.log10(2.0))
    return both.select("text_id.doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", mixture.alias("mixed_score"))
