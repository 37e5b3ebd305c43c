"""Signatures, groups, components, tiles, bit slices, mixing and the attention model on small inputs."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from handbook_spark.llm import bit_sliced, grid, lm_scoring, mixing, neighbours, part_enum
from handbook_spark.llm.components import components
from tests.llm import brute


def similar(rng, size):
    base = rng.choice(1 << 62, size, replace=False)
    least = int(np.ceil(0.75 * size))
    # |r n s| / |r u s| >= 3 / 4 with any split of what differs.
    drop = rng.integers(0, size - least + 1)
    add = int((size - drop) / 0.75) - size
    other = np.concatenate((base[drop:], rng.choice(1 << 62, rng.integers(0, max(add, 0) + 1), replace=False)))
    return np.sort(base).astype(np.uint64), np.unique(other).astype(np.uint64)


def test_similar_sets_share_more_signatures_than_they_may_ignore():
    rng = np.random.default_rng(1)
    starts = part_enum.bands(2000)
    for size in [1, 2, 3, 4, 5, 7, 9, 14, 20, 37, 80, 150, 400] * 12:
        a, b = similar(rng, size)
        same = len(np.intersect1d(a, b))
        if 100 * same < 75 * (len(a) + len(b) - same):
            continue
        left = {s: (spare, set(f.tolist())) for s, spare, f in part_enum.signatures(a, starts)}
        right = {s: (spare, set(f.tolist())) for s, spare, f in part_enum.signatures(b, starts)}
        assert any(len(left[s][1] & right[s][1]) > max(left[s][0], right[s][0]) for s in left.keys() & right.keys())


def test_bands_are_wide_enough():
    starts = part_enum.bands(5000)
    for small in range(1, 3700):
        large = small * 4 // 3
        assert np.searchsorted(starts, large, "right") - np.searchsorted(starts, small, "right") <= 1


def test_common_elements():
    rng = np.random.default_rng(1)
    for high in (50, 2000, 100000):
        left, right = ([np.unique(rng.integers(0, high, rng.integers(1, 150))) for _ in range(n)] for n in (30, 40))
        want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
        assert (part_enum.common(left, right, 64) == want).all()


def test_large_near_copy_groups(spark, monkeypatch):
    """A large group around one text, a passage that many texts share, and copies; blocks of a few sets."""
    monkeypatch.setattr(part_enum, "BLOCK_SETS", 16)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(70):
        text = list(base)
        for _ in range(rng.randint(0, 5)):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    for i in range(70, 140):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 15, 30]))]
        rows.append((i, " ".join(own + passage)))
    rows += [(i, rows[i % 7][1]) for i in range(140, 170)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in part_enum.near_copies(frame).collect()}
    assert found == brute.components(rows)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_tile_bounds_keep_the_nearest():
    rng = np.random.default_rng(4)
    vectors, others = rng.standard_normal((40, 16)), rng.standard_normal((500, 16))
    cosine = vectors @ others.T / np.linalg.norm(vectors, axis=1)[:, None] / np.linalg.norm(others, axis=1)
    ids, found, scores = neighbours.tile(list(range(1000, 1040)), vectors, [[i] for i in range(500)], others, 5)
    for row in range(40):
        mine = sorted((-s, f) for i, f, s in zip(ids, found, scores) if i == 1000 + row)
        assert [f for _, f in mine] == np.argsort(-cosine[row])[:5].tolist()


def test_rounding_error_is_bounded():
    rng = np.random.default_rng(5)
    unit = rng.standard_normal((50, 24))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes, scale, error = neighbours.rounded(unit)
    near = neighbours.products(codes, codes) * scale[:, None] * scale
    assert (np.abs(near - unit @ unit.T) <= (1 + error)[:, None] * error + error[:, None] + 1e-6).all()


@pytest.mark.parametrize("high", [1, 3, 200, 70000])
def test_slice_sums_are_inner_products(high):
    rng = np.random.default_rng(high)
    values, queries = rng.integers(-high, high + 1, (130, 7)), rng.integers(-high, high + 1, (5, 7))
    index = bit_sliced.Slices(values)
    sums = index.sums(queries)
    bits = np.stack([np.unpackbits(s.view(np.uint8), axis=1, bitorder="little")[:, :130] for s in sums]).astype(object)
    total = sum(bits[b] * (1 << b) for b in range(len(sums)))
    exact = queries.astype(object) @ values.T.astype(object)
    shift = exact - total  # one constant per query
    assert all(len(set(row)) == 1 for row in shift.tolist())


def test_slices_find_the_top_rows_with_ties():
    values = np.array([[1, 0], [2, 0], [2, 0], [0, 5], [-3, 1], [2, 0]])
    ids, found, scores = bit_sliced.tile([7, 9], np.array([[1, 0], [0, 0]]), [[i] for i in range(6)], values, 2)
    assert list(zip(ids, found, scores)) == [(7, 1, 2), (7, 2, 2), (9, 0, 0), (9, 1, 0)]


def test_copies_keep_the_smallest_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(500, [0.0, 1.0])]
    found = {tuple(r.vector): r.ids for r in grid.candidates(spark.createDataFrame(rows, "id long, vector array<float>"), 5).collect()}
    assert found == {(1.0, 0.0): [0, 1, 2, 3, 4, 5], (0.0, 1.0): [500]}


def test_targets_stop_at_twice_the_size(spark):
    sizes = {"a": 10, "b": 1000, "c": 30, "d": 5, None: 400}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = brute.mix_targets(sizes)
    assert all(found[s] == pytest.approx(want[s]) for s in sizes)


def test_mix_is_in_proportion_at_any_moment(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 16)
    rows = [(i, f"s{i % 3}", 1 + i % 9) for i in range(600)]
    served = mixing.served(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    mix = sorted(mixing.mix(served).collect(), key=lambda r: r.position)
    at, given = 0, {}
    for r in mix:
        assert r.position == at
        at += r.taken
        given[r.source] = given.get(r.source, 0) + r.taken
        assert given[r.source] <= r.target + 1
        if at > 1500:
            assert abs(given[r.source] / r.target - at / r.budget) < 0.05
    assert abs(at - 1.5 * sum(r[2] for r in rows)) <= 3


def test_mixed_documents_repeat_rows(spark):
    rows = [(i, "one two three four", "s0", i) for i in range(40)] + [(i, "five six", "s1", i) for i in range(40, 50)] + [(49, "five six", "s1", 49)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, finish int")
    found = mixing.mixed_documents(frame).collect()
    assert sum(len(r.text.split()) for r in found) == round(1.5 * sum(len(r[1].split()) for r in rows))
    assert frame.columns == mixing.mixed_documents(frame).columns
    assert max(sum(1 for r in found if r.doc_id == i) for i in range(40)) <= 2


def test_first_words(spark):
    row = spark.range(1).select(mixing.first_words(F.lit(" a\tb\n c  d"), F.lit(3)).alias("t")).first()
    assert row.t == "a b c"


def test_windows_score_each_place_once():
    counts = np.array([1, 24, 25, 60, 3])
    places, absent, used = lm_scoring.windows(counts)
    scored = places[:, -lm_scoring.SCORED:][used]
    assert sorted(scored.tolist()) == list(range(counts.sum()))
    assert not absent[:, -lm_scoring.SCORED:][used].any()


def test_attention_gradient_and_causality():
    rng = np.random.default_rng(2)
    model = lm_scoring.Attention()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    counts = np.array([40, 30])
    bucket = rng.integers(0, lm_scoring.BUCKETS, 70)
    places, absent, used = lm_scoring.windows(counts)
    targets = rng.integers(0, lm_scoring.CLASSES, (len(places), lm_scoring.SCORED))
    _, gradient = model.gradient(bucket[places], absent, targets, used)
    for name, value in model.p.items():
        at = np.unravel_index(np.abs(gradient[name]).argmax(), value.shape)
        kept, losses = value[at], []
        for change in (1e-4, -1e-4):
            value[at] = kept + change
            losses.append(model.gradient(bucket[places], absent, targets, used)[0])
        value[at] = kept
        assert gradient[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, rel=1e-3)
    before = model.target_log(bucket[places], absent, targets)
    assert np.allclose(before, np.take_along_axis(model.forward(bucket[places], absent)["log"].reshape(
        len(places), lm_scoring.SCORED, -1), targets[:, :, None], 2)[:, :, 0])
    later = bucket.copy()
    later[20] = (later[20] + 1) % lm_scoring.BUCKETS
    after = model.target_log(later[places], absent, targets)
    assert np.allclose(before[0][:20], after[0][:20]) and not np.allclose(before[0][20], after[0][20])


def test_large_weights_do_not_overflow():
    """Attention scores and logits beyond what an exponential holds: log probabilities and gradient stay those of a slow scorer."""
    rng = np.random.default_rng(8)
    model = small_model()
    model.attention.p["place"] = (rng.standard_normal((lm_scoring.SCORED, lm_scoring.WINDOW)) * 200).astype(np.float32)
    model.attention.p["out_add"] = (rng.standard_normal(lm_scoring.CLASSES) * 60).astype(np.float32)
    texts = [rng.integers(0, 701, n) for n in (3, 24, 70)]
    found = model.scores(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert found == pytest.approx([brute.language_model_score(model, t.tolist()) for t in texts], rel=1e-4)
    places, absent, used = lm_scoring.windows(np.array([len(texts[2])]))
    bucket = model.bucket_of[texts[2]]
    _, gradient = model.attention.gradient(bucket[places], absent, model.class_of[bucket][places[:, -lm_scoring.SCORED:]], used)
    assert all(np.isfinite(v).all() for v in gradient.values())


def test_places_look_products_up_by_bucket():
    """The embeddings are multiplied once per step and bucket: a step's products with them do not grow with its windows."""
    model, rows = lm_scoring.Attention(), []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            rows.append(len(self))
            return np.asarray(self) @ np.asarray(other)

        def take(self, *args, **kwargs):
            return np.asarray(self).take(*args, **kwargs).view(Counted)

        def __getitem__(self, key):
            return np.asarray(self)[key].view(Counted)

    model.p["embed"] = model.p["embed"].view(Counted)
    rng = np.random.default_rng(9)
    windows = (rng.integers(0, lm_scoring.BUCKETS, (200, lm_scoring.WINDOW)), np.zeros((200, lm_scoring.WINDOW), bool),
               rng.integers(0, lm_scoring.CLASSES, (200, lm_scoring.SCORED)), np.ones((200, lm_scoring.SCORED), bool))
    model.target_log(*windows[:3])
    assert rows == [lm_scoring.BUCKETS] * len(rows) and rows


def small_model(vocabulary: int = 700) -> lm_scoring.Model:
    rng = np.random.default_rng(3)
    ids = np.bincount(rng.integers(0, 50, 1200), minlength=vocabulary + 1)
    ids[vocabulary] = 20
    pairs = rng.integers(0, 5, (lm_scoring.BUCKETS, lm_scoring.BUCKETS))
    pairs[:, 0] = 0  # nothing is followed by the beginning
    model = lm_scoring.Model(lm_scoring.buckets(ids), lm_scoring.classes(pairs), lm_scoring.Attention())
    model.set_counts(pairs, ids)
    return model


def test_model_is_a_distribution_over_ids():
    model, vocabulary = small_model(), 700
    # The probabilities of all ids at the second place of a text add up to one.
    start = 4
    totals = 0.0
    for last in range(vocabulary + 1):
        pair = np.array([start, last])
        totals += 10 ** (model.scores(pair, np.array([2]))[0] - model.scores(pair[:1], np.array([1]))[0])
    assert totals == pytest.approx(1, abs=1e-3)


def test_scores_equal_a_slow_scorer():
    model, rng = small_model(), np.random.default_rng(4)
    model.attention.p["place"] = rng.standard_normal((lm_scoring.SCORED, lm_scoring.WINDOW)).astype(np.float32)
    texts = [rng.integers(0, 701, n) for n in (1, 2, 23, 24, 25, 49, 130)]
    found = model.scores(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert found == pytest.approx([brute.language_model_score(model, t.tolist()) for t in texts], abs=1e-4)


def test_training_lowers_the_loss():
    pattern = np.tile([2, 3, 4, 5, 6], 60)
    counts = np.array([len(pattern)])
    places, absent, used = lm_scoring.windows(counts)
    before = np.concatenate(([0], pattern[:-1]))
    targets = (pattern % lm_scoring.CLASSES)[places[:, -lm_scoring.SCORED:]]
    attention, state = lm_scoring.Attention(), {}
    losses = [attention.step(state, (before[places], absent, targets, used), 0.01) for _ in range(60)]
    assert losses[-1] < losses[0] / 2
    again = lm_scoring.Attention()
    again.set_vector(attention.vector())
    assert all(np.array_equal(again.p[k], v) for k, v in attention.p.items())


def test_rounds_take_every_window_of_a_text_once():
    rng = np.random.default_rng(6)
    counts = np.array([5000, 1, 37, 24])
    ids = rng.integers(0, 30_000, counts.sum())
    taken = []
    for turn in range(7):
        places, _, used = lm_scoring.chosen_windows(ids, counts, turn, 7)
        assert len(places) > 10  # of 213 windows, at any depth of the text
        taken += places[:, -lm_scoring.SCORED:][used].tolist()
    assert sorted(taken) == list(range(counts.sum()))


def test_model_learns_from_all_training_texts(spark):
    """Counts equal plain ones, deep places count, and the trained weights predict better than untrained ones."""
    rng = np.random.default_rng(7)
    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["red", "blue", "green", "dog", "cat", "bird", "runs", "sleeps"]
    # A colour decides the verb two words later, which neither the word before nor frequencies can tell.

    def phrase(colour: int, animal: int) -> str:
        return f"{words[colour]} {words[3 + animal]} {words[6 + (colour == 0)]}"

    lines = [" ".join(phrase(*map(int, rng.integers(0, 3, 2))) for _ in range(300)) for _ in range(40)]
    rows = [(i, t, i % 4 != 0) for i, t in enumerate(lines)] + [(100, "dog " * 3000 + "zebra zebra", True), (101, None, True)]
    docs = spark.createDataFrame(rows, "text_id long, text string, train boolean").repartition(3)
    stored = lm_scoring.encoded(docs, path)
    model = lm_scoring.fit(stored, path, rounds=3, every=2)
    encoder = brute.Tokenizers().word
    texts = [[*encoder.encode(t or "", add_special_tokens=False).ids] for _, t, train in rows if train]
    vocabulary = len(model.bucket_of) - 1
    want = np.bincount(np.concatenate([[*t, vocabulary] for t in texts]).astype(int), minlength=vocabulary + 1)
    training = stored.filter("train")
    assert np.array_equal(lm_scoring.id_counts(training, vocabulary, lm_scoring._kind(path)), want)
    pairs = np.zeros((lm_scoring.BUCKETS, lm_scoring.BUCKETS), int)
    for t in texts:
        row = [0, *model.bucket_of[[*t, vocabulary]].tolist()]
        for a, b in zip(row, row[1:]):
            pairs[a, b] += 1
    assert np.array_equal(lm_scoring.pair_counts(training, model.bucket_of, lm_scoring._kind(path)), pairs)
    plain = lm_scoring.Model(model.bucket_of, model.class_of, lm_scoring.Attention())
    plain.set_counts(pairs, want)
    held_out = [np.array([*encoder.encode(t, add_special_tokens=False).ids, vocabulary]) for i, t, train in rows if not train]
    flat, counts = np.concatenate(held_out), np.array([len(t) for t in held_out])
    assert model.scores(flat, counts).sum() > 0.8 * plain.scores(flat, counts).sum()


def test_training_steps_along_every_window(spark, monkeypatch):
    """The rounds of the query's own settings share all windows of the training texts, each taken once."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, " ".join(f"n{i * 5000 + j}" for j in range(900)), True) for i in range(5)], "text_id long, text string, train boolean")
    stored = lm_scoring.encoded(docs, path)
    counts = np.array([len(r.ids) // 2 + 1 for r in stored.collect()])
    used, trained = [], lm_scoring.trained_round

    def round_of(training, model, kind, turn, rounds, every):
        for r in training.collect():
            ids = np.append(np.frombuffer(bytes(r.ids), kind).astype(np.int64), len(model.bucket_of) - 1)
            places, _, present = lm_scoring.chosen_windows(ids, np.array([len(ids)]), turn, every)
            used.extend((r.text_id, p) for p in places[:, -lm_scoring.SCORED:][present].tolist())
        return trained(training, model, kind, turn, rounds, every)

    monkeypatch.setattr(lm_scoring, "trained_round", round_of)
    lm_scoring.fit(stored, path)
    assert len(used) == len(set(used)) == counts.sum()


def test_training_grows_with_the_corpus(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    steps = []
    for number in (2, 8):
        docs = spark.createDataFrame([(i, f"start {i} " + " ".join(f"n{i * 5000 + j}" for j in range(9000)), True) for i in range(number)],
                                     "text_id long, text string, train boolean").coalesce(1)
        stored = lm_scoring.encoded(docs, path)
        total = sum(len(lm_scoring.chosen_windows(np.frombuffer(bytes(r.ids), lm_scoring._kind(path)).astype(np.int64), np.array([len(r.ids) // 2]), t, 12)[0])
                    for r in stored.collect() for t in range(lm_scoring.ROUNDS))
        steps.append(total)
    assert 3 < steps[1] / steps[0] < 5
