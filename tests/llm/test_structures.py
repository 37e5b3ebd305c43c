"""Line boundaries, piece agendas and the conversation trie against plain Python and the library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from handbook_spark.llm import fill_middle, piece_bpe, prefix_trie, queries
from tests.llm import brute
from tests.llm.conftest import odd_conversations

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def offsets(kind: str, rng: np.random.Generator) -> np.ndarray:
    if kind == "array":
        return np.unique(rng.integers(0, 1 << 16, 900))
    if kind == "bitmap":
        return np.unique(rng.integers(0, 1 << 16, 30_000))
    if kind == "runs":
        return np.concatenate([np.arange(a, a + 1500) for a in range(0, 1 << 16, 3000)])
    if kind == "full":
        return np.arange(1 << 16)
    return np.unique(np.concatenate([offsets(k, rng) + (n << 16) for n, k in ((0, "runs"), (1, "bitmap"), (3, "array"), (70, "full"), (71, "bitmap"))]))


@pytest.mark.parametrize("kind, made", [
    ("array", fill_middle.ArrayContainer), ("bitmap", fill_middle.BitmapContainer), ("runs", fill_middle.RunContainer),
    ("full", fill_middle.RunContainer), ("mixed", None)])
def test_select_in_every_container(kind, made):
    values = offsets(kind, np.random.default_rng(3))
    cuts = fill_middle.BoundarySet(values)
    assert made is None or [type(c) for c in cuts.containers] == [made]
    assert len(cuts) == len(values)
    for k in {0, len(values) - 1, *np.random.default_rng(4).integers(0, len(values), 3000).tolist()}:
        assert cuts.select(k) == values[k]
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            cuts.select(k)


def test_containers_are_the_smallest():
    assert isinstance(fill_middle.container(np.arange(3)), fill_middle.ArrayContainer)  # 6 bytes either way
    assert isinstance(fill_middle.container(np.arange(4)), fill_middle.RunContainer)
    assert isinstance(fill_middle.container(np.arange(0, 8192, 2)), fill_middle.ArrayContainer)
    assert isinstance(fill_middle.container(np.arange(0, 8194, 2)), fill_middle.BitmapContainer)


def test_boundaries_of_sliced_columns():
    texts = pa.array(["x", None, "", "ä\nb", "\n\n", "日本\n語\n"]).slice(1)
    assert [b.tolist() for b in fill_middle.boundaries(texts)] == [[0], [0], [0, 2, 3], [0, 1, 2], [0, 3, 5]]


def fim_texts() -> list[tuple]:
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "ä", "😀", "\n", "<P", ">", "<", "S>", " ", "M", "\r\n"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a <P> b\n", "<S>", "x<M>", None, "", "\n" * 70_000, "\n".join("ab" * (i % 9) for i in range(30_000)), "long " * 100_000]
    return list(enumerate(texts)) + [(None, "no id\nat all"), (5, "same id"), (5, "same id")]


def test_fill_in_middle_equals_brute_force_and_is_undone(spark):
    rows = fim_texts()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, output string").repartition(4)
    made = fill_middle.fill_in_middle(docs, "doc_id").withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    texts = sorted((r.doc_id is not None, r.doc_id or 0, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output, r.back) for r in made)
    want = []
    for i, text in rows:
        n, form, prefix, middle, output = brute.filled_in_middle(i, text)
        want.append((i is not None, i or 0, n, form, prefix or 0, middle or 0, output, text or ""))
    assert texts == sorted(want)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_rates_of_fill_in_middle(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(2000)], "doc_id long, text string")
    forms = {r.form: r.n for r in fill_middle.fill_in_middle(docs, "doc_id", percent=40, spm_percent=10).groupBy("form").agg(F.count("*").alias("n")).collect()}
    assert 1100 < forms["plain"] < 1300 and 30 < forms["spm"] < 130


def test_op11_odd_rows(spark, odd_dir, odd_rows):
    found = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output_sha256, r.restored_sha256)
                   for r in queries.queries()["op11_fill_in_middle"](spark, odd_dir).collect())
    want = []
    for i, text in odd_rows:
        n, form, prefix, middle, output = brute.filled_in_middle(i, text)
        want.append((str(i), n, form, str(prefix), str(middle), hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want)


ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "你", "😀", "the", " the", "1", "\xa0", "　", "\x00", "�", "ing", "<s>", "</s>",
            "<0x41>", "<unk>", "\r\n", "́", ".", ","]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ALPHABET), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_agenda_equals_the_library(text):
    encoder = piece_bpe.batch_encoder(PIECES)
    ids, counts = encoder.encode(pa.array([text, None, text]))
    want = encoder.library.encode(text, add_eos=True)
    assert ids.tolist() == [*want, 2, *want] and counts.tolist() == [len(want), 1, len(want)]
    assert encoder.pieces.decode(np.array(want)).decode() == encoder.library.decode(want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 259, 260, 28705]), st.integers(3, 258), st.integers(259, 31_999)), max_size=12))
def test_any_ids_decode_like_the_library(ids):
    encoder = piece_bpe.batch_encoder(PIECES)
    assert encoder.pieces.decode(np.array(ids, np.int64)).decode() == encoder.library.decode(ids)


def test_long_chunks_and_small_memo(library):
    texts = ["x" * 5000, " " * 5000, "ab" * 3000 + "  " * 20, "the quick brown fox " * 50]
    encoder = piece_bpe.BatchEncoder(piece_bpe.load(PIECES))
    encoder.limit = 3  # starts anew all the time
    for text in texts:
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_eos=True)


def test_a_difference_from_the_library_is_an_error():
    pieces = piece_bpe.Pieces(PIECES)
    pieces.pair.clear()  # nothing merges
    with pytest.raises(AssertionError, match="differ"):
        piece_bpe.BatchEncoder(pieces).encode(pa.array(["the thing"]))


def test_op12_odd_rows_and_whole_texts(spark, odd_dir, odd_rows, library):
    def want(text):
        ids = library.encode(text or "", add_eos=True)
        return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())

    query = queries.queries()["op12_sentence_piece"]
    found = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in query(spark, odd_dir).collect())
    assert found == sorted((str(i), *want(t)) for i, t in odd_rows)
    small = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in query(spark, small).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(texts[r.doc_id])


def test_ids_and_texts_of_pieces(spark):
    texts = ["a b", "", None, "  two\n", "日本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = piece_bpe.encode_documents(docs, PIECES, "doc_id")
    assert {r.doc_id: r.text for r in piece_bpe.decode_ids(encoded, PIECES, "doc_id").collect()} == {i: t or "" for i, t in enumerate(texts)}


def found_trie(frame) -> list[tuple]:
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
                   for r in frame.collect()), key=str)


def test_op13_odd_rows(spark, odd_dir):
    rows = [r[:4] for r in odd_conversations()]
    assert found_trie(queries.queries()["op13_prefix_trie"](spark, odd_dir)) == sorted(brute.trie(rows), key=str)


@pytest.mark.parametrize("block_turns", [1, 7, 60])
def test_prefixes_that_go_on_in_other_blocks(spark, block_turns):
    rows = [r[:4] for r in odd_conversations()]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found_trie(prefix_trie.trie(turns, block_turns)) == sorted(brute.trie(rows), key=str)


def test_one_block_equals_brute_force_on_random_sequences(spark):
    """Blocks as the operator cuts them, put together as it does, without its rebuilding."""
    rng = random.Random(8)
    rows = []
    for c in range(0, 4000, 20):  # first members of families keep their own turns
        rows += [(c, t, "u", rng.choice(["x", "y y"])) for t in range(rng.randint(1, 9))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for block_turns in (25, prefix_trie.BLOCK_TURNS):
        assert found_trie(prefix_trie.trie(turns, block_turns)) == sorted(brute.trie(rows), key=str)


def test_end_lists_of_many_copies(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(0, 20 * 3000, 20) for t in range(2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert found_trie(prefix_trie.trie(turns, 100)) == sorted(brute.trie(rows), key=str)


def test_range_minima_are_searched_in_both_directions():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 6, 300)
    table = prefix_trie.RangeMinimum(values)
    at, least = rng.integers(0, 300, 500), rng.integers(0, 7, 500)
    for a, d, left, right in zip(at, least, table.left(at, least), table.right(at, least)):
        low = high = a
        while low > 0 and values[low] >= d:
            low -= 1
        while high < 299 and values[high + 1] >= d:
            high += 1
        assert (left, right) == (low, high)
    last = np.minimum(at + rng.integers(0, 50, 500), 299)
    assert table.minimum(at, last).tolist() == [values[a : b + 1].min() for a, b in zip(at, last)]
