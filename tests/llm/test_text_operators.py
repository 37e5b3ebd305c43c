"""Encoders, grammar blocks, secrets, language sizes and the string kernel on small inputs."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from handbook_spark.llm import byte_bpe, language, secrets, token_files, toxicity, words

ALPHABET = [*"ab cdeé'sl ltrvmd \n\t  ß漢字12½٣  \x1c\x85!?😀́", "<|endoftext|>", "  ", "'ll", "'re"]


@pytest.fixture(scope="module")
def merges():
    return byte_bpe.load(public_tokenizers.path("byte_bpe_50k.json"))


def texts(seed: int, number: int, most: int = 60) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(number)]


def test_columns_encode_like_the_library(merges, tokenizers_brute):
    rows = [*texts(1, 800), "a" * 500, "-" * 700, " " * 300, "the" * 200 + "  " + "ing" * 200, None]
    ids, counts = byte_bpe.BatchEncoder(merges).encode(pa.array(rows))
    ends = np.cumsum(counts)
    for row, end, count in zip(rows, ends, counts):
        assert ids[end - count : end].tolist() == tokenizers_brute.byte.encode(row or "", add_special_tokens=False).ids


def test_transducer_in_small_parts(merges, tokenizers_brute):
    rng = random.Random(3)
    rows = [*texts(2, 150), "z" * 3000 + "'s " + "9" * 4000 + " " * 900 + "-" * 5000 + "<|endoftext|>" + "e" * 900, " " * 2000]
    for text in rows:
        machine, out, at = byte_bpe.Transducer(merges, rng.choice([40, 90, 300])), [], 0
        while at < len(text):
            step = rng.randint(1, 90)
            out += machine.feed(text[at : at + step])
            at += step
        out += machine.finish()
        assert out == tokenizers_brute.byte.encode(text, add_special_tokens=False).ids
        decoder = byte_bpe.TextMachine(merges)
        parts = [decoder.feed(np.array(out[i : i + 2], np.int64)) for i in range(0, len(out), 2)]
        assert "".join(parts) + decoder.finish() == text


def test_tokens_behind_the_lookahead_are_final(merges):
    rng = random.Random(8)
    for _ in range(60):
        data = "".join(rng.choice(["e", "t", "th", "in", "ing", "-", "=", "a", "er"]) for _ in range(260)).encode()
        cut = rng.randint(150, len(data) - 1)
        whole, part = merges.encode_window(data), merges.encode_window(data[:cut])
        end = 0
        for mine, other in zip(part, whole):
            end += len(merges.bytes[mine])
            if end > cut - merges.lookahead:
                break
            assert mine == other


def test_lookahead_of_a_merge_list():
    # a b c d with ab < bc < cd: a d behind abc takes c, so bc falls apart and b can go to a.
    assert byte_bpe.sufficient_lookahead([], [0, 1], {0: 1, 1: 1}) == 0
    assert byte_bpe.sufficient_lookahead([(2, 3, 4), (1, 2, 5), (0, 1, 6)], [0, 1, 2, 3], {i: 1 for i in range(4)} | {4: 2, 5: 2, 6: 2}) == 3


def test_machine_replaces_broken_bytes(merges):
    broken = [merges.single[0xC3], merges.single[0x28], merges.single[0xE2], merges.single[0x82]]
    machine = byte_bpe.TextMachine(merges)
    assert "".join(machine.feed(np.array([i], np.int64)) for i in broken) + machine.finish() == "�(�"


@pytest.mark.parametrize("ids, counts", [
    ([], [0, 0]), ([2], [1]), ([5] * 100, [0, 40, 0, 60, 0]), ([1, 2] * 500 + [3], [1001]), (list(range(300)) * 4, [700, 500])])
def test_blocks_round_trip(ids, counts):
    block = token_files.Block(token_files.pack(np.array(ids, np.int32), np.array(counts), 49408))
    assert block.ids().tolist() == ids
    ends = np.cumsum([0, *counts])
    for row in range(len(counts)):
        assert block.document(row).tolist() == ids[ends[row] : ends[row + 1]]
    for a, b in ((0, 0), (3, 17), (39, 41), (0, len(ids) + 5)):
        assert block.slice(a, b).tolist() == ids[a:b]


def test_repeated_ids_become_rules():
    rng = np.random.default_rng(0)
    phrase = rng.integers(0, 40000, 50)
    ids = np.concatenate([np.concatenate((phrase, rng.integers(0, 40000, 3))) for _ in range(200)])
    data = token_files.pack(ids.astype(np.int32), np.array([len(ids)]), 49408)
    block = token_files.Block(data)
    assert (block.ids() == ids).all() and len(block.symbols) < len(ids) / 5 and len(data) < 2 * len(ids) / 2
    assert block.lengths.max() > 2


def test_large_vocabulary_uses_four_bytes():
    ids = np.array([70000, 70001] * 50, np.int32)
    assert token_files.Block(token_files.pack(ids, np.array([100]), 80000)).ids().tolist() == ids.tolist()


def test_word_encoder_is_the_library(tokenizers_brute):
    encoder = token_files.LibraryEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*texts(5, 600), "It's Dr. X., isn't it? A.B, <|ENDOFTEXT|> <|endoftext|> don't.", "ΑΣ ÉTÉ İx", None]
    ids, counts = encoder.encode(pa.array(rows), 2)
    ends = np.cumsum(counts)
    for row, end, count in zip(rows, ends, counts):
        assert ids[end - count : end].tolist() == [*tokenizers_brute.word.encode(row or "", add_special_tokens=False).ids, 2]


def test_memo_starts_anew_without_changing_ids(tokenizers_brute):
    encoder = token_files.LibraryEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.limit = 5
    for row in ("one two three", "four five six seven", "one two eight nine ten eleven twelve"):
        ids, _ = encoder.encode(pa.array([row]))
        assert ids.tolist() == tokenizers_brute.word.encode(row, add_special_tokens=False).ids


def test_hashes_differ_and_ignore_position():
    values = [f"w{i}" for i in range(2000)] + ["", "a", "aa", "x" * 100, "é", "é"]
    found = words.hashes(pa.array(values))
    assert len(set(found.tolist())) == len(values)
    assert (words.hashes(pa.array(values[::-1]))[::-1] == found).all()


def test_steps_keep_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 50, None, "", "b" * 500, "c"])})
    parts = list(words.steps(batch, "text", 60))
    assert [r for p in parts for r in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert [p.num_rows for p in parts] == [3, 1, 1]


@pytest.mark.parametrize("text, literals", [
    ('db_password = "Xk39vLq82mZ"', ["Xk39vLq82mZ"]),
    ("export AWS_SECRET=Qm8s7dKf92ha", ["Qm8s7dKf92ha"]),
    ('{"client_key": "aB3dE5fG7hI9"}', ["aB3dE5fG7hI9"]),
    ('part = "Zx81kQ72"\nauthToken = part + "mN45pR98"', ["Zx81kQ72", "mN45pR98"]),
    ('K1 = "Zx81kQ72mN45"\nother = K1\nsigning_key = other', ["Zx81kQ72mN45"]),
    ('password = "changeme"', []),
    ('colour = "Zx81kQ72mN45"', []),
    ("the token was lost in the river", []),
])
def test_literals_of_sensitive_names(text, literals):
    assert [text[a:b] for a, kind, b in secrets.scan(text) if kind == "literal"] == literals


def test_redaction_joins_overlapping_spans():
    text = 'x token = "0123456789abcdef01234567" y'
    spans = secrets.scan(text)
    assert [k for _, k, _ in spans] == ["assign", "hex", "literal"]
    assert secrets.redacted(text, spans) == 'x [secret]" y'
    assert secrets.scan(None) == secrets.scan("") == []


def test_language_margins_and_short_texts():
    learned = {"en": (b"the thing of the water and the house " * 40, b"under the light of the stone\n"),
               "de": ("der und das haus geht nicht über die straße ".encode() * 40, "unter dem licht ist der stein\n".encode())}
    by_lang = language.compressors(learned)
    assert language.classify("The water and the house", by_lang)[0] == "en"
    assert language.classify("Das Haus geht nicht", by_lang)[0] == "de"
    assert language.classify(None, by_lang) == language.classify("123 ½ %", by_lang) == ("und", 0.0, True)
    assert language.classify("zq", by_lang)[2]
    assert language.classify("text", {}) == ("und", 0.0, True)


def test_triple_weights_give_the_kernel():
    landmarks = toxicity.dense(["idiot", "stupid", "house"]).T
    weights = landmarks @ np.array([0.7, -0.2, 0.1], np.float32)
    pool = ["idiot", "idxiot", "houses", "water"]
    direct = toxicity.kernel(pool, landmarks) @ [0.7, -0.2, 0.1]
    assert np.allclose(toxicity.Pieces(pa.array(pool, pa.large_string())).linear(weights), direct, atol=1e-5)
    near = toxicity.kernel(pool, landmarks)[:, 0]
    assert 0.95 < near[0] < 1.3 and near[0] > near[1] > 4 * max(near[2:])


def test_machine_tolerates_inserted_characters():
    rng = random.Random(2)
    pool = ["water", "house", "river", "stone", "light", "walks", "under", "green", "table", "paper", "winter", "summer"]
    documents = []
    for i in range(80):
        text = " ".join(rng.choice(pool) for _ in range(30))
        documents.append((text + (" you stupid idiot" if i % 4 == 0 else ""), int(i % 4 == 0)))
    machine = toxicity.fit(documents)
    rows = ["water house stupiid", "an i-d-i-o-t in winter", "idxiot", "s t u p i d", "water house river", "", "12 34"]
    assert (machine.documents(pa.array(rows)) >= 0.5).tolist() == [True, True, True, True, False, False, False]
    assert toxicity.fit([("only one label", 0)]).documents(pa.array(["x"]))[0] < 0.01
