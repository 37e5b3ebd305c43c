"""Small tables with every odd case that the operators define a result for."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, label string"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, score string, ids int"
LABELS = "doc_id long, quality int, toxic int, score int"
CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, words string"


def prose(rng: random.Random, words: int, pool: list[str]) -> str:
    return " ".join(rng.choice(pool) for _ in range(words)) + "."


def odd_documents() -> list[tuple]:
    rng = random.Random(4)
    pools = {"en": ["the", "thing", "of", "and", "water", "house", "river", "walks", "under", "light", "stone"],
             "de": ["der", "und", "haus", "wasser", "geht", "unter", "licht", "stein", "nicht", "über", "straße"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        text = prose(rng, rng.randint(8, 60), pools[lang])
        if i % 7 == 0:
            text += " stupid idiot."
        rows.append((i, text, lang, f"src{i % 3}", len(text), 0.5, 1, "x"))
    base = rows[10][1].split()
    rows += [
        (60, rows[10][1], "de", "src0", 1, None, None, None),  # copy
        (61, " ".join([*base, "neu"]), "de", "src0", 1, None, None, None),  # near copy
        (62, None, None, None, None, None, None, None),
        (63, "", "en", "src1", 0, 1.0, 2, ""),
        (64, "   \n\t ", "en", "src1", 5, 1.0, 2, ""),
        (65, "12 345 %%", "en", "src2", 9, 1.0, 2, ""),
        (66, "one two", None, "src2", 7, 1.0, 2, ""),
        (67, "one two", "en", "src2", 7, 1.0, 2, ""),
        (68, 'password = "hunter2secret" and AKIA' + "ABCDEFGH1234567890 " + "0123456789abcdef" * 2, "en", None, 9, None, None, None),
        (69, "word " * 40000 + "a" * 70000 + " i d i o t", "en", "src0", 1, None, None, None),  # very long
        (None, "no id at all here", "en", "src0", 1, None, None, None),
        (70, rows[3][1], "en", "src1", 1, None, None, None),
        (70, rows[3][1], "en", "src1", 1, None, None, None),  # repeated row
    ]
    return rows


def odd_embeddings() -> list[tuple]:
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], 0, "x", 1) for i in range(120)]
    same = [0.5, -0.25, 0.125, 0.0, 1.0, -1.0]
    rows += [(i, same, 1, "x", 1) for i in range(150, 175)]  # copies, two of them queries with id 150
    rows += [(200, None, None, None, None), (250, [0.0] * 6, 0, "", 0), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, "", 0),
             (202, [float("nan")] * 6, 0, "", 0), (203, [float("inf")] + [0.0] * 5, 0, "", 0), (204, [], 0, "", 0),
             (None, same, 0, "", 0), (120, rows[3][1], 0, "x", 1), (120, rows[3][1], 0, "x", 1)]
    return rows


def odd_labels() -> list[tuple]:
    rows = [(i, 1, int(i % 7 == 0), 3) for i in range(60)]
    return rows + [(62, None, None, None), (None, 0, 1, 1), (7, 1, 1, 0), (999, 0, 1, 0)]


def odd_conversations() -> list[tuple]:
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f", ""]), 1, "x")
            for c in [*range(-25, 70), 400, 401] for t in range(rng.randint(1, 6))]
    for c in range(100, 160):  # copies, and copies that go on
        rows += [(c, t, "user", f"same {t}", 1, "x") for t in range(3 + (c % 7 == 0))]
    rows += [(200, t, "user", f"long {t % 50} words here", 1, "x") for t in range(700)]
    rows += [(201, t, "user", f"long {t % 50} words here", 1, "x") for t in range(690)]
    rows += [(None, 0, "user", "no id", 1, "x"), (300, None, None, None, None, None), (300, 1, "user", "b", 1, "x"),
             (300, None, "user", "null turn", 1, "x"), (301, 0, None, "", 1, "x"), (302, 0, "", None, 1, "x"), (302, 0, "", None, 1, "x"),
             (303, 5, "user", "tie b", 1, "x"), (303, 5, "user", "tie a", 1, "x"), (303, 2**40, "1:", "2:x", 1, "x"), (403, 0, "user", "alone", 1, "x")]
    return rows


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("odd"), odd_documents(), odd_embeddings(), odd_labels(), odd_conversations())


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


def stored(spark, folder, documents, embeddings, labels, conversations) -> str:
    for name, rows, schema in (("documents", documents, DOCUMENTS), ("embeddings", embeddings, EMBEDDINGS), ("labels", labels, LABELS),
                               ("conversations", conversations, CONVERSATIONS)):
        spark.createDataFrame(rows, schema).repartition(3, F.rand(1)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def odd_rows():
    return [(r[0], r[1]) for r in odd_documents()]


@pytest.fixture(scope="session")
def tokenizers_brute():
    return brute.Tokenizers()
