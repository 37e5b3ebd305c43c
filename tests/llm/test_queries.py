"""Every registered query on odd, empty and small tables, against plain Python or SQL."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from handbook_spark.llm import queries
from tests import oracle
from tests.llm import brute
from tests.llm.conftest import odd_documents, odd_embeddings

SMALL = "/root/testdata/sf0.001"
ALL = queries.queries()


def run(spark, name, folder):
    return ALL[name](spark, folder).collect()


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, empty_dir, name):
    frame = ALL[name](spark, empty_dir)
    assert frame.collect() == []
    assert frame.columns


@pytest.mark.parametrize("name", [n for n in ALL if n in queries.oracle_sql()])
def test_small_tables_against_sql(spark, name):
    assert oracle.difference(ALL[name](spark, SMALL), oracle.duck(SMALL), queries.oracle_sql()[name]) is None


def ordered(rows):
    """doc_id with nulls first, equal ids by text."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_op1_odd_rows(spark, odd_dir, odd_rows, tokenizers_brute):
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in run(spark, "op1_token_files", odd_dir))
    want, at = [], 0
    for doc_id, text in ordered(odd_rows):
        ids = [*tokenizers_brute.word.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((at, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == want


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def finite(v):
    return all(x is not None and math.isfinite(x) for x in v)


def single(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, *_ in rows]


def test_op2_odd_rows(spark, odd_dir):
    found = {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in run(spark, "op2_nearest_neighbours", odd_dir)}
    want = brute.best_rows(single(odd_embeddings()), lambda a, b: round(cosine(a, b), 12), lambda v: finite(v) and any(v))
    assert found == {(q, rank, i, round(s, 9)) for q, rank, i, s in want}


def test_op4_odd_rows(spark, odd_dir):
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in run(spark, "op4_bit_sliced_top_k", odd_dir)}
    want = brute.best_rows(
        single(odd_embeddings()), lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b)), finite)
    assert found == want


def test_op3_odd_rows(spark, odd_dir, odd_rows):
    found = run(spark, "op3_toxicity", odd_dir)
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (brute.crc(r.doc_id) % 5 == 0) for r in found)
    by_id = {r.doc_id: r.predicted for r in found}
    assert [by_id[i] for i in range(60)] == [int(i % 7 == 0) for i in range(60)]
    assert not any(by_id[i] for i in (60, 61, 62, 63, 64, 65))
    assert by_id[69] == 1  # letters with spaces between them, behind a very long text


def test_op5_odd_rows(spark, odd_dir, odd_rows):
    found = run(spark, "op5_language_id", odd_dir)
    assert len(found) == len(odd_rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].rejected and by_id[i].score == 0 for i in (62, 63, 64, 65))
    assert all(by_id[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert all(0 <= r.score <= 1 and r.held_out == (brute.crc(r.doc_id) % 4 == 2) for r in found)
    assert {r.lang_pred for r in found} <= {"en", "de", "und"}


def test_op5_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in run(spark, "op5_language_id", "/root/testdata/sf0.01") if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97


def test_op3_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in run(spark, "op3_toxicity", folder) if r.held_out and r.doc_id in truth]
    clean = [r for r in held if truth[r.doc_id] == 0]
    toxic = [r for r in held if truth[r.doc_id] == 1]
    assert sum(r.predicted for r in clean) / len(clean) < 0.04
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8


def test_op6_odd_rows(spark, odd_dir, odd_rows, tokenizers_brute):
    import hashlib

    found = sorted(((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op6_byte_bpe", odd_dir)))
    want = []
    for doc_id, text in odd_rows:
        ids = tokenizers_brute.byte.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizers_brute.byte.decode(ids, skip_special_tokens=False)
        want.append((str(doc_id), len(ids), brute.sha(ids), hashlib.sha256(decoded.encode()).hexdigest()))
    assert found == sorted(want)


def test_op7_odd_rows(spark, odd_dir, odd_rows):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in run(spark, "op7_ngram_jaccard", odd_dir)]
    want = brute.components(odd_rows)
    assert sorted(map(str, found)) == sorted(str((i, *want[i])) for i, _ in odd_rows)
    assert {10, 60, 61} <= {i for i, _, c in found if c == 10}


def test_op8_odd_rows(spark, odd_dir, odd_rows):
    found = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5))
                    for r in run(spark, "op8_lm_scores", odd_dir)))
    want = brute.base_scores(odd_rows, lambda i: brute.crc(i) % 10 != 0)
    assert found == sorted((str(i), n, k, t, round(b, 5)) for (i, _), (n, k, t, b) in zip(odd_rows, want))


def test_op8_scores_are_log_probabilities(spark, odd_dir):
    rows = run(spark, "op8_lm_scores", odd_dir)
    assert all(r.score < 0 and r.mixed_score <= 0 and r.mixed_score >= max(r.base_score, r.score) - math.log10(2) - 1e-9 for r in rows)


def test_op9_odd_rows(spark, odd_dir, odd_rows):
    import hashlib

    for r in run(spark, "op9_secret_scan", odd_dir):
        text = dict(odd_rows)[r.doc_id]
        base = brute.secret_spans(text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("literal")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))


def test_op10_odd_rows(spark, odd_dir):
    found = run(spark, "op10_source_mix", odd_dir)
    assert len(found) == len(odd_documents())
    sizes: dict = {}
    for row in odd_documents():
        sizes[row[3]] = sizes.get(row[3], 0) + len(brute.WORDS.findall(row[1] or ""))
    targets = brute.mix_targets(sizes)
    taken: dict = {}
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    again = run(spark, "op10_source_mix", odd_dir)
    assert sorted(map(str, found)) == sorted(map(str, again))
