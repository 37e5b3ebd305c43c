"""Joins, mutations, search, retrieval, graph and batch operators against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from handbook_spark.corpus import Corpus
from handbook_spark.operators import aggregates, filters, graph, joins, quality, retrieval, tables


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


SEARCH = "raw_module_id int, module_code string, ai_module_code string, module_title string, ai_title string, module_ects int, ai_ects int, ai_lecturer string, weekly_hours int, recommended_semester int, version int, ai_requirements array<string>"


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame([
        (1, "GEO-1", "MA-1", "Karten", None, 6, 5, "Prof. A", 2, 1, 20241, ["Abitur"]),
        (2, None, "geo-2", None, "Kartographie", None, 6, None, 4, 2, 20240, None),
        (3, None, None, "Karten", "x", 6, 6, "Prof. A", 4, 2, None, []),
    ], SEARCH)


def hits(found, **wanted):
    return [r.raw_module_id for r in filters.search_modules(found, wanted).orderBy("raw_module_id").collect()]


def test_search(found):
    assert hits(found, title="KART") == [1, 2]  # row 3 has no code
    assert hits(found, module_code="ma-1") == []  # the regex code counts where there is one
    assert hits(found, subject="GEO") == [1, 2]
    assert hits(found, ects="6") == [1, 2]
    assert hits(found, ects="6", ects_type="<=", weekly_hours="4", weekly_hours_type="=") == [2]
    assert hits(found, version="WS 2024/2025") == [1]
    assert hits(found, requirements="abi", lecturer=" ") == [1]


@pytest.mark.parametrize("wanted", [{}, {"title": " "}, {"colour": "red"}, {"ects": "6", "ects_type": "<"}, {"ects_type": "="}])
def test_search_rejects(found, wanted):
    with pytest.raises(ValueError):
        filters.search_modules(found, wanted)


def test_select_rows_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, s string")
    assert rows(filters.select_rows(df, ["id"], negated_conditions={"s": "a"}), "id") == [(3,)]
    assert rows(filters.select_rows(df, ["id"], where="id > ? AND s = ?", variables=[1, "b"]), "id") == [(3,)]
    with pytest.raises(ValueError):
        filters.select_rows(df, where="id > ?", variables=[])
    with pytest.raises(ValueError):
        filters.select_rows(df, conditions={"id": 1}, where="id > 1")
    with pytest.raises(ValueError):
        filters.module_rows(df, ["password"])
    with pytest.raises(ValueError):
        filters.module_rows(df, contents="x")
    ordered = filters.select_rows(df, ["id"], order_by=("s", "ASC")).collect()
    assert [r.id for r in ordered] == [1, 3, 2]


def test_topic_and_completeness(spark):
    df = spark.createDataFrame([(1, ["Geburt", "Hebammen"]), (2, []), (3, None), (4, ["Karten"])], "id int, c array<string>")
    assert rows(filters.without_topic(df, "c", "hebamme"), "id") == [(4,)]
    assert rows(filters.complete(df), "id") == [(1,), (4,)]


def test_name_matches_equals_cross_comparison(spark):
    rng = random.Random(3)
    def name():
        return "".join(rng.choice("abÜ –—-") for _ in range(rng.randint(1, 6)))
    known = [(i, name()) for i in range(150)] + [(900, "Universität Köln"), (901, "ab")]
    fetched = [(name(),) for _ in range(80)] + [("universität",), ("KÖLN",)]
    def plain(n):
        return n.lower().replace("—", "-").replace("–", "-")
    wanted = sorted({(i, n, f) for i, n in known for (f,) in fetched if plain(f) in plain(n) or plain(n) in plain(f)}, key=repr)
    got = joins.name_matches(spark.createDataFrame(known, "id int, name string"), spark.createDataFrame(fetched, "name string"))
    assert rows(got.distinct(), "id", "name", "fetched_name") == wanted


def test_provenance_counts_copies(spark):
    raw = spark.createDataFrame([(1, "A", "Prof. X 6 LP"), (2, "A", "Prof. X 6 LP"), (3, "A", "Prof. Y 8"), (4, "B", "x")], "id int, module_code string, content string")
    ai = spark.createDataFrame([(1, "A", "Prof. X", 6), (2, "A", None, None), (3, "A", "Prof. X, 6", 8), (4, None, None, None), (5, "B", None, 1)], "raw_module_id int, module_code string, lecturer string, ects int")
    got = rows(joins.provenance(ai, raw), "raw_module_id", "n_matches", "first_raw_id")
    assert got == [(1, 2, 1), (2, 3, 1), (3, 0, None), (4, 0, None), (5, 0, None)]


def test_provenance_of_hot_codes_equals_pairing(spark):
    rng = random.Random(9)
    people = ["Prof. A", "Prof. B", "Dr. Ü", "Prof. AB", "X"]
    raw = [(i, "HOT" if i % 3 else f"C{i % 5}", f"{rng.choice(people)} und {rng.choice(people)}: {rng.randint(1, 30)} LP") for i in range(300)]
    ai = [(i, "HOT" if i % 2 else f"C{i % 5}", rng.choice([None, "", "Prof. A", "Prof. A, Dr. Ü", "fehlt", "X"]), rng.choice([None, 3, 12, 99])) for i in range(120)]
    left = spark.createDataFrame(ai, "raw_module_id int, module_code string, lecturer string, ects int")
    right = spark.createDataFrame(raw, "id int, module_code string, content string")
    wanted = []
    for i, code, lecturer, ects in ai:
        ids = [r for r, c, t in raw if c == code and (lecturer is None or all(x in t for x in lecturer.split(", "))) and (ects is None or str(ects) in t)]
        wanted.append((i, len(ids), min(ids, default=None)))
    got = rows(joins.provenance(left, right), "raw_module_id", "n_matches", "first_raw_id")
    assert got == sorted(wanted, key=repr)


@pytest.mark.parametrize("listed", [0, 3, 512])
def test_provenance_by_lists_and_by_all_grams_equals_pairing(spark, monkeypatch, listed):
    monkeypatch.setattr(joins, "LISTED_GRAMS", listed, raising=False)
    rng = random.Random(listed)
    words = ["Prof. A", "Prof. AB", "Dr. Ü", "x", "", "Prof. Zoe Lang", "😀 b"]
    raw = [(i, rng.choice(["HOT", "HOT", "C1", "C2", None]), rng.choice([None, "", " ".join(rng.choices(words, k=3)) + str(rng.randint(1, 12))])) for i in range(200)]
    raw += [(i + 500, c, t) for i, c, t in raw[:60]] + raw[:20]
    ai = [(i, rng.choice(["HOT", "HOT", "C1", "C3", None]), rng.choice([None, *words, "Prof. A, x", "x, Prof. Zoe Lang"]), rng.choice([None, 1, 12, 99])) for i in range(120)]
    ai += ai[:10]
    wanted = []
    for i, code, lecturer, ects in ai:
        ids = [r for r, c, t in raw if code is not None and c == code
               and (lecturer is None or t is None or all(x in t for x in lecturer.split(", "))) and (ects is None or t is None or str(ects) in t)
               and (t is not None or (not lecturer and ects is None))]
        wanted.append((i, len(ids), min(ids, default=None)))
    left = spark.createDataFrame(ai, "raw_module_id int, module_code string, lecturer string, ects int")
    right = spark.createDataFrame(raw, "id int, module_code string, content string")
    assert rows(joins.provenance(left, right), "raw_module_id", "n_matches", "first_raw_id") == sorted(wanted, key=repr)


def shuffled(df, metric="shuffleRecordsWritten"):
    """Rows, or another figure, that the exchanges of a collected frame wrote."""
    def total(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return total(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return total(node.plan())
        written, children = node.metrics().get(metric), node.children()
        own = written.get().value() if node.nodeName() == "Exchange" and written.isDefined() else 0
        return own + sum(total(children.apply(i)) for i in range(children.size()))

    return total(df._jdf.queryExecution().executedPlan())


def test_provenance_shuffles_only_grams_that_are_looked_up(spark):
    rng = random.Random(5)
    raw = [(i, f"C{i % 40}", "".join(chr(rng.randint(97, 122)) for _ in range(200)) + f" Prof. {i % 7}") for i in range(200)]
    ai = [(i, f"C{i % 40}", f"Prof. {i % 7}", None) for i in range(80)]
    left = spark.createDataFrame(ai, "raw_module_id int, module_code string, lecturer string, ects int")
    right = spark.createDataFrame(raw, "id int, module_code string, content string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = joins.provenance(left, right)
        assert sum(r.n_matches for r in found.collect()) == sum(1 for _, c, l, _ in ai for _, d, t in raw if c == d and l in t)
        assert shuffled(found) < 20_000  # the texts have about 240 000 grams
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_full_merge_shuffles_short_rows(spark, tmp_path):
    """Same records as the joined view gives, which shuffles its texts and lists; a few keys repeat or are missing."""
    pairs = [(p, s) for p in range(200) for s in range(5)] + [(3, 1), (1, (1 << 31) + 4), (None, 1), (2, None), (900, 1), (901, 9)]
    spark.createDataFrame(pairs, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(p, f"bolt {p % 3}", ["LARGE", "SM", None, "A-B"][p % 4], p % 9) for p in [*range(200), 900, 4, 4, 7]] + [(None, "nut", "SMALL", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    handbooks = [(s, f"h{s}", s % 5) for s in [0, 1, 2, 3, 4, 4, (1 << 31) + 4]] + [(None, "x", 1)]
    spark.createDataFrame(handbooks, "s_suppkey long, s_name string, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(1).write.parquet(str(tmp_path / "pages.parquet"))  # a column of the view has a table's name
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = entry.queries()["i43_full_merge"](spark, str(tmp_path))
        view = joins.merged_modules(Corpus(spark, str(tmp_path)).view("v_search_full"))
        lists = [f.name for f in view.schema if f.dataType.typeName() == "array"]
        view = view.withColumns({n: F.array_join(n, "; ") for n in lists})
        assert found.columns == view.columns and Counter(map(str, found.collect())) == Counter(map(str, view.collect()))
        assert found.count() > 700
        assert shuffled(found, "dataSize") < shuffled(view, "dataSize") / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlaps(spark):
    data = [(1, i, c, c.lower(), i, [i]) for i, c in enumerate("DCBA")] + [(2, i, c, "t", 1, [9]) for i, c in enumerate("ABX")] + [(3, 0, "A", None, None, [1])]
    df = spark.createDataFrame(data, "mhb_id int, pos int, module_code string, title string, ects int, pages array<int>")
    overlap = joins.handbook_overlap(df, [1, 2]).orderBy("pos")
    assert [(r.module_code, r.title) for r in overlap.collect()] == [("B", "b"), ("A", "a")] and "pages" not in overlap.columns
    assert rows(joins.common_modules(df, [3, 2], ["title", "ects"]), "module_code", "title", "ects") == [("A", "k.A.", "k.A.")]
    assert rows(joins.shared_codes(df, [1, 2, 3]), "module_code") == [("A",)]
    assert aggregates.transferable_credits(joins.handbook_overlap(df, [1, 2])).first().credits == 5
    assert aggregates.smallest_handbook(df).first().mhb_id == 3
    ordered = joins.common_modules(df, [1, 2], ["title"]).collect()
    assert [(r.module_code, r.title) for r in ordered] == [("A", "a"), ("B", "b")]  # order of the smaller handbook
    same = joins.compare_handbooks(df, [1, 1]).collect()
    assert [(r.module_code, r.pages) for r in same] == [("D", "0"), ("C", "1"), ("B", "2"), ("A", "3")]
    assert [r.module_code for r in joins.compare_handbooks(df, [2, 1]).collect()] == ["A", "B"]


def test_roll_up_splits_long_handbooks(spark):
    df = spark.createDataFrame([(1, i, f"M{i}") for i in (5, 3, 12, 25)], "mhb_id int, pos int, module_code string")
    got = [(r.part, r.module_codes) for r in aggregates.roll_up(df, [], record_size=10).orderBy("part").collect()]
    assert got == [(0, ["M3", "M5"]), (1, ["M12"]), (2, ["M25"])]


def test_mutations(spark):
    table = spark.createDataFrame([(1, "a", 1), (4, "b", None)], "id int, s string, n int")
    after, new = tables.insert(table, [{"s": "c"}, {"id": 9, "s": "d"}, [None, "e", 3]], "id")
    assert rows(after, "id", "s", "n") == [(1, "a", 1), (4, "b", None), (5, "c", None), (7, "e", 3), (9, "d", None)]
    assert new.count() == 3 and table.columns == ["id", "s", "n"]
    with pytest.raises(ValueError):
        tables.insert(table, [{"x": 1}])
    updated, changed = tables.update(table, {"s": "z", "n": F.col("n") + 1}, {"n": 1})
    assert rows(updated, "id", "s", "n") == [(1, "z", 2), (4, "b", None)] and rows(changed, "id", "s", "n") == [(1, "z", 2)]
    assert rows(tables.update(table, {"s": None}, "n IS NULL")[0], "id", "s") == [(1, "a"), (4, None)]
    with pytest.raises(ValueError):
        tables.update(table, {"x": 1}, {"n": 1})
    changes = spark.createDataFrame([(4, None), (8, "x")], "id int, s string")
    assert rows(tables.update_from(table, changes, "id"), "id", "s") == [(1, "a"), (4, None)]
    kept, removed = tables.delete(table, {"n": 1})
    assert rows(kept, "id") == [(4,)] and rows(removed, "id") == [(1,)]


def test_insert_or_skip_keeps_first_of_hot_key(spark):
    stored = spark.createDataFrame([("k0", 0)], "k string, id int")
    new = spark.createDataFrame([("k0", 1)] * 5 + [("hot", i) for i in range(500, 1000)] + [("k1", 7)], "k string, id int")
    assert rows(tables.insert_or_skip(stored, new, ["k"], [F.col("id")]), "k", "id") == [("hot", 500), ("k0", 0), ("k1", 7)]


def test_get_or_create(spark):
    dimension = spark.createDataFrame([(3, "Uni A", "X")], "id long, name string, city string")
    facts = spark.createDataFrame([(i, n, c, "logo") for i, (n, c) in enumerate([("Uni A", "X"), ("Uni B", "X"), ("Uni A", "Y"), ("Uni B", "X")])], "fid int, name string, city string, logo string")
    full, linked = tables.get_or_create(dimension, facts, ["name", "city"], ["logo"])
    assert rows(full, "id", "name", "city", "logo") == [(3, "Uni A", "X", None), (4, "Uni A", "Y", "logo"), (5, "Uni B", "X", "logo")]
    assert rows(linked, "fid", "dimension_id") == [(0, 3), (1, 5), (2, 4), (3, 5)]


def okapi(texts, query):
    """Plain Okapi scores."""
    docs = [t.split() for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * average for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in query.split()) for d in docs]


def test_bm25_with_common_word(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["der", "der", "der", "karte", "stadt", "fluss", "berg"]) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r.score for r in retrieval.bm25(df, "id", "t", "der karte karte fehlt").orderBy("id").collect()]
    assert got == pytest.approx(okapi(texts, "der karte karte fehlt"), abs=1e-9)


def test_nearest_handles_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0])], "id int, v array<float>")
    got = [(r.id, None if r.score is None else round(r.score, 4)) for r in retrieval.nearest(df, "v", "id", [2.0, 0.0], 3).collect()]
    assert got == [(1, 1.0), (2, 0.7071), (6, -1.0)]
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(300)], "query_no int, query array<float>")
    cells = retrieval.cosine_to_queries(df.filter("id IN (1, 2, 6)"), "v", "id", queries).collect()
    assert len({(r.id, r.query_no) for r in cells}) == len(cells) == 900


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "c string, rank int")
    b = spark.createDataFrame([("y", 1)], "c string, rank int")
    got = {r.c: r.fused_score for r in retrieval.fuse_ranks([a, b], [0.5, 0.5], "c").collect()}
    assert got == pytest.approx({"x": 0.5 / 61, "y": 0.5 / 62 + 0.5 / 61})


def test_clusters(spark):
    points = [(i, [float(10 * (i % 3)) + 0.01 * i, 0.0]) for i in range(30)]
    got = retrieval.cluster(spark.createDataFrame(points, "id int, v array<float>"), "v", "id").collect()
    assert {(r.id % 3, r.cluster) for r in got} == {(0, 0), (1, 1), (2, 2)}


def test_search_in_graph(spark):
    rng = random.Random(2)
    edges = [(0 if rng.random() < 0.4 else rng.randrange(60), rng.randrange(60)) for _ in range(120)]
    links = spark.createDataFrame(edges, "src int, dst int")
    roots = spark.createDataFrame([(0,), (7,), (0,)], "node int")
    for depth in (0, 1, 3, 30):
        level = seen = {0, 7}
        for _ in range(depth):
            level = {d for s, d in edges if s in level}
            seen = seen | level
        assert {r.node for r in graph.reachable(links, roots, depth).collect()} == seen


def test_search_starts_from_web_links_only(spark):
    links = spark.createDataFrame([("https://a.de", "https://a.de/1"), ("mailto:x", "https://b.de")], "src string, dst string")
    roots = spark.createDataFrame([("https://a.de",), ("mailto:x",)], "node string")
    assert rows(graph.reachable(links, roots, 2), "node") == [("https://a.de",), ("https://a.de/1",)]


def test_quarantine(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    checked = quality.with_error(df, {"missing": F.col("v").isNotNull(), "negative": F.col("v") >= 0})
    good, bad = quality.split_bad(checked)
    assert rows(good, "id") == [(1,)] and rows(bad, "id", "_error") == [(2, "missing"), (3, "negative")]
    assert quality.batch_status(checked).first().asDict() == {"n_good": 1, "n_bad": 2, "status": "PARTIAL_SUCCESS", "is_error": True}
    assert quality.batch_status(checked.filter("id > 1")).first().status == "FULL_ERROR"
    assert quality.batch_status(checked.filter("id = 1")).first().status == "FULL_SUCCESS"
    assert rows(quality.retry_input(df, bad, "id"), "id") == [(2,), (3,)]
