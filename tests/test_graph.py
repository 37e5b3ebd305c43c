"""Search over stored links: plans of a round, hubs, and clean-up."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from handbook_spark.operators import graph
from handbook_spark.session import materialize


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def branches(plan: str, table: str) -> list[str]:
    """Operators between a scan of a table and the join above it, per scan."""
    lines, found = plan.split("\n"), []
    for i, line in enumerate(lines):
        if "FileScan" in line and table in line:
            above, depth = [], line.index("FileScan")
            for upper in reversed(lines[:i]):
                at = len(upper) - len(upper.lstrip(" :+-|"))
                if at < depth:
                    depth = at
                    if "Join" in upper:
                        break
                    above.append(upper)
            found.append("\n".join(above))
    return found


def test_a_round_shuffles_neither_links_nor_visited_nodes(spark, no_broadcast):
    links = spark.range(2000).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 2000).alias("dst"))
    with graph.StoredLinks(links) as stored:
        frontier = spark.range(5).select(F.col("id").alias("node"))
        visited = stored.store(frontier, "node")
        for _ in range(2):
            plan = stored.step(frontier)._jdf.queryExecution().executedPlan().toString()
            sides = branches(plan, stored.table)
            assert len(sides) == 1 and "Exchange" not in sides[0]
            nodes = stored.step(frontier)
            plan = stored.unseen(nodes, visited)._jdf.queryExecution().executedPlan().toString()
            sides = branches(plan, visited)
            assert len(sides) == 1 and "Exchange" not in sides[0]
            frontier = materialize(stored.unseen(nodes, visited))
            stored.append(visited, frontier, "node")
        assert spark.table(visited).count() > 5


def test_a_hub_is_walked_by_several_tasks_and_tables_are_dropped(spark):
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 3000)] + [(rng.randrange(3000), rng.randrange(9000)) for _ in range(500)] + [(None, 1), (1, None), (5, 5)]
    links = spark.createDataFrame(edges, "src long, dst long")
    before = {t.name for t in spark.catalog.listTables()}
    level = seen = {0}
    for _ in range(3):
        level = {d for s, d in edges if s in level and d is not None}
        seen = seen | level
    found = graph.reachable(links, spark.createDataFrame([(0,)], "node long"), 3)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert sorted(r.node for r in found.collect()) == sorted(seen)
    with graph.StoredLinks(links) as stored:
        hub = spark.table(stored.table).filter("src = 0").groupBy("part").count().collect()
    assert len(hub) == graph.LINK_PARTS


def test_empty_links_and_roots(spark):
    links, roots = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(3,)], "node long")
    assert [r.node for r in graph.reachable(links, roots, 4).collect()] == [3]
    assert graph.reachable(links, roots.limit(0), 4).collect() == []
