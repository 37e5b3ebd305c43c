"""Links between stored pages: extraction and depth-bounded search."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameWriter, functions as F

from handbook_spark.functions.urls import normalize_href
from handbook_spark.session import materialize, scratch_path

ANCHOR_DOUBLE = r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'
ANCHOR_SINGLE = r"(?i)<a\s[^>]*?href\s*=\s*'([^']*)'"


def hrefs(html: Column) -> Column:
    """Link targets of all anchors of a page."""
    found = F.concat(
        F.regexp_extract_all(html, F.lit(ANCHOR_DOUBLE), F.lit(1)),
        F.regexp_extract_all(html, F.lit(ANCHOR_SINGLE), F.lit(1)),
    )
    return F.transform(found, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))


def page_links(pages: DataFrame, host: Column | str) -> DataFrame:
    """Distinct normalised links of each page (``page_id, url, html``).

    Links are unique per page, so they are made distinct inside the row without a shuffle.
    """
    wanted = F.lit(host) if isinstance(host, str) else host
    links = F.array_distinct(
        F.filter(F.transform(hrefs(F.col("html")), lambda h: normalize_href(F.col("url"), h, wanted)), lambda u: u.isNotNull())
    )
    return pages.select("page_id", F.explode(links).alias("link"))


#: Parts that the links of one node are dealt to.
LINK_PARTS = 8


class StoredLinks:
    """Links in buckets by source, so that a step of a search shuffles its frontier alone.

    A source's links lie in ``LINK_PARTS`` parts by their target; a node of the frontier goes to all of them, so a node with very many
    links is walked by several tasks. The tables of a search belong to the session's catalog while it lasts; their files lie in scratch storage.
    """

    def __init__(self, links: DataFrame):
        self.spark = links.sparkSession
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._names: list[str] = []
        parts = links.filter("src IS NOT NULL AND dst IS NOT NULL").select(
            "src", "dst", F.pmod(F.xxhash64("dst"), F.lit(LINK_PARTS)).cast("int").alias("part"))
        self.table = self.store(parts, "src", "part")

    def __enter__(self) -> StoredLinks:
        return self

    def __exit__(self, *_) -> None:
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def store(self, rows: DataFrame, *keys: str) -> str:
        """A new table with buckets by ``keys``; returns its name."""
        name = f"handbook_{uuid.uuid4().hex}"
        self._names.append(name)
        self._write(rows, keys).option("path", scratch_path(self.spark)).saveAsTable(name)
        return name

    def append(self, name: str, rows: DataFrame, *keys: str) -> None:
        self._write(rows, keys).mode("append").saveAsTable(name)

    def _write(self, rows: DataFrame, keys: tuple[str, ...]) -> DataFrameWriter:
        return rows.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys)

    def step(self, frontier: DataFrame) -> DataFrame:
        """Distinct targets of the links of some nodes."""
        parts = F.explode(F.sequence(F.lit(0), F.lit(LINK_PARTS - 1)))
        walk = frontier.select("node", parts.alias("walked_part"))
        edges = self.spark.table(self.table)
        found = edges.join(walk, (edges["src"] == walk["node"]) & (edges["part"] == walk["walked_part"]), "left_semi")
        return found.select(F.col("dst").alias("node")).distinct()

    def unseen(self, nodes: DataFrame, visited: str) -> DataFrame:
        """Nodes that are not in a stored table of visited ones, which stays where it is."""
        return nodes.join(self.spark.table(visited), "node", "left_anti")

    def reachable(self, roots: DataFrame, max_depth: int) -> DataFrame:
        """Nodes found within ``max_depth`` rounds from the roots, the last unvisited frontier included; see ``reachable``."""
        if dict(roots.dtypes)["node"] == "string":
            roots = roots.filter(F.col("node").rlike("^https?:"))
        frontier = materialize(roots.select("node").distinct())
        visited = self.store(frontier, "node")
        for _ in range(max_depth):
            if frontier.isEmpty():
                break
            frontier = materialize(self.unseen(self.step(frontier), visited))
            self.append(visited, frontier, "node")
        return materialize(self.spark.table(visited))


def reachable(links: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Nodes found within ``max_depth`` rounds from the roots, the last unvisited frontier included.

    ``links`` has ``src, dst`` and ``roots`` one column ``node``; of roots given as URLs only
    http(s) ones count. Links are put into buckets once; every frontier is written to scratch storage, which cuts lineage.
    """
    with StoredLinks(links) as stored:
        return stored.reachable(roots, max_depth)


def staged_reachable(
    links: DataFrame, roots: DataFrame, keep: Callable[[DataFrame], DataFrame], depths: tuple[int, int, int] = (3, 2, 1)
) -> DataFrame:
    """Narrowing search: wide from the roots, then from the kept nodes with smaller depths, all kept nodes united."""
    with StoredLinks(links) as stored:
        first = materialize(keep(stored.reachable(roots, depths[0])))
        second = materialize(keep(stored.reachable(first, depths[1])))
        third = materialize(keep(stored.reachable(second, depths[2])))
    return second.unionByName(third).distinct()
