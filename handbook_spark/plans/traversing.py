"""J: links and depth-bounded search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from handbook_spark.corpus import Corpus
from handbook_spark.functions import urls
from handbook_spark.operators import graph
from handbook_spark.plans.registry import query

ROOT = 0


@query("j1_page_links", r"""
WITH hrefs AS (SELECT page_id, url, trim(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1))) AS href FROM pages)
SELECT DISTINCT page_id, link FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || split_part(replace(href, '&amp;', '&'), '#', 1) AS link
  FROM hrefs WHERE starts_with(href, '/') AND NOT starts_with(href, '//')) WHERE contains(link, 'example')""")
def j1(c: Corpus) -> DataFrame:
    return graph.page_links(c.table("pages"), "example")


def _bfs_sql(name: str, roots: str, depth: int) -> str:
    return f"""
{name}_walk AS (SELECT node, 0 AS depth FROM ({roots}) UNION
  SELECT l.dst, w.depth + 1 FROM {name}_walk w JOIN v_links l ON l.src = w.node WHERE w.depth < {depth}),
{name} AS (SELECT DISTINCT node FROM {name}_walk)"""


@query("j2_depth_bounded_search", f"""
WITH RECURSIVE {_bfs_sql('found', f'SELECT {ROOT} AS node', 4).strip()} SELECT node FROM found""")
def j2(c: Corpus) -> DataFrame:
    links = c.view("v_links")
    roots = c.table("pages").filter(F.col("page_id") == ROOT).select(F.col("page_id").alias("node"))
    return graph.reachable(links, roots, 4)


_KEEP = "SELECT node FROM {} WHERE node IN (SELECT page_id FROM pages WHERE url LIKE '%blog%' OR url LIKE '%m.%')"


@query("j3_staged_search", f"""
WITH RECURSIVE {_bfs_sql('wide', f'SELECT {ROOT} AS node', 3).strip()},
{_bfs_sql('middle', _KEEP.format('wide'), 2).strip()},
{_bfs_sql('near', _KEEP.format('middle'), 1).strip()}
{_KEEP.format('middle')} UNION {_KEEP.format('near')}""")
def j3(c: Corpus) -> DataFrame:
    pages = c.table("pages")
    wanted = pages.filter(urls.has_keyword(F.col("url"), ["blog", "m."])).select(F.col("page_id").alias("node"))
    roots = pages.filter(F.col("page_id") == ROOT).select(F.col("page_id").alias("node"))
    return graph.staged_reachable(c.view("v_links"), roots, lambda found: found.join(wanted, "node", "left_semi"))
