"""Connected components of a links table.

Results for odd input: links with a null end and links of a node with itself take no part, so a node that has only such links is
in no row of the result; repeated links count once, in either direction; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handbook_spark.session import materialize

#: Ways that the rows of one key are dealt.
SALTS = 32


def dealt_join(rows: DataFrame, key: str, spread: str, values: DataFrame, of: str) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row per ``of``) where ``key`` is ``of``; a key of very many rows fills many tasks.

    Rows are dealt to ``SALTS`` parts of their key by a hash of ``spread``. The parts that exist, at most ``SALTS`` of a key, fetch the value
    first, and rows then meet their part.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    parts = salted.select(F.col(key).alias("__key"), F.col("__salt").alias("__part")).distinct()
    fetched = parts.join(values, F.col("__key") == F.col(of)).drop(of)
    # Always a shuffled join: a broadcast of the parts would be chosen by an estimate that knows nothing of their number.
    return salted.join(fetched.hint("merge"), (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__part"))).drop(
        "__key", "__part", "__salt")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that each linked node of ``links`` (a, b) can reach.

    Every round each node takes the smallest label among its neighbours' and its own, and labels then follow
    their own label's label, so distances shrink by more than half a round. Aggregates are combined in tasks
    before they are shuffled, and joins deal the links of one node and the nodes of one label over many tasks. Rounds are stored tables.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        values = labels.select(F.col("node").alias("of"), F.col("label").alias("reached"))
        near = dealt_join(edges, "b", "a", values, "of").groupBy("a").agg(F.min("reached").alias("near"))
        better = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"))
        jump = better.select(F.col("node").alias("of"), F.col("label").alias("jumped"))
        new = materialize(dealt_join(better, "label", "node", jump, "of").select(
            "node", F.least("label", "jumped").alias("label")))
        old = labels.select(F.col("node").alias("of"), F.col("label").alias("was"))
        changed = new.join(old, new["node"] == old["of"]).filter("label <> was").limit(1).count()
        labels = new
        if not changed:
            return labels
