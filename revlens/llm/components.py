"""Connected components of a link table.

1. Every partition contracts its own links to a forest (union by smallest
   node), so repeated and redundant links never leave their task.
2. What is left is dealt by the larger end of each link to as many tasks as it
   fills (``LINKS_PER_TASK`` links each) and contracted again.
3. Alternating star contraction: every round joins links to the smallest
   neighbour of their endpoint, first for larger neighbours, then for smaller
   ones, and contracts inside partitions, until nothing changes. Links stay
   distributed, a node with very many links is only ever reduced by ``min``, and
   the number of rounds grows with the logarithm of the longest chain. A forest
   made by a single task has nothing left to join, so no round follows it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

LINKS_PER_TASK = 50_000
MAX_ROUNDS = 60


def _forest(batches):
    """(a, b): every node of the partition's links with its smallest relative."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for k in range(0, len(nodes), 100_000):
        some = nodes[k:k + 100_000]
        yield pd.DataFrame({"a": np.array(some, np.int64), "b": np.array([find(x) for x in some], np.int64)})
    parent.clear()
    release()


def _largest_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _smallest_star(links: DataFrame) -> DataFrame:
    """Links point from the larger to the smaller end."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(links: DataFrame):
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _contract(links: DataFrame) -> DataFrame:
    state = _state(links)
    for _ in range(MAX_ROUNDS):
        links = cut(_smallest_star(_largest_star(links)).select("a", "b").mapInPandas(_forest, "a long, b long"))
        new = _state(links)
        if new == state:
            return links
        state = new
    raise RuntimeError("components did not converge")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` that has a link; root is
    the smallest node of its component. Self links are ignored; no links give
    no rows. The result is materialised."""
    schema = "a long, b long"
    links = cut(links.select("a", "b").mapInPandas(_forest, schema))
    tasks = -(-links.count() // LINKS_PER_TASK)
    if tasks:
        links = cut(links.repartition(tasks, "a").mapInPandas(_forest, schema))
    if tasks > 1:
        links = _contract(links)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
