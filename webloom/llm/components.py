"""Connected components of a table of links, by union-find in tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import map_batches
from webloom.session import written


def forest(links: DataFrame) -> DataFrame:
    """Links (a, b) of each task reduced to its union-find forest: (node, root) with root < node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            parent: dict[int, int] = {}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                top = x
                while (up := parent.get(top, top)) != top:
                    top = up
                while x != top:
                    parent[x], x = top, parent.get(x, x)
                return top

            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            nodes = [x for x in parent if root(x) != x]
            yield {"a": nodes, "b": [root(x) for x in nodes]}

    return map_batches(links.select("a", "b"), work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link to another one; component is the smallest node reachable.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then its smaller ones; the number of
    rounds grows with the logarithm of the longest path. A node with very many links is met by its minimum, which tasks
    pre-aggregate, in a join whose hot side adaptive execution splits. Every round is written to the shared folder.
    """
    edges = written(forest(links.filter("a <> b")).distinct(), "components")
    state = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = written(small.union(least.select("a", F.col("least").alias("b"))).distinct(), "components")
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = new
