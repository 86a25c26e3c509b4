"""Connected components by union-find inside partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.llm.common import by_merge, stored


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges of one partition reduced to (node, smallest node it reaches there)."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            a, b = find(bytes(a)), find(bytes(b))
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:
            yield _edges(parent, find)
            parent.clear()
    yield _edges(parent, find)


def _edges(parent: dict, find) -> pd.DataFrame:
    return pd.DataFrame([(x, find(x)) for x in list(parent) if parent[x] != x], columns=["a", "b"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: binary): root is the smallest node it reaches.

    Edges are first reduced by union-find where they lie. Then large-star and small-star steps
    alternate until nothing changes; each is an aggregate and a join, stored, so neither edges
    nor components pass through the driver (the joins do not broadcast) and a node with very many edges is one aggregate.
    Roots are listed too. No edges give no rows.
    """
    edges = stored(edges.select("a", "b").mapInPandas(_forest, "a binary, b binary"), "forest")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(by_merge(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(by_merge(least), "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.*").filter("a != b").distinct()
        edges = stored(small, "small_star")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
