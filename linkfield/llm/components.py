"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written


#: Links that one task contracts by itself (16 bytes each); more are contracted by rounds.
FEW_LINKS = 1 << 18


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its part) for every node of the links a-b, by hooking and pointer jumping."""
    nodes, ix = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ix[: len(a)], ix[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        low, high = np.minimum(p, q), np.maximum(p, q)
        if (low == high).all():
            return nodes, nodes[root]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches):
    """Each partition's links as stars around the smallest nodes of their parts."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, root = union_find(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        kept = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(root[kept])], names=["a", "b"])


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """node, component (the smallest node that links reach) for all nodes of links (a, b: long, not null).

    Partitions first contract what they hold; then each node's neighbours above it, and after that those below it,
    move to the smallest neighbour, until nothing changes.  A node with a third of all links is no single group:
    minima are pre-aggregated, and joins to them can be split where a key is skewed.  Where partitions leave FEW_LINKS at
    most, one task ends it.  No links give no rows.
    """
    stars = written(links.select("a", "b").where("a <> b").mapInArrow(_contracted, "a long, b long").distinct(), "stars")
    if stars.count() <= few:
        return _labels(written(stars.repartition(1).mapInArrow(_contracted, "a long, b long"), "stars"))
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "stars")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        stars = written(moved.where("a <> b").distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return _labels(stars)
        before = now
