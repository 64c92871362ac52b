"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored

SCHEMA = pa.schema([("node", pa.int64()), ("component", pa.int64())])


class Forest:
    """Union-find; the root of a tree is its smallest node."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (y := self.up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: each node with its root there."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.up)
    for k in range(0, len(nodes), 50_000):
        part = nodes[k : k + 50_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([forest.root(x) for x in part], pa.int64())], schema=SCHEMA)


def connected(links: DataFrame, one_task: int = 50_000) -> DataFrame:
    """(node, component) of each node of links (a, b): component is the
    smallest node that can be reached.

    Links that are few by count go through one union-find.  More go through
    one in each partition, which leaves a forest; then the partitions' trees
    are joined as a parallel union-find does it, in joins and aggregates over
    all tasks: a node takes the smallest label beside it and then its label's
    label, until nothing changes.  The result is the same.  No links, no rows.
    """
    if links.count() <= one_task:
        return stored(links.select("a", "b").coalesce(1).mapInArrow(_local, "node long, component long"), "components")
    forest = stored(links.select("a", "b").mapInArrow(_local, "node long, component long"), "forest")
    both = stored(forest.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(forest.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))).distinct(), "edges")
    label = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        low = stored(label.join(near, label.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")), "low")
        up = low.select(F.col("node").alias("up"), F.col("component").alias("top"))
        new = stored(low.join(up, low.component == up.up, "left").select("node", "old", F.least("component", F.coalesce("top", "component")).alias("component")), "labels")
        done = new.where("old <> component").limit(1).count() == 0
        forget(low, label)
        label = new.select("node", "component")
        if done:
            forget(both, forest)
            return label
