"""Connected components by alternating stars, in joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored

#: Links of a node from which on its label is broadcast to them, so that no
#: task holds them all.  A graph of n links has at most 2 n / HOT such nodes.
HOT = 100_000


def _labelled(both: DataFrame, hot: int) -> DataFrame:
    """(u, v, m): links seen from u, with the smallest node m beside u or u
    itself."""
    low = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("degree")))
    few, many = low.where(F.col("degree") < hot).drop("degree"), low.where(F.col("degree") >= hot).drop("degree")
    if not many.limit(1).count():
        return both.join(few, "u")
    of_hot = both.join(F.broadcast(many), "u")  # 2 links / HOT rows at most
    return of_hot.unionByName(both.join(F.broadcast(many.select("u")), "u", "left_anti").join(few, "u"))


def components(links: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, component) of every node of links (a, b), both long: component
    is the smallest node that can be reached.

    A large star ties each node's larger neighbours to its smallest, a small
    star its smaller ones and itself; in turn they make every component a star
    around its smallest node, in some log^2 n rounds, and the links never grow
    in number.  Each round is stored, so a lost executor repeats no earlier
    one.  Null ends, loops and repeated links count for nothing; no links, no
    rows.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct())
    while True:
        # stars: whoever points at a smaller node points at one, and is not pointed at
        several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        pointed = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if not several.unionByName(pointed).limit(1).count():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stored(_labelled(both, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        near = _labelled(large, hot)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")).where("u <> v"))
        following = stored(small.distinct())
        forget(edges, large)
        edges = following
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
