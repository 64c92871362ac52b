"""Centroid clustering: Lloyd's rounds by two trees, a cover tree over each
block of vectors and one over the round's centroids, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .covertree import Centroids, CoverTree, assign, cover_tree, squared
from .shared import forget, stored

#: Vectors of a block, which has one cover tree and is one row of the index.
BLOCK = 2_048
#: Components beyond this could not be squared and added up in 64 bits.
LARGEST = 1 << 27
TREE = ("begins", "ends", "centres", "radii", "firsts", "kids")


def _narrow(x: np.ndarray) -> tuple[np.ndarray, int]:
    most = int(np.abs(x).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32
    return x.astype(kind), np.dtype(kind).itemsize


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(ids, width, points, the six arrays of a cover tree): one row a block
    of at most `size` vectors of a partition, in tree order."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("width", pa.int32()), ("points", pa.binary()), *((c, pa.binary()) for c in TREE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def block(t: pa.Table) -> pa.RecordBatch:
            x = t.column("q").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a component of a vector is beyond {LARGEST} once scaled")
            tree = cover_tree(x)
            points, width = _narrow(x[tree.order])
            ids = t.column("id").combine_chunks().take(pa.array(tree.order))
            values = [pa.array([ids.to_pylist()], schema.field("ids").type), pa.array([width], pa.int32()), pa.array([points.tobytes()], pa.binary()), *(pa.array([a], pa.binary()) for a in tree.arrays())]
            return pa.RecordBatch.from_arrays(values, schema=schema)

        for b in batches:
            start = 0
            while start < b.num_rows:
                part = b.slice(start, size - rows)
                held.append(part)
                rows, start = rows + part.num_rows, start + part.num_rows
                if rows == size:
                    yield block(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held))

    return vectors.mapInArrow(run, "ids array<long>, width int, points binary, " + ", ".join(f"{c} binary" for c in TREE))


def _opened(batch: pa.RecordBatch, d: int) -> Iterator[tuple[pa.Array, np.ndarray, CoverTree]]:
    for k in range(batch.num_rows):
        row = {c: batch.column(c)[k].as_py() for c in ("width", "points", *TREE)}
        x = np.frombuffer(row["points"], f"<i{row['width']}").reshape(-1, d).astype(np.int64)
        yield batch.column("ids")[k].values, x, CoverTree.of_arrays([row[c] for c in TREE])


def _sums(index: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors their number and their sum: a task
    sends one row a cluster, and the driver gets as many."""
    k, d = centroids.shape
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Centroids(centroids)
        total, n = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for _, x, tree in _opened(b, d):
                label, _ = assign(x, tree, near)
                for c in np.unique(label):
                    total[c] += x[label == c].sum(axis=0)
                n += np.bincount(label, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], schema=schema)

    parts = index.mapInArrow(run, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(d))).alias("sums"))
    return {r["cluster"]: (r["n"], r["sums"]) for r in added.collect()}


def _assigned(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    d = centroids.shape[1]
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Centroids(centroids)
        for b in batches:
            for ids, x, tree in _opened(b, d):
                label, _ = assign(x, tree, near)
                yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(squared(x, centroids[label]))], schema=schema)

    return index.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, d: int = 64, scale: float = 1024.0, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    of each vector with exactly d components, none null or non-finite, after
    `rounds` rounds of Lloyd's algorithm over floor(scale * x).

    The first centroids are the k vectors whose `seed:id` has the smallest
    sha256 (of equal ids the smallest vector); there are fewer where fewer
    vectors are.  Ties go to the smaller number, and a centroid without
    vectors stays.  The index is built once, without a shuffle: a cover tree
    for each block of at most `block` vectors, stored.  A round maps over it
    with the centroids, k rows, and brings back k sums, so neither the driver
    nor a task holds more than k centroids and a block.  Rounds end early
    when no centroid moved: the rest would give the same.

    Copies of a vector are rows of one leaf and each is a row of the result,
    as are repeated rows; a null id is hashed as '' and stays null.  No usable
    vector, no rows.  A component beyond 2^27 once scaled is an error, since
    squared distances must fit into 64 bits.  Other columns are not read.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = raw.where(F.col("v").isNotNull() & (F.size("v") == d) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    # beyond 2^62 all numbers are beyond LARGEST too
    whole = good.select("id", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0**62)), F.lit(-(2.0**62))))).alias("q"))
    index = stored(blocks(whole, block), "trees")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = whole.orderBy(order, "q").limit(k).select("q").collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["q"] for r in first], np.int64)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, sums) in _sums(index, centroids).items():
            moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    found = stored(_assigned(index, centroids), "clusters")
    forget(index)
    total = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    facts = [(c, n, sum(total.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in total.items()]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
