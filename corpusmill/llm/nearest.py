"""Approximate nearest neighbours by largest cosine: anisotropic four-bit
codes, table scans of the probed clusters, exact reranking of the best."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantise import Quantiser, pack, unit, unpack
from .shared import stored

#: Candidates of a part and most parts, queries of a block, most clusters, and
#: sampled vectors that each needs.
CANDIDATES, PARTS, QUERIES, CLUSTERS, MEMBERS = 16_384, 8, 2_048, 256, 64


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def usable(vector: Column, d: int) -> Column:
    """Of length d, without null or non-finite components, and not zero."""
    return vector.isNotNull() & (F.size(vector) == d) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0)


def _smallest_ids(vectors: DataFrame, most: int) -> DataFrame:
    """(vector, ids): each different vector with its `most` smallest different
    ids; rows repeated with the same id take one place.  Copies are cut down
    in every batch before the shuffle; a copy beyond the smallest ids can be
    nobody's neighbour, for those tie and come first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, raw = b.column("id").to_numpy(), matrix(b.column("vector"), b.num_rows) if b.num_rows else np.zeros((0, 1))
            order = np.lexsort((ids, *(raw.T[::-1])))
            new = np.concatenate([[True], (raw[order][1:] != raw[order][:-1]).any(axis=1)]) if len(ids) else np.zeros(0, bool)
            other = new | np.concatenate([[True], ids[order][1:] != ids[order][:-1]]) if len(ids) else new
            place = other.cumsum() - np.maximum.accumulate(np.where(new, other.cumsum(), 0))
            yield b.take(pa.array(np.sort(order[other & (place < most)])))

    few = vectors.mapInArrow(cut, vectors.schema)
    ranked = few.withColumn("rank", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("rank") <= most)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def fit(sample: np.ndarray, rows: int, k: int, aim: float, seed: int = 1) -> Quantiser:
    """A quantiser for the sample, and the fewest clusters to probe whose
    true neighbours in it reach `aim`.  Clusters grow with the square root of
    the rows, as far as the sample can tell them apart."""
    clusters = max(1, min(CLUSTERS, math.isqrt(rows) // 2, len(sample) // MEMBERS))
    out = Quantiser(sample, clusters, seed=seed)
    if clusters > 1:
        rng = np.random.default_rng(seed)
        q = rng.choice(len(sample), min(256, len(sample)), replace=False)
        score = sample[q] @ sample.T
        score[np.arange(len(q)), q] = -2
        near = np.argpartition(-score, min(k, score.shape[1] - 1) - 1, axis=1)[:, :k]
        where = out.cluster(out._padded(sample))[near]
        order = out.nearest_clusters(sample[q], clusters)
        place = np.argsort(order, axis=1)
        need = np.take_along_axis(place, where, axis=1)
        share = [(need < p).mean() for p in range(1, clusters + 1)]
        out.probes = next(p for p, x in enumerate(share, 1) if x >= aim or p == clusters)
    return out


def blocks_of(counts: dict[int, int], size: int = QUERIES) -> dict[int, tuple[int, int]]:
    """Of each cluster its first block and in how many it lies: small clusters
    share a block, large ones are dealt to several by hash."""
    out, block, room = {}, 0, size
    for c, n in sorted(counts.items()):
        if n > size:
            continue
        if n > room:
            block, room = block + 1, size
        out[c], room = (block, 1), room - n
    block += 1
    for c, n in sorted(counts.items()):
        if n > size:
            out[c] = block, -(-n // size)
            block += out[c][1]
    return out


class Best:
    """The best candidates of each of some queries so far, at most `most`."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, clusters: list[list[int]], most: int) -> None:
        self.keys, self.vectors, self.most = keys, vectors, most
        self.probed: dict[int, np.ndarray] = {}
        for i, own in enumerate(clusters):
            for c in own:
                self.probed.setdefault(c, np.zeros(len(keys), bool))[i] = True
        self.near = np.zeros((len(keys), 0), np.float32)
        self.item = self.first = np.zeros((len(keys), 0), np.int64)

    def scan(self, q: Quantiser, cluster: int, codes: np.ndarray, item: np.ndarray, first: np.ndarray) -> None:
        """Take in the candidates of one cluster, for the queries that probe
        it."""
        rows = np.flatnonzero(self.probed.get(cluster, np.zeros(0, bool)))
        if not len(rows):
            return
        width = min(self.near.shape[1] + len(codes), self.most)
        near = np.full((len(self.keys), width), -np.inf, np.float32)
        items, firsts = (np.zeros((len(self.keys), width), np.int64) for _ in range(2))
        kept = self.near.shape[1]
        near[:, :kept], items[:, :kept], firsts[:, :kept] = self.near, self.item, self.first
        for a in range(0, len(rows), 64):
            at = rows[a : a + 64]
            score = np.concatenate([self.near[at], q.scan(self.vectors[at], cluster, codes)], axis=1)
            best = np.argpartition(-score, width - 1, axis=1)[:, :width]
            near[at] = np.take_along_axis(score, best, 1)
            old, new = np.minimum(best, max(kept - 1, 0)), np.maximum(best - kept, 0)
            for out, own, other in ((items, self.item, item), (firsts, self.first, first)):
                out[at] = np.where(best < kept, np.take_along_axis(own[at], old, 1), other[new]) if kept else other[new]
        self.near, self.item, self.first = near, items, firsts

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.keys), 64):
            good = np.isfinite(self.near[a : a + 64])
            columns = np.repeat(self.keys[a : a + 64], good.sum(axis=1)), self.item[a : a + 64][good], self.first[a : a + 64][good], self.near[a : a + 64][good]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, rerank: int = 384, aim: float = 0.95, sample_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = CANDIDATES, query_rows: int = QUERIES, broadcast_pairs: int = 1_000_000) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by
    `every`, the k nearest other rows found, by cosine, ties to the smaller id.

    `sample_rows` different vectors, first by hash, fit the index on the
    driver; all rows are indexed.  Copies of a vector are one candidate with
    its k + 1 smallest ids, and one query, so large groups of copies cost
    little.  As many clusters are probed as give a recall of `aim` on the
    sample.  Queries lie in blocks by their nearest cluster, and a block meets
    the codes of the clusters that it probes, in some parts dealt by hash.  A
    task reads its part cluster by cluster and keeps the best of each query:
    `rerank` of one part, or each part's share of them and six deviations
    more, so what a query brings back does not grow with the table.  The
    `rerank` best of all parts meet their vectors and are scored in double
    precision.

    Null ids, and vectors that are null, zero, hold null or non-finite
    components or have another length than most, take no part.  A row that is
    repeated with the same id and vector is one row; an id with several
    vectors is a candidate by each, and a query by the smallest.  No usable
    rows give no rows.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    sizes = raw.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = sizes[0]["d"] if sizes and sizes[0]["d"] > 0 else 1
    rows = raw.where(usable(F.col("vector"), d))
    items = stored(_smallest_ids(rows, k + 1), "items")
    sample = items.orderBy(F.xxhash64("vector"), "vector").limit(sample_rows).select("vector").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(unit(np.array([r["vector"] for r in sample])), items.count(), k, aim)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            if b.num_rows:
                own, codes = q.encode(unit(matrix(b.column("vector"), b.num_rows)))
                packed = pack(codes)
                lists = pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), lists, b.column("item"), b.column("first")], names=["cluster", "codes", "item", "first"])

    # an item is known by a hash of its vector and its smallest id
    known = items.select(F.xxhash64("vector").alias("item"), F.get("ids", F.lit(0)).alias("first"), "vector", "ids")
    coded = stored(known.mapInArrow(encode, "cluster int, codes binary, item long, first long"), "codes")
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("key", F.xxhash64("vector"))
    different = stored(queries.select("key", "vector").distinct(), "queries")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            if b.num_rows:
                at = q.nearest_clusters(unit(matrix(b.column("vector"), b.num_rows)), q.probes)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vector"), pa.array(at.tolist(), pa.list_(pa.int32()))], names=["key", "vector", "clusters"])

    sent = stored(different.mapInArrow(probe, "key long, vector array<double>, clusters array<int>"), "sent")
    # counts by nearest cluster: CLUSTERS rows at most
    nearest_one = F.get("clusters", F.lit(0))
    where = blocks_of({r["c"]: r["n"] for r in sent.groupBy(nearest_one.alias("c")).agg(F.count("*").alias("n")).collect()}, query_rows)
    if not where:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first_block, several = (F.create_map(*[F.lit(x) for c in sorted(where) for x in (c, where[c][i])])[nearest_one] for i in (0, 1))
    asked = sent.withColumn("queries", (first_block + F.pmod("key", several)).cast("int"))
    pairs = stored(asked.select("queries", F.explode("clusters").alias("cluster")).distinct(), "pairs")
    parts = max(1, min(PARTS, -(-coded.count() // part_rows)))
    most = rerank if parts == 1 else math.ceil(rerank / parts + 6 * (rerank / parts) ** 0.5)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = coded.join(F.broadcast(pairs) if pairs.count() <= broadcast_pairs else pairs, "cluster")
    held = held.select("queries", F.pmod("item", F.lit(parts)).cast("int").alias("part"), "cluster", "codes", "item", "first", none("long", "key"), none("array<double>", "vector"), none("array<int>", "clusters"))
    # the queries of a block come first in each of its parts
    ask = asked.select("queries", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("cluster"), none("binary", "codes"), none("long", "item"), none("long", "first"), "key", "vector", "clusters")
    result = pa.schema([("key", pa.int64()), ("item", pa.int64()), ("first", pa.int64()), ("near", pa.float32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best, group = shared.value, None, None
        waiting: list[pa.RecordBatch] = []

        def ready() -> Best:
            t = pa.Table.from_batches(waiting)
            waiting.clear()
            return Best(t.column("key").to_numpy(), unit(matrix(t.column("vector"), t.num_rows)), t.column("clusters").to_pylist(), most)

        for b in batches:
            if not b.num_rows:
                continue
            own = np.stack([b.column(c).to_numpy() for c in ("queries", "part", "cluster")])
            starts = np.append(np.flatnonzero(np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0))), b.num_rows)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                now, cluster, run = tuple(own[:2, s].tolist()), int(own[2, s]), b.slice(s, e - s)
                if now != group:
                    if best is not None:
                        yield from best.rows(result)
                    group, best = now, None
                    waiting.clear()
                if cluster < 0:
                    waiting.append(run)
                    continue
                if best is None and waiting:
                    best = ready()
                if best is not None:
                    codes = unpack(np.frombuffer(b"".join(run.column("codes").to_pylist()), np.uint8).reshape(run.num_rows, -1), q.m)
                    best.scan(q, cluster, codes, run.column("item").to_numpy(), run.column("first").to_numpy())
        if best is not None:
            yield from best.rows(result)

    dealt = ask.unionByName(held).repartition("queries", "part").sortWithinPartitions("queries", "part", "cluster")
    found = dealt.mapInArrow(search, "key long, item long, first long, near float")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("near"), "first", "item"))
    chosen = found.withColumn("place", place).where(F.col("place") <= rerank).select("key", "item", "first")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (unit(matrix(b.column(c), b.num_rows)) for c in ("vector", "asked"))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("ids"), pa.array(np.einsum("rd,rd->r", x, y))], names=["key", "ids", "score"])

    both = chosen.join(known, ["item", "first"]).join(different.withColumnRenamed("vector", "asked"), "key").select("key", "vector", "asked", "ids")
    exact = both.mapInArrow(score, "key long, ids array<long>, score double")
    top = lambda df, *order: df.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), *order))).where(F.col("place") <= k + 1)
    best = top(top(exact, F.get("ids", F.lit(0))).select("key", "score", F.explode("ids").alias("vec_id")), "vec_id").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    mine = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("id")), 1, k)
    answers = queries.select("id", "key").join(best, "key").select("id", F.posexplode(mine).alias("at", "n"))
    return answers.select(F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))
