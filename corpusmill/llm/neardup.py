"""MinHash near-duplicate groups: SuperMinHash signatures, banding, exact
verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import Forest, connected
from .minhash import bands, signatures
from .shared import named, numbered, slices, stored, texts_of
from .words import NONSPACE, U, mix, shingles, words

#: Places of a signature and of a band.  A pair at a similarity of 0.75 shares
#: none of the 32 bands with a probability of (1 - 0.75^4)^32 = 0.000005.
PLACES, ROWS = 128, 4
#: Ids whose table may be broadcast (32 MB); more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Nodes and elements of a block, and elements compared at once.
BLOCK, ELEMENTS, COLUMNS = 512, 1 << 21, 1 << 13


def distinct_shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text and their first indices."""
    h, first = shingles(words(texts, NONSPACE), n)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_keys(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set's mixed elements."""
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(c)))]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return [(k[first[1:]] - k[first[:-1]]).view(np.int64) for k in sums]


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(id, text_key, size, k1, k2, bands): the set's size, a 128-bit key equal
    for equal sets, and its band keys."""
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, first = distinct_shingles(texts_of(b.column("text")), n)
            keys = set_keys(h, first)
            band = bands(signatures(h, first, PLACES), ROWS)
            size = np.diff(first)
            ends = np.cumsum(np.where(size > 0, band.shape[1], 0))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(band[size > 0].reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(size, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), lists], schema=schema)

    return docs.mapInArrow(run, "id long, text_key long, size long, k1 long, k2 long, bands array<long>")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, first = distinct_shingles(texts_of(b.column("text")), n)
            yield pa.RecordBatch.from_arrays([*map(pa.array, set_keys(h, first)), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))], schema=schema)

    return docs.mapInArrow(run, "k1 long, k2 long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked.  Either side
    is an inner join that may be split where one node has many pairs."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def common_sizes(sets: list[np.ndarray], columns: int = COLUMNS) -> np.ndarray:
    """Sizes of all intersections of these sets, exactly: the incidence matrix
    of the elements that several sets have, times itself, some columns at a
    time."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[element] > 1
    owner, element = owner[keep], (np.cumsum(times > 1) - 1)[element[keep]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    common = np.zeros((n, n), np.int64)
    for low in range(0, int((times > 1).sum()), columns):
        a, b = np.searchsorted(element, (low, low + columns))
        part = np.zeros((n, columns), np.float32)
        part[owner[a:b], element[a:b] - low] = 1
        common += (part @ part.T).astype(np.int64)
    return common


def block_links(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found by comparing all nodes of each group (gid, i, j)
    that are in different components: rows (gid, i, j, node, component, mine,
    shingles), mine the node's own block, i or j.  Full sets are compared; of
    the links only as many leave the task as connect what they connect."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        node, component, mine, sets = zip(*rows, strict=True)
        if len(set(component)) < 2:
            return []
        size, own, comp = np.array([len(x) for x in sets]), np.array(mine), np.array(component)
        common = common_sizes(list(sets))
        good = np.triu(100 * common >= percent * (size[:, None] + size[None] - common), 1) & (comp[:, None] != comp[None])
        if len(set(mine)) > 1:
            good &= own[:, None] != own[None]
        forest, out = Forest(), []
        for i, j in zip(*(x.tolist() for x in np.nonzero(good)), strict=True):
            if forest.root(component[i]) != forest.root(component[j]):
                forest.join(component[i], component[j])
                out.append((node[i], node[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last, found = None, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("gid", "i", "j", "node", "component", "mine")]
            sets = b.column("shingles").to_numpy(zero_copy_only=False)
            for gid, i, j, node, component, mine, x in zip(*columns, sets, strict=True):
                if (gid, i, j) != last:
                    found += compare(rows) if len(rows) > 1 else []
                    rows, last = [], (gid, i, j)
                rows.append((node, component, mine, x))
        found += compare(rows) if len(rows) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=schema)

    return groups.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, one_task: int = 50_000, block: int = BLOCK, elements: int = ELEMENTS) -> DataFrame:
    """(doc_id, text_key, n_shingles, group, component_id) of each row: group
    is the same for rows that are linked, text_key a hash of the text.

    1. One map makes each document's set key and band keys.  Equal sets are
       one node, by a pre-aggregated groupBy, so thousands of copies cost one.
    2. A node is compared with the node of the smallest id in one of its
       buckets, on full sets; links become components by union-find.
    3. In each bucket that is still in several components, blocks bounded by
       nodes and by elements are compared with each other in parallel tasks,
       again on full sets, leaving out pairs already connected.  Buckets with
       the same nodes are compared once.  Pairs do not leave the tasks.

    All buckets, of any size, take this one way, and no estimate decides.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketch = stored(sketches(source, n), "sketches")
    sets_of = sketch.where("id is not null and size > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.max("size").alias("size"))
    # a number for each set; the rank keeps apart two sets that share half of the key
    reps = stored(sets_of.withColumn("node", F.col("k1").bitwiseXOR(F.row_number().over(Window.partitionBy("k1").orderBy("k2")) - 1)), "representatives")
    flat = reps.select(F.explode("bands").alias("band"), "node", "rep", "size")
    heads = flat.groupBy("band").agg(F.min(F.struct("rep", "node", "size")).alias("head"), F.count("*").alias("n")).where("n > 1").select("band", F.col("head.rep").alias("head_rep"), F.col("head.node").alias("head"), F.col("head.size").alias("head_size"))
    bucket = stored(flat.join(heads, "band"), "buckets")
    fits = 100 * F.least("size", "head_size") >= percent * F.greatest("size", "head_size")  # else the sets cannot be similar enough
    first = stored(bucket.where("node <> head").where(fits).groupBy(F.col("node").alias("b")).agg(F.min_by("head", F.struct("head_rep", "head")).alias("a")).select("a", "b"), "first")
    met = stored(bucket.select("node").distinct().join(reps.select("node", "rep", "k1", "k2"), "node"), "met")
    few = met.count() <= broadcast_ids
    ids = met.select(F.col("rep").alias("id")).distinct()
    chosen = source.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = stored(shingle_sets(chosen, n).join(F.broadcast(met) if few else met, ["k1", "k2"]).select("node", "shingles").dropDuplicates(["node"]), "sets")

    links = stored(verified(first, sets, percent), "links-first")
    component = connected(links, one_task)
    member = stored(bucket.select("band", "node", "size").join(component, "node", "left").withColumn("component", F.coalesce("component", "node")), "members")
    print_of = [F.bit_xor(F.xxhash64("node", F.lit(s))).alias(f"x{s}") for s in (1, 2)]
    open_ = member.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("p"), F.max("node").alias("q"), *print_of).where("low <> high")
    once = open_.groupBy("n", "x1", "x2").agg(F.min("band").alias("band"), F.max("total").alias("total"), F.max("p").alias("p"), F.max("q").alias("q"))
    # buckets of two whose pair was looked at first are done
    tried = first.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), F.lit(2).cast("long").alias("n"))
    left = once.join(tried, ["n", "p", "q"], "left_anti").select("band", F.ceil(F.greatest(F.col("n") / block, F.col("total") / elements)).cast("int").alias("blocks"))
    nodes = member.join(left, "band").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = nodes.join(sets, "node").select(F.col("band").alias("gid"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "component", "mine", "shingles")
    more = stored(block_links(blocks, percent), "links-more")
    if more.limit(1).count():
        component = connected(links.unionByName(more), one_task)

    group = reps.select("k1", "k2", "rep", "node").join(component, "node", "left").withColumn("group", F.coalesce("component", "node"))
    group = stored(group.select("k1", "k2", "rep", "group"), "groups")
    smallest = stored(group.groupBy("group").agg(F.min("rep").alias("component_id")), "smallest")  # stored: the join can split a hot group
    of_set = group.join(smallest, "group").select("k1", "k2", "group", "component_id")
    linked = (F.col("size") > 0) & F.col("id").isNotNull()
    shared = sketch.where(linked).join(of_set, ["k1", "k2"]).select(F.col("id").alias("doc_id"), "text_key", F.col("size").alias("n_shingles"), "group", "component_id")
    alone = sketch.where(~linked).select(F.col("id").alias("doc_id"), "text_key", F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("group"), F.col("id").alias("component_id"))
    return shared.unionByName(alone)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; see `groups`.

    Null or empty texts and texts of white space have no set and link with
    nothing; fewer than n words are one shingle.  Every row is a document of
    its own: rows that share an id but differ in text are linked by their
    texts alone.  Rows with a null id are compared with nothing, have a null
    component and are kept.  An empty table gives no rows.  Other columns are
    not read.
    """
    return groups(docs, **options).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS, **options) -> DataFrame:
    """The rows of docs without all but one of each group: the smallest id
    stays, of several texts with it the one with the smallest hash, and of
    repeated rows the one whose columns are smallest.  Rows without words and
    rows with a null id stay."""
    names = docs.columns
    rows = stored(groups(docs, id_col=id_col, text_col=text_col, broadcast_ids=broadcast_ids, **options), "rows")
    best = stored(rows.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("best")), "best")
    judged = rows.join(best, "group").withColumn("stays", F.struct("doc_id", "text_key") == F.col("best"))
    found = stored(judged.groupBy("doc_id", "text_key").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")).where("n > 1 or not stays"), "not-single")
    id_, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    keyed = numbered(docs).withColumn("_key", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    same = (id_.cast("long") == F.col("doc_id")) & (F.col("_key") == F.col("text_key"))
    few = found.count() <= broadcast_ids
    single = keyed.join(F.broadcast(found) if few else found, same, "left_anti")
    again = found.where("stays")
    if again.limit(1).count():
        sortable = [f"c{i}" for i, f in enumerate(docs.schema) if f.dataType.typeName() not in ("map", "variant")]
        several = keyed.join(F.broadcast(again) if few else again, same, "left_semi")
        one = several.groupBy(id_.cast("long").alias("_id"), "_key").agg(F.min_by(F.struct(*[f"c{i}" for i in range(len(names))]), F.struct(*sortable)).alias("_row"))
        single = single.drop("_key").unionByName(one.select("_row.*"))
    return named(single, names)
