"""Ranked lexical search by Block-Max WAND over shards of compressed posting
blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .postings import BLOCK, Lists, inverted, terms_of
from .shared import stored, texts_of

#: Bytes of text of a shard, or one document; bytes of terms of the queries
#: that are broadcast at once.
SHARD_BYTES, QUERY_BYTES = 8 << 20, 4 << 20
#: Shards of a search task, whose thresholds rise from one to the next, and
#: most tasks, which then take more shards each.
SHARDS, MOST_TASKS = 4, 20_000
COLUMNS = ("lasts", "sizes", "tops", "pairs", "data")
INDEX = "shard long, term binary, df long, " + ", ".join(f"{c} binary" for c in COLUMNS) + ", ids array<long>, lengths array<int>"
_SCHEMA = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), *((c, pa.binary()) for c in COLUMNS), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, block: int = BLOCK) -> DataFrame:
    """One row a shard and term, with its posting list, and one row a shard
    with the ids and lengths of its documents (term null); a stored table.

    A shard is a run of a task's documents of at most `shard_bytes`, or one
    longer document, so no list of a frequent term is longer than a shard and
    nothing is shuffled.  Documents without terms, null texts among them, are
    not in the index; null ids stay; repeated rows are documents each; other
    columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def shard() -> Iterator[pa.RecordBatch]:
            n, columns = inverted(texts, block)
            some = np.flatnonzero(n)
            if not len(some):
                return
            # texts without terms have no postings: the others keep their numbers
            one = lambda v, t: pa.array([v], t)
            null = {c: one(None, pa.binary()) for c in ("term", *COLUMNS)}
            own = {"shard": one(task + made, pa.int64()), **null, "df": one(len(some), pa.int64()), "ids": one(ids, _SCHEMA.field("ids").type), "lengths": one(n.tolist(), _SCHEMA.field("lengths").type)}
            yield pa.RecordBatch.from_arrays([own[f.name] for f in _SCHEMA], schema=_SCHEMA)
            rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(columns["term"]), task + made)), *(columns[c] for c in ("term", "df", *COLUMNS)), *(pa.nulls(len(columns["term"]), _SCHEMA.field(c).type) for c in ("ids", "lengths"))], schema=_SCHEMA)
            for k in range(0, rows.num_rows, 16_384):
                yield rows.slice(k, 16_384)

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), texts_of(b.column("text")), strict=True):
                if texts and held + len(t) > shard_bytes:
                    yield from shard()
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield from shard()

    return stored(source.mapInArrow(run, INDEX), "index")  # shards are named by the task that made them


def query_terms(items: DataFrame) -> DataFrame:
    """(item, terms): the different terms of each text, sorted; other columns
    go.  Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, term, first = terms_of(texts_of(b.column("text")))
            names = term.to_pylist()
            lists = [sorted({names[k] for k in np.unique(number[s:e]).tolist()}) for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(lists, pa.list_(pa.binary()))], names=["item", "terms"])

    return items.select("item", F.col("text").cast("string").alias("text")).mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, terms array<binary>")


class Impacts:
    """What a posting is worth: weights by term, statistics of the corpus."""

    def __init__(self, documents: int, total: int, df: dict[bytes, int]) -> None:
        self.documents, self.total = documents, total
        self.weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for t, d in df.items()}

    def length(self, n: np.ndarray) -> np.ndarray:
        return 50 + (50 * n * self.documents) // self.total

    @staticmethod
    def of(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Shard:
    """One shard's lists of the asked terms, with headers open and blocks
    closed; what is decompressed once serves all queries."""

    def __init__(self, rows: dict[bytes, dict[str, bytes]], lengths: np.ndarray, impacts: Impacts) -> None:
        self.place = {t: k for k, t in enumerate(rows)}
        self.weight = np.array([impacts.weight[t] for t in rows], np.int64)
        self.m = impacts.length(lengths.astype(np.int64))
        self.lists = Lists.of({c: [r[c] for r in rows.values()] for c in COLUMNS}, lambda k, tf, n: impacts.of(self.weight[k], tf, impacts.length(n)))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.score = np.zeros(len(lengths), np.int64)
        self.impacts, self.opened = impacts, 0

    def decompress(self, blocks: np.ndarray) -> None:
        new = np.array([b for b in blocks.tolist() if b not in self.open], np.int64)
        if len(new):
            self.opened += len(new)
            of, doc, tf = self.lists.postings(new)
            worth = self.impacts.of(self.weight[self.lists.term[new[of]]], tf, self.m[doc])
            cut = np.searchsorted(of, np.arange(len(new) + 1))
            for k, b in enumerate(new.tolist()):
                self.open[b] = doc[cut[k] : cut[k + 1]], worth[cut[k] : cut[k + 1]]

    def search(self, terms: list[bytes], most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of those that can be among the `most` best, given
        that `floor` is the score of the worst of as many found elsewhere.

        The documents are cut where a block of any list ends.  A shallow move
        puts every list's pointer on the block that holds such a range, which
        reads headers only; a range whose blocks' largest impacts add up to
        less than the threshold is skipped with all of them compressed.  The
        others are scored, those with the highest bounds first, and each that
        is scored raises the threshold for the rest.
        """
        x = self.lists
        lists = [self.place[t] for t in terms if t in self.place]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # lists of one block are short: their first block is opened at once, and each posting is a range
        short = [k for k in lists if x.first[k + 1] - x.first[k] == 1]
        self.decompress(x.first[short])
        single = [self.open[int(x.first[k])] for k in short]
        cuts = [x.last[x.first[k] : x.first[k + 1]] for k in lists]
        for doc, _ in single:
            cuts += [doc, np.maximum(doc - 1, 0)]
        edge = np.unique(np.concatenate(cuts))
        bound = np.zeros(len(edge), np.int64)
        pointer = np.full((len(lists), len(edge)), -1)
        for i, k in enumerate(lists):
            a, b = x.first[k], x.first[k + 1]
            if b - a == 1:
                doc, worth = self.open[int(a)]
                at = np.searchsorted(edge, doc)
                bound[at] += worth
                pointer[i, at] = a
            else:
                at = np.searchsorted(x.last[a:b], edge)
                on = np.flatnonzero(at < b - a)
                bound[on] += x.top[a + at[on]]
                pointer[i, on] = a + at[on]
        order = np.argsort(-bound, kind="stable")
        threshold, start, step = max(floor, 1), 0, 8
        best_doc, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low = np.append(-1, edge[:-1])
        while start < len(order) and bound[order[start]] >= threshold:
            part = order[start : start + step]
            part = part[bound[part] >= threshold]
            start, step = start + step, min(step * 2, 512)
            chosen = np.unique(pointer[:, part])
            chosen = chosen[chosen >= 0]
            self.decompress(chosen)
            for b in chosen.tolist():
                doc, worth = self.open[b]
                self.score[doc] += worth
            touched = np.unique(np.concatenate([self.open[b][0] for b in chosen.tolist()]))
            inside = np.zeros(len(edge) + 1, bool)
            inside[part] = True
            at = np.searchsorted(edge, touched)
            mine = touched[inside[at] & (touched > low[np.minimum(at, len(low) - 1)])]
            good = mine[self.score[mine] >= threshold]
            best_doc, best_score = np.append(best_doc, good), np.append(best_score, self.score[good])
            self.score[touched] = 0
            if len(best_score) > most:
                worst = np.partition(best_score, len(best_score) - most)[len(best_score) - most]
                threshold = max(threshold, int(worst))
                keep = best_score >= threshold
                best_doc, best_score = best_doc[keep], best_score[keep]
        return best_doc, best_score


def _bests(ids: np.ndarray, null: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best: by score, then by id, null ids last."""
    return np.lexsort((ids, null, -score))[:most]


def search(index: DataFrame, items: DataFrame, most: int = 50, item_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` best documents of each item,
    with a score above 0, by score, equal ones by id (null ids last).

    N, L and the terms' document frequencies are sums over the whole index.
    Items with the same terms are asked once.  The different term sets are
    dealt to parts of at most `query_bytes` by their hash, a part is
    broadcast, and the lists of its terms go to one task a shard; the next
    part follows.  A task keeps the best of each query over its shards, so it
    sends at most `most` rows a query, and its threshold rises from shard to
    shard.  Every row of items is an item; one without terms has no results.
    An empty index gives no rows.
    """
    spark = index.sparkSession
    asked = stored(query_terms(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))).where(F.size("terms") > 0).withColumn("query", F.sha2(F.concat_ws(" ", F.transform("terms", F.hex)), 256)), "items")
    distinct = stored(asked.groupBy("query").agg(F.first("terms").alias("terms")), "asked")
    size = distinct.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 8))).first()[0] or 0
    parts = max(1, -(-size // query_bytes))
    stats = index.where("term is null").agg(F.count("*").alias("shards"), F.sum("df").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    kind = items.schema[item_col].dataType.simpleString()
    tasks = min(max(1, -(-stats["shards"] // SHARDS)), MOST_TASKS)
    if not size or not stats["n"]:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = pa.schema([("query", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])
    found = None
    for part in range(parts):
        own = distinct.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part) if parts > 1 else distinct
        terms = own.select(F.explode("terms").alias("term")).distinct()
        lists = index.join(F.broadcast(terms), "term")  # query_bytes at most, and a hash's deviation
        df = {bytes(r["term"]): r["df"] for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        if not df:
            continue
        held = spark.sparkContext.broadcast((Impacts(stats["n"], stats["total"], df), {r["query"]: [bytes(t) for t in r["terms"]] for r in own.collect()}))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            impacts, queries = held.value
            best = {q: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for q in queries}
            rows: dict[bytes, dict[str, bytes]] = {}
            state: dict = {"shard": None, "docs": None}

            def finish() -> None:
                if state["docs"] is None or not rows:
                    return
                ids, null, lengths = state["docs"]
                shard = Shard(rows, lengths, impacts)
                for q, own_terms in queries.items():
                    i, z, s = best[q]
                    doc, score = shard.search(own_terms, most, int(s[-1]) if len(s) == most else 0)
                    if len(doc):
                        i, z, s = np.append(i, ids[doc]), np.append(z, null[doc]), np.append(s, score)
                        keep = _bests(i, z, s, most)
                        best[q] = i[keep], z[keep], s[keep]

            for b in batches:
                columns = {c: b.column(c).to_pylist() for c in ("shard", "term", *COLUMNS)}
                for k in range(b.num_rows):
                    if columns["shard"][k] != state["shard"]:
                        finish()
                        rows.clear()
                        state.update(shard=columns["shard"][k], docs=None)
                    if columns["term"][k] is None:
                        own_ids = b.column("ids")[k].values
                        state["docs"] = own_ids.fill_null(0).to_numpy(zero_copy_only=False), own_ids.is_null().to_numpy(zero_copy_only=False), b.column("lengths")[k].values.to_numpy()
                    else:
                        rows[columns["term"][k]] = {c: columns[c][k] for c in COLUMNS}
            finish()
            for q, (i, z, s) in best.items():
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array([q] * len(i)), pa.array(i, pa.int64(), mask=z), pa.array(s)], schema=out)

        shard_rows = index.where("term is null")
        # by number: lists are short, but a shard's searches are not, so small partitions are not put together
        met = lists.select(*shard_rows.columns).unionByName(shard_rows).repartition(tasks, "shard").sortWithinPartitions("shard")
        ranked = stored(met.mapInArrow(run, "query string, doc_id long, score long"), "found")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = found.withColumn("rank", place).where(F.col("rank") <= most)
    return asked.select("query", F.col("item").alias("item_id")).join(top, "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, most: int = 50, **options) -> DataFrame:
    """The `most` best documents of each item; see `build_index` and `search`."""
    return search(build_index(docs, **options), items, most)
