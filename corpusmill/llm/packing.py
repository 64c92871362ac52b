"""Packing tokenised documents into fixed-length sequences: cutting stock by
column generation (cutting.py), its patterns filled with ranked documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .cutting import plan
from .shared import batch_of, slices, stored, texts_of

#: Tokens in a length class; a piece takes the room of its class at most.
STEP = 8
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids, with end_id last, cut into pieces of `capacity`
    and one shorter piece: one row a piece."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECE.split(", ")])
    tail = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.load(tokenizer)
        for b in slices(batches, "text"):
            rows: dict[str, list] = {f.name: [] for f in schema}
            for doc, ids in zip(b.column("doc_id").to_pylist(), table.encode_many([x.decode("utf-8", "replace") for x in texts_of(b.column("text"))]), strict=True):
                ids += tail
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    for k, v in zip(rows, (doc, s, len(part) // 4, zlib.crc32(part), n), strict=True):
                        rows[k].append(v)
            yield batch_of(schema, **rows)

    return source.mapInArrow(cut, PIECE)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset):
    where each piece of each document lies.

    Full pieces are sequences of their own.  The others are counted by length
    class (a few hundred counts, which is all that the driver sees), a linear
    program over cutting patterns is solved by column generation, and rounded.
    Every piece gets its rank in its class: its rank in a hash bucket plus the
    counts of the buckets before, so no class is ever in one task; the rank
    says which sequence of which pattern it goes to.  A sequence holds at most
    `capacity` ids, so the last window, by sequence, has bounded groups.

    A null text is empty, so its document is end_id alone; bytes that are no
    UTF-8 count as the replacement character; null ids stay null
    and are packed like others; repeated rows are packed as often as they
    come; an empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    buckets = min(4096, cut.count() // 5000 + 1)
    classed = cut.withColumns({"class": F.ceil(F.col("length") / STEP).cast("int"), "full": F.col("length") == capacity}).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = stored(classed.groupBy("full", "class", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    total = {(r["full"], r["class"]): r["n"] for r in counts.groupBy("full", "class").agg(F.sum("n").alias("n")).collect()}  # at most capacity / STEP + 1 rows
    sizes = sorted(c for full, c in total if not full)
    made = plan(np.array(sizes), np.array([total[False, c] for c in sizes], np.int64), capacity // STEP)
    # of each class: the first rank of each pattern that holds it, how many it holds, the pattern's first sequence
    where: dict[int, tuple[list[int], list[int], list[int]]] = {c: ([], [], []) for c in sizes}
    given, sequences = dict.fromkeys(sizes, 0), 0
    for column, times in made:
        for k in np.flatnonzero(column):
            c, held = sizes[k], int(column[k])
            for xs, x in zip(where[c], (given[c], held, sequences), strict=True):
                xs.append(x)
            given[c] += held * times
        sequences += times
    tables = {c: tuple(np.array(x, np.int64) for x in xs) for c, xs in where.items()}
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("full", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy("full", "class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = classed.withColumn("rank", F.row_number().over(order) - 1).join(before, ["full", "class", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).select(*[x.split()[0] for x in PIECE.split(", ")], "full", "class", "rank")
    names = [x.split()[0] for x in PIECE.split(", ")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, kind, full = (b.column(x).to_numpy(zero_copy_only=False) for x in ("rank", "class", "full"))
            out = np.where(full, sequences + rank, 0)
            for c in np.unique(kind[~full]):
                at = np.flatnonzero((kind == c) & ~full)
                first, held, base = tables[int(c)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                out[at] = base[k] + (rank[at] - first[k]) // held[k]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(out, pa.int64())], names=[*names, "sequence_id"])

    placed = ranked.mapInArrow(assign, f"{PIECE}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
