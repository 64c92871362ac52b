"""Removal of strings that repeat anywhere in the corpus, by suffix arrays of
the places where a repeat can be."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import find_anchors
from .shared import slices, stored, texts_of
from .suffixes import maximal_repeats
from .words import _BASE, _BYTES, _INVERSE, U, _powers, mix

#: Bytes of an anchor's own string.
GRAM = 64
#: Contexts of one anchor string that a suffix array takes together; groups
#: of more are compared string by string in a pre-aggregated groupBy.
GROUP = 2000
#: Keys that may be broadcast (16 MB); more are joined by shuffling.
BROADCAST_KEYS = 1_000_000
#: Bytes of text whose anchors are found at once.
ANCHOR_BYTES = 1 << 19
#: Bytes of contexts in one suffix array.
ARRAY_BYTES = 1 << 20

#: A row's key: its id and a hash of its text.
KEY, KEY_TYPE = ["kid", "ktext"], "kid long, ktext long"
_KEY = [(k, pa.int64()) for k in KEY]
_ANCHOR = pa.schema([*_KEY, ("start", pa.int64()), ("many", pa.int32()), ("gram", pa.int64()), ("span", pa.int64())])
_SPAN = pa.schema([*_KEY, ("start", pa.int64()), ("end", pa.int64())])


def with_key(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the same id and text share a key and have the same result.
    The id is part of it, so only texts of one id could be mixed up by their
    hashes, however many rows there are."""
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull())
    return rows.withColumns(dict(zip(KEY, own, strict=True)))


def _anchors(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", ANCHOR_BYTES):
            a = find_anchors(texts_of(b.column("text")), length, GRAM)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(a.text)) for k in KEY), pa.array(a.start), pa.array(a.many.astype(np.int32)), pa.array(a.gram), pa.array(a.span)], schema=_ANCHOR)

    return texts.mapInArrow(run, f"{KEY_TYPE}, start long, many int, gram long, span long")


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, single, key, start, string): the bytes of wanted anchors."""
    schema = pa.schema([("gram", pa.int64()), ("single", pa.bool_()), *_KEY, ("start", pa.int64()), ("string", pa.binary())])
    lists = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("gram", "single", "start", "many")).alias("wanted"))  # bounded by the text's length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own, rows = [], ([], [], [], [])
            for k, (raw, want) in enumerate(zip(texts_of(b.column("text")), b.column("wanted").to_pylist(), strict=True)):
                for w in want:
                    own.append(k)
                    for x, v in zip(rows, (w["gram"], w["single"], w["start"], raw[w["start"] : w["start"] + w["many"] - 1 + length]), strict=True):
                        x.append(v)
            gram, single, start, string = (pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True))
            yield pa.RecordBatch.from_arrays([gram, single, *(b.column(k).take(pa.array(own, pa.int64())) for k in KEY), start, string], schema=schema)

    return texts.join(lists, KEY).mapInArrow(run, f"gram long, single boolean, {KEY_TYPE}, start long, string binary")


def _by_suffix_array(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of maximal repeats among contexts of the same anchor string; a
    task holds whole groups, about ARRAY_BYTES at a time."""

    def solve(rows: list[tuple[bool, int, int, int, bytes]]) -> pa.RecordBatch:
        best: dict[tuple[int, int], int] = {}
        for size, places in maximal_repeats([r[4] for r in rows], length):
            for at in places:
                if rows[at[0]][0]:
                    best[at] = max(best.get(at, 0), size)
        return pa.RecordBatch.from_arrays([*(pa.array([rows[i][f] for i, _ in best], pa.int64()) for f in (1, 2)), pa.array([rows[i][3] + p for i, p in best], pa.int64()), pa.array([rows[i][3] + p + n for (i, p), n in best.items()], pa.int64())], schema=_SPAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bool, int, int, int, bytes]] = []
        size, last = 0, None
        for b in batches:
            ids, texts = (b.column(k).to_pylist() for k in KEY)
            for gram, single, id_, text, start, string in zip(b.column("gram").to_pylist(), b.column("single").to_pylist(), ids, texts, b.column("start").to_pylist(), b.column("string").to_pylist(), strict=True):
                if gram != last and size >= ARRAY_BYTES:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append((single, id_, text, start, string))
                size, last = size + len(string), gram
        if rows:
            yield solve(rows)

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, f"{KEY_TYPE}, start long, end long")


def _by_string(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the strings of `length` bytes that several of the contexts
    have, for groups of any size: counted by the hashes of the anchor and of
    the string, 128 bits, with partial counts."""
    schema = pa.schema([("gram", pa.int64()), ("hash", pa.int64()), ("single", pa.bool_()), *_KEY, ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                strings = part.column("string").to_pylist()
                sizes = np.fromiter(map(len, strings), np.int64, len(strings))
                buf = np.frombuffer(b"".join(strings), np.uint8)
                total = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[buf] * _powers(_BASE, len(buf)))])
                many = sizes - length + 1
                own = np.repeat(np.arange(len(sizes)), many)
                place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                at = (np.cumsum(sizes) - sizes)[own] + place
                h = mix((total[at + length] - total[at]) * _powers(_INVERSE, len(buf))[at])
                yield pa.RecordBatch.from_arrays([part.column("gram").take(pa.array(own)), pa.array(h.view(np.int64)), part.column("single").take(pa.array(own)), *(part.column(k).take(pa.array(own)) for k in KEY), pa.array(part.column("start").to_numpy()[own] + place)], schema=schema)

    strings = stored(contexts.mapInArrow(run, f"gram long, hash long, single boolean, {KEY_TYPE}, start long"), "strings")
    often = stored(strings.groupBy("gram", "hash").agg(F.count("*").alias("n")).where("n > 1").select("gram", "hash"), "often-strings")
    return strings.where("single").join(often, ["gram", "hash"]).select(*KEY, "start", (F.col("start") + length).alias("end"))


def repeated_spans(texts: DataFrame, length: int = 200, group: int = GROUP, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(kid, ktext, start, end) in bytes, overlapping and repeated, that together
    cover every string of `length` bytes which also starts elsewhere, of texts
    (kid, ktext, text).

    Every such string holds an anchor, the place of its smallest 64-byte hash,
    about one for every 70 bytes.  Anchors whose 64 bytes occur once are left.
    Of the others, those whose whole covered bytes occur again are repeated as
    they are.  What is left, one context for each different one, is where a
    repeat begins or ends: contexts are dealt by the anchor's bytes, and a
    task finds their maximal repeats in an enhanced suffix array.
    """
    anchors = _anchors(texts, length)
    # stored, so that the join reads two exchanges and adaptive execution can split a gram that many rows have
    often = stored(anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "often")
    hot = stored(anchors.join(often, "gram"), "anchors")
    by_span = stored(hot.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "start", "many")).alias("one")), "by-span")
    # the hash of the anchor and that of all its bytes: 128 bits
    known = hot.join(by_span.where("n > 1").select("gram", "span"), ["gram", "span"]).select(*KEY, "start", (F.col("start") + F.col("many") - 1 + length).alias("end")).distinct()
    several = stored(by_span.groupBy("gram").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
    wanted = stored(by_span.join(several, "gram").select("gram", (F.col("n") == 1).alias("single"), *[f"one.{k}" for k in KEY], "one.start", "one.many", (F.col("contexts") > group).alias("large")), "wanted")
    keys = stored(wanted.select(*KEY).distinct(), "keys")
    few = keys.count() <= broadcast_keys
    chosen = stored(texts.join(F.broadcast(keys) if few else keys, KEY, "left_semi").dropDuplicates(KEY), "texts")
    spans = known.unionByName(_by_suffix_array(_contexts(chosen, wanted.where("not large"), length), length))
    if wanted.where("large").limit(1).count():
        spans = spans.unionByName(_by_string(_contexts(chosen, wanted.where("large"), length), length))
    return spans


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of each row: the maximal runs of
    removed bytes, and the other bytes joined (binary, for a character may be
    cut).

    Null is an empty text; texts shorter than `length` bytes keep all; rows
    that repeat lose all their bytes if they are long enough, for each is
    elsewhere too; a null id is an id like others; an empty table gives no
    rows.  Strings are told apart byte by byte in the suffix arrays, and elsewhere by
    128 bits of hashes.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = with_key(source, "doc_id", "text")
    spans = stored(repeated_spans(keyed.select(*KEY, "text").where(F.octet_length("text") >= length), length, **options), "spans")
    merged = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # bounded by the text's length
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", kind), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            removed, kept, raws = [], [], texts_of(b.column("text"))
            for raw, spans in zip(raws, b.column("spans").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in spans or []):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(e, runs[-1][1])
                    else:
                        runs.append([s, e])
                at, left = 0, []
                for s, e in runs:
                    left.append(raw[at:s])
                    at = e
                kept.append(b"".join([*left, raw[at:]]))
                removed.append([{"start": s, "end": e} for s, e in runs])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(list(map(len, raws)), pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], schema=schema)

    return keyed.join(merged, KEY, "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
