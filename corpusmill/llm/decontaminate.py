"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
test questions and answers, every document scanned once.

A window of n words holds one whole block of (n + 1) // 2 words that begins at
a multiple of that size in its item.  So the automaton holds each benchmark
word once, in its block, and not once for every window over it; where a block
is found, the windows around it are looked up and compared word by word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normal import Normal, automaton, word_list
from .shared import named, numbered, stored, texts_of
from .words import ALNUM, U, mix, words

#: Bytes of benchmark text that are broadcast and held in one automaton, which
#: takes about 70 bytes for each.  A larger benchmark is dealt to several, and
#: the documents pass them one after the other, stored in between.
BENCHMARK_BYTES = 4 << 20

_built: dict[str, Benchmark] = {}


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    out = np.zeros(max(len(h) - n + 1, 0), U)
    for k in range(n):
        out = mix(out * U(0x2545F4914F6CDD1D) + h[k : k + len(out)])
    return out


@dataclass
class Benchmark:
    """Items (id, text) prepared for a scan: the automaton, the sorted hashes
    of all different windows, one place of each, and the items that have it."""

    items: list[tuple[str | None, bytes]]
    n: int = 13
    machine: object = None
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U))

    def prepare(self) -> Benchmark:
        n, size = self.n, (self.n + 1) // 2
        phrases: dict[str, list] = {}  # phrase: words, items of a whole short item, whether it is a block
        self.names = sorted({i for i, _ in self.items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        self.words: list[list[str]] = []
        hashes, owners, places = [], [], []
        one: dict[str, str] = {}  # of equal words one object is kept
        for item, raw in self.items:
            w = [one.setdefault(x, x) for x in word_list(raw)]
            if 0 < len(w) < n:
                at = phrases.setdefault(" ".join(w), [len(w), None, False])
                at[1] = (at[1] or set()) | ({item} - {None})
            elif w:
                for k in range(0, len(w) - size + 1, size):
                    phrases.setdefault(" ".join(w[k : k + size]), [size, None, False])[2] = True
                h = window_hashes(words([raw], ALNUM).hash, n)
                hashes.append(h)
                owners.append(np.full(len(h), number.get(item, -1)))
                places.append(np.stack([np.full(len(h), len(self.words)), np.arange(len(h))], axis=1))
                self.words.append(w)
        self.machine = automaton(phrases)
        if hashes:
            h, owner, place = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places).astype(np.int32)
            self.hashes, at = np.unique(h, return_index=True)
            self.place = place[at]
            pairs = np.unique(np.stack([np.searchsorted(self.hashes, h), owner], axis=1)[owner >= 0], axis=0)
            self.first = np.searchsorted(pairs[:, 0], np.arange(len(self.hashes) + 1))
            self.owner = pairs[:, 1].astype(np.int32)
        return self

    def hits(self, doc: Normal) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged runs of hit words [first, end), and the ids found."""
        spans, found = [], set()
        starts: set[int] = set()
        if doc.text and len(self.machine):
            for end, (size, ids, block) in self.machine.iter(doc.text):
                last = doc.word_before(end)
                if ids is not None:
                    spans.append((last - size, last))
                    found.update(ids)
                if block:
                    starts.update(range(max(last - self.n, 0), min(last - size, doc.words - self.n) + 1))
        if starts:
            h = window_hashes(words([doc.raw], ALNUM).hash, self.n)
            at = np.array(sorted(starts))
            where = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            parts = doc.text[1:-1].split(" ")  # at spaces alone: bytes 85 and A0 are of words, and str.split() would part there
            for s, k in zip(at[self.hashes[where] == h[at]].tolist(), where[self.hashes[where] == h[at]].tolist(), strict=True):
                item, place = self.place[k].tolist()
                if parts[s : s + self.n] == self.words[item][place : place + self.n]:
                    spans.append((s, s + self.n))
                    found.update(self.names[i] for i in self.owner[self.first[k] : self.first[k + 1]].tolist())
        return merge(spans), sorted(found)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """The columns of docs, and `_found`: struct(n_words, n_hit, spans of the
    original text in bytes, item ids).

    The benchmark is the side of a checked size: its bytes are summed first.
    Up to `most_bytes` it is one broadcast, one automaton in each worker and
    one map over the documents, without a shuffle.  More is dealt by a hash of
    the text into parts that are gone through one after the other.  A null or
    empty text has no words and no hits; an empty benchmark hits nothing;
    repeated items count by id; an item without an id hits but is not
    reported; documents may repeat.  Windows are found by 64-bit hashes and
    then compared.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // most_bytes))
    names = docs.columns
    place = f"c{names.index(text_col)}"
    inner = [f"c{i}" for i in range(len(names))]
    state = "struct<n_words:long,n_hit:long,spans:array<struct<start:long,end:long>>,runs:array<struct<start:long,end:long>>,items:array<string>>"
    out = numbered(docs).withColumn("_found", F.lit(None).cast(state))
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
    for part in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect() if parts > 1 else items.collect()
        held = spark.sparkContext.broadcast(Benchmark([(r["item"], r["text"].encode()) for r in chosen], n))
        name = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _built:
                _built.clear()
                _built[name] = held.value.prepare()
            bench = _built[name]
            for b in batches:
                found = []
                for raw, old in zip(texts_of(b.column(place)), b.column("_found").to_pylist(), strict=True):
                    doc = Normal(raw)
                    runs, ids = bench.hits(doc)
                    if old:
                        runs = merge(runs + [(r["start"], r["end"]) for r in old["runs"]])
                        ids = sorted({*ids, *old["items"]})
                    first, end = doc.bounds() if runs else ([], [])
                    found.append({"n_words": doc.words, "n_hit": sum(e - s for s, e in runs), "spans": [{"start": int(first[s]), "end": int(end[e - 1])} for s, e in runs], "runs": [{"start": s, "end": e} for s, e in runs], "items": ids})
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in inner), pa.array(found, kind)], names=[*inner, "_found"])

        out = out.mapInArrow(scan, out.schema)
        if part < parts - 1:
            out = stored(out, "scanned")
    return named(out.withColumn("_found", F.col("_found").dropFields("runs")), names, "_found")


def is_contaminated(found: str = "_found", share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    return (F.col(f"{found}.n_hit") > 0) & (share * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, n)
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        F.col("_found.n_hit").alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_found.items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )
