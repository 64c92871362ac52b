"""Links between texts that must not be on both sides of a split: equal ones,
near copies, and windows shared with protected texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored
from .bloom import MOST, bloom
from .components import components
from .windows import Sets, windows


def _needed(n: F.Column, percent: int) -> F.Column:
    """How many of a set's rarest elements must be looked at: two sets of that
    similarity share one of the first n - ceil(percent n) + 1 of either."""
    return n - F.ceil(F.lit(percent / 100) * n) + 1


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, either) of the pairs that are as similar as asked, on
    full sets."""
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("x")), sets.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.withColumn("either", F.size("x") + F.size("y") - F.col("shared")).where(100 * F.col("shared") >= percent * F.col("either")).select("a", "b", "shared", "either")


@dataclass
class Linked:
    """What `link_texts` finds, stored: members (id, rep) of every row, equal
    texts having one representative; near (a, b), links between these that
    connect all that is linked; of (rep, component), for linked ones."""

    members: DataFrame
    near: DataFrame
    of: DataFrame

    def labelled(self) -> DataFrame:
        """(id, rep, component) of every row."""
        return self.members.join(self.of, "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("component"))


#: Ids whose table may be broadcast (some 64 MB); texts of more are shuffled.
BROADCAST_IDS = 2_000_000
#: Slots of the table that says which windows are frequent (1 MB), how many
#: windows it marks at most, and of how many texts one is counted for it.
SLOTS, MARKED, SAMPLED = 1 << 23, 1 << 18, 16
#: Parts in which the texts with a frequent window meet.
PARTS = 64
#: Counts that are told apart.
LEVELS = 1000


def frequent(whole: DataFrame, n: int) -> DataFrame:
    """One row (bits): a bit for each slot of window hashes, set for windows
    that several of a sixteenth of the different texts have, those of most
    texts first if they are too many.  A window is counted by itself, so what
    few texts share is told from what many do, however large the table.  It
    only says in which order elements are looked at: any order finds the same
    links."""
    h = F.xxhash64("text")
    drawn = whole.where(F.pmod(h, F.lit(SAMPLED)) == 0)
    one = stored(drawn.groupBy(h.alias("h")).agg(F.min("id").alias("id")).select("id"))  # of equal texts
    few = F.broadcast(one) if one.count() <= BROADCAST_IDS else one  # else texts are shuffled
    counted = stored(windows(drawn.join(few, "id", "left_semi"), n).groupBy("g").agg(F.count("*").alias("c")).where("c > 1"))
    level, marked = LEVELS, 0
    for r in counted.groupBy(F.least("c", F.lit(LEVELS)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():
        marked += r["n"]
        if marked > MARKED:
            break
        level = r["c"]
    slot = F.pmod("g", F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = [0] * (SLOTS // 64)
    for r in counted.where(F.col("c") >= level).groupBy((slot / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).collect():  # a row a word at most
        words[r["w"]] = r["b"]
    forget(one, counted)
    return whole.sparkSession.createDataFrame([(words,)], "bits array<long>")


def _is_frequent(g: F.Column) -> F.Column:
    place = F.pmod(g, F.lit(SLOTS))
    word = F.get(F.col("bits"), (place / 64).cast("int"))
    return F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


#: Elements whose bitmaps are made at once.
AT_ONCE = 1_000_000


BITMAPS = "id bigint, n int, p array<bigint>"


def bitmaps(sets: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(id, n, p): of each set of hashes (id, s) its size and a bitmap of at
    least two bits an element, a power of two and whole words: whether an odd
    number of elements falls on a bit."""
    return sets.mapInArrow(_bitmaps(at_once), BITMAPS)


def _bitmaps(at_once: int = AT_ONCE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What `bitmaps` makes of batches.  The functions are in here, so they
    travel by value and the workers need not find this package."""

    def parity(s: pa.ListArray, sizes: np.ndarray) -> pa.ListArray:
        bits = 1 << np.ceil(np.log2(np.maximum(2 * sizes, 64))).astype(np.int64)
        ends = np.cumsum(bits)
        places = np.repeat(ends - bits, sizes) + (s.flatten().to_numpy() & np.repeat(bits - 1, sizes))
        odd = (np.bincount(places, minlength=ends[-1]) & 1).astype(np.uint8)
        return pa.ListArray.from_arrays(np.concatenate([[0], ends // 64]).astype(np.int32), np.packbits(odd, bitorder="little").view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.diff(b.column("s").offsets.to_numpy())
            cuts = np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // at_once, prepend=0, append=-1))
            for low, high in zip([0, *cuts], [*cuts, len(n)], strict=False):
                if high > low:
                    part, sizes = b.slice(low, high - low), n[low:high]
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes.astype(np.int32)), parity(part.column("s"), sizes.astype(np.int64))], names=["id", "n", "p"])

    return run


def _apart(x: F.Column, y: F.Column) -> F.Column:
    """On how many bits two bitmaps differ, the longer one folded: at most the
    number of elements that only one of the sets has."""
    words = F.least(F.size(x), F.size(y))
    fold = lambda m: F.when(F.size(m) > words, F.zip_with(F.slice(m, F.lit(1), words), F.slice(m, words + 1, words), lambda u, v: u.bitwiseXOR(v))).otherwise(m)
    return F.aggregate(F.zip_with(fold(x), fold(y), lambda u, v: u.bitwiseXOR(v)), F.lit(0), lambda n, w: n + F.bit_count(w).cast("int"))


@dataclass
class Elements:
    """Rows (id, text), which texts are equal, and the elements of which
    similar sets must share one; all but `whole` stored."""

    whole: DataFrame
    sets: Sets
    percent: int
    members: DataFrame  # (id, rep) of every row
    rare: DataFrame  # (g, id, n, a, na): representatives with an element that another has too, and the first that has it

    def fits(self, a: str, b: str) -> F.Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def _of(self, pairs: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What is made of the rows that meet, stored."""
        met = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
        few = F.broadcast(met) if met.count() <= BROADCAST_IDS else met
        out = stored(made(self.whole.join(few, "id", "left_semi")))
        forget(met)
        return out

    def enough(self, rows: DataFrame, apart: str | None = None) -> DataFrame:
        """(a, b) that meet on elements of rows (g, id, n), differ in the
        column `apart`, if named, and share enough elements to be similar at
        all.

        What an id shares with anybody bounds what it shares with one other,
        so most pairs go where they meet, before anything is shuffled by pair.
        """
        counted = stored(rows.withColumn("s", F.count("*").over(Window.partitionBy("id")).cast("int")))
        end = lambda e: counted.select("g", F.col("id").alias(e), F.col("n").alias(f"n{e}"), F.col("s").alias(f"s{e}"), *[F.col(c).alias(f"_{e}") for c in [apart] if c])  # noqa: E731  alike, so they are shuffled once
        # what two sets share is what their quarters share and, beyond the quarter that ends first, at most its set's rest
        rest_of = lambda n: n - _needed(n, self.percent)
        wanted = F.ceil(F.lit(self.percent / (100 + self.percent)) * (F.col("na") + F.col("nb")) - 1e-6)
        reach = lambda c: c + F.greatest(rest_of(F.col("na")), rest_of(F.col("nb"))) >= wanted
        on = (F.col("a") < F.col("b")) & self.fits("na", "nb") & reach(F.least("sa", "sb"))
        together = end("a").join(end("b"), "g").where(on & (F.col("_a") != F.col("_b")) if apart else on).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
        out = stored(together.where(reach(F.col("c"))).select("a", "b"))
        forget(counted)
        return out

    def linked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared, either), stored, of the stored pairs that are as
        similar as asked.

        Bitmaps of the sets' elements by parity, a thirtieth of their size,
        bound from below how many elements only one of the two has; what they
        leave open is compared on full sets, so no pair is lost.
        """
        marks = self._of(pairs, lambda rows: self.sets.whole(rows, _bitmaps(), BITMAPS))  # by the same workers
        end = lambda i, n, p: marks.select(F.col("id").alias(i), F.col("n").alias(n), F.col("p").alias(p))
        both = pairs.join(end("a", "na", "x"), "a").join(end("b", "nb", "y"), "b")
        close = stored(both.where(_apart(F.col("x"), F.col("y")) * (100 + self.percent) <= (100 - self.percent) * (F.col("na") + F.col("nb"))).select("a", "b").distinct())
        forget(marks)
        full = self._of(close, self.sets.whole)
        out = stored(similar(close, full, self.percent).distinct())
        forget(close, full)
        return out


def shared_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> Elements:
    """Equal texts and rare elements of what is left.

    One map makes each text's key, two 64-bit hashes of its set; equal sets are
    one node, so copies cost one.  A second one makes the sets anew, rather
    than read them from disk, and leaves of each node's the quarter of its
    elements, infrequent ones first, of which a similar set must have one in
    its own quarter.  Elements are shuffled once, frequent ones, which one task
    might not hold, in parts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).where("id is not null")
    sets, bits = Sets(n), frequent(whole, n)
    keyed = stored(sets.keys(whole))
    key = ["id", "k1", "k2"]
    reps = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    members = stored(keyed.join(reps, ["k1", "k2"]).select(*key, "rep"))
    copies, firsts = (stored(members.where(c).select(*key).distinct()) for c in ("id <> rep", "id = rep"))
    some = sets.first(whole, percent, bits.first()["bits"]).where("n > 0")
    fewer, how = min((copies.count(), "left_anti"), (firsts.count(), "left_semi"))
    other = copies if how == "left_anti" else firsts
    nodes = some.join(F.broadcast(other) if fewer <= BROADCAST_IDS else other, key, how)
    each = nodes.select("id", "n", F.explode("first").alias("g")).crossJoin(F.broadcast(bits))  # one row
    part = F.when(_is_frequent(F.col("g")), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).otherwise(-1)
    w = Window.partitionBy("g", "part")
    met = each.select("id", "n", "g", part.alias("part")).withColumns({"h": F.min(F.struct("id", "n")).over(w), "k": F.count("*").over(w)})
    held = stored(met.where("part >= 0 or k > 1").drop("k"))
    once, often = held.where("part < 0"), held.where("part >= 0")
    heads = often.groupBy("g").agg(F.min("h").alias("h"), F.count("*").alias("k")).where("k > 1")
    columns = ["g", "id", "n", F.col("h.id").alias("a"), F.col("h.n").alias("na")]
    rare = stored(once.select(*columns).unionByName(often.drop("h").join(heads, "g").select(*columns)))
    forget(keyed, copies, firsts, held)
    return Elements(whole, sets, percent, members.select("id", "rep"), rare)


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(a, b, shared, either), stored, of all pairs of different sets of n
    words with a similarity of `percent` or more, between representatives."""
    found = shared_elements(docs, id_col, text_col, n, percent)
    pairs = found.enough(found.rare.select("g", "id", "n"))
    out = found.linked(pairs)
    forget(found.rare, pairs)
    return out


def link_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> Linked:
    """Which texts are equal or near copies: of normalised text, or on sets of
    n words with a similarity of `percent` or more.

    A node meets the first node of each of its elements; what is similar
    is one component and needs no further look.  Then nodes of different
    components that share elements meet, if they share enough of them to be
    similar at all, so a family of near copies costs about its size, not its
    square, and no link between components is missed.
    Whole sets are made anew for the nodes that meet, from their texts.  Texts
    of fewer than n words are linked by equality alone; a null text is an
    empty one; rows without an id are left out.
    """
    found = shared_elements(docs, id_col, text_col, n, percent)
    rare = found.rare
    pairs = stored(rare.where((F.col("a") < F.col("id")) & found.fits("na", "n")).select("a", F.col("id").alias("b")).distinct())
    first = found.linked(pairs).select("a", "b")
    of = stored(components(first))
    names = of.withColumnRenamed("node", "id")
    labelled = stored(rare.select("id", "n", "g").join(F.broadcast(names) if of.count() <= BROADCAST_IDS else names, "id", "left").withColumn("component", F.coalesce("component", "id")))
    open_ = labelled.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("g")
    left = stored(labelled.join(open_, "g", "left_semi"))
    forget(rare, labelled)
    met = found.enough(left, "component")
    more = stored(met.join(pairs, ["a", "b"], "left_anti"))
    forget(pairs, left, met)
    near = first
    if more.limit(1).count():
        second = found.linked(more).select("a", "b")
        if second.limit(1).count():
            near = stored(first.unionByName(second))
            of = stored(components(near))
    forget(more)
    return Linked(found.members, near, of.withColumnRenamed("node", "rep"))


def protected_windows(docs: DataFrame, protected: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST, short: bool = False) -> DataFrame:
    """(id, g) of each different window of n words that a row shares with a
    protected text, g its hash; with `short`, texts of fewer words are a window.

    The protected windows fill a Bloom filter, if its size allows, which the
    rows' windows pass before anything is shuffled; what is left of them is
    joined with the windows themselves, so the filter changes no row.
    """
    held = stored(windows(protected.select(F.lit(0).alias("id"), "text"), n, short).select("g").distinct())
    found = bloom(held, "g", most_bits)
    rows = windows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, short, found and (found[0].first()["bits"], found[1]))
    return rows.join(held, "g", "left_semi").select("id", "g")


def shared_windows(docs: DataFrame, protected: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """(id) of the rows that share n consecutive words with a protected text,
    or, with `short`, all of fewer."""
    return protected_windows(docs, protected, n, id_col, text_col, short=short).select("id").distinct()


def exclusions(docs: DataFrame, protected: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 8) -> DataFrame:
    """(id, verdict) of every row with an id, stored: `contaminated` if it is
    a protected text or shares n words in a row with one, `equal` or `near` if
    it is not the first of its component of copies, else `kept`."""
    linked = link_texts(docs, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    contaminated = stored(shared_windows(own, protected, n, "id", short=True))
    verdict = F.when(F.col("id") != F.col("rep"), "equal").when(F.col("id") != F.col("component"), "near").otherwise("kept")
    left = linked.labelled().join(contaminated, "id", "left_anti").select("id", verdict.alias("verdict"))
    return stored(left.unionByName(contaminated.where("id is not null").withColumn("verdict", F.lit("contaminated"))))


def leak_free_split(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", family: str | None = None, share: float = 0.10, linked: Linked | None = None) -> DataFrame:
    """The rows of docs with `component` and `split`: components of linked
    texts, not rows, go to one side, in the order of their names' sha256.

    Rows of a family, where one is named, are linked to each other as well,
    so neither a family nor a near copy of one of its texts is on both sides;
    rows without a family are linked by their texts alone.  Rows without an
    id are left out, since nothing could be said of them.  Fewer than two
    components cannot be split.
    """
    from .split import family_split

    found = linked or link_texts(docs, id_col, text_col)
    of = found.of
    if family:
        own = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(family).alias("f")).where("f is not null").join(found.members, "id").select("f", "rep").distinct())
        first = own.groupBy("f").agg(F.min("rep").alias("a"))
        of = stored(components(found.near.unionByName(own.join(first, "f").select("a", F.col("rep").alias("b"))))).withColumnRenamed("node", "rep")
    labelled = stored(Linked(found.members, found.near, of).labelled().select(F.col("id").alias("_linked"), "component").distinct())
    joined = docs.drop("component", "split").join(labelled, F.col(id_col).cast("long") == F.col("_linked")).drop("_linked")
    return family_split(joined, "component", share)
