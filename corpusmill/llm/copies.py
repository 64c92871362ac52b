"""Exact duplicates by skew-safe combining: texts are deduplicated in each
task, digest groups are merged under a salt, and the salts' winners are
combined globally; every stage groups by the whole text.

Built-in functions only: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, named, numbered, stored

#: Into how many parts the rows of one digest may be dealt.  A digest that a
#: third of all rows share is spread over as many tasks, in the merge and in
#: the join that tells every row its group.
SALTS = 256
#: Digests whose table may be broadcast (40 MB); more are joined by shuffling.
BROADCAST_DIGESTS = 1_000_000


def unchanged(text: Column) -> Column:
    return text


def sha256(text: Column) -> Column:
    """32 bytes of a text's digest."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _salt(salts: int) -> Column:
    # one salt in a task: rows of equal texts meet before the shuffle
    return F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] = unchanged, digest: Callable[[Column], Column] = sha256, salts: int = SALTS, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha) of each row: its group's
    largest id, the group's rows, whether that id is its own, and the digest
    of its normalised text.

    1. Rows are grouped by digest, salt and whole text.  The salt is the
       task's, so the partial aggregation leaves one row a text and task
       (local), and at most tasks / salts of these meet in a merge (salted).
    2. At most `salts` winners of a text are grouped by digest and whole text
       (global).  Equal digests never make two texts one.
    3. Rows take their group by digest and salt: a digest's group is copied
       once to each salt that it has rows in, so no join key is hot.  Texts
       that share a digest without being equal take theirs by whole text.

    A null text is an empty one.  Null ids lose to all others; a group with
    no id at all has a null keep_id, and its rows count as kept.  Repeated rows
    of one id and text are rows of the group and are kept together;
    `drop_exact_copies` leaves one of them.  An empty table gives no rows, and
    other columns are not read.
    """
    whole = docs.select(F.col(id_col).alias("id"), normal(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    keyed = whole.withColumn("digest", digest(F.col("text")))
    rows = stored(keyed.select("id", "digest", _salt(salts)), "rows")

    merged = keyed.select("id", "digest", "text", _salt(salts)).groupBy("digest", "salt", "text").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    winners = merged.repartition("digest").groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    group = stored(winners.select("digest", "keep_id", "group_size", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "groups")
    shared = stored(group.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "clashes")
    clashing = shared.count()

    single = group
    if clashing:
        single = group.join(F.broadcast(shared) if clashing <= broadcast_digests else shared, "digest", "left_anti")
    here = rows.select("digest", "salt").distinct()
    dealt = stored(here.join(single, "digest"), "dealt")  # stored: adaptive execution can still split the join on it
    found = rows.join(dealt, ["digest", "salt"]).select("id", "keep_id", "group_size", "sha")
    if clashing:
        few = F.broadcast(shared) if clashing <= broadcast_digests else shared
        texts = keyed.join(few, "digest", "left_semi").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
        by_text = winners.join(few, "digest", "left_semi")
        found = found.unionByName(texts.join(by_text, ["digest", "text"]).select("id", "keep_id", "group_size", "sha"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] = unchanged, **options) -> DataFrame:
    """The rows of docs that stay, all columns as they were: of each group of
    equal texts one row, that of the largest id, and of rows that repeat it
    the one whose columns are smallest.  A table without rows stays as it is;
    columns of any name are carried along.

    Whole rows move once, to their own (id, text), which is no hot key unless
    a row itself is repeated; repeats are combined before they move.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    groups = exact_groups(docs, id_col, text_col, normal, **options).where("kept").select("doc_id", "sha").distinct()
    stays = stored(groups, "stays")
    id_, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    keyed = numbered(docs).withColumn("_sha", F.sha2(normal(F.coalesce(text.cast("string"), F.lit(""))).cast("binary"), 256))
    kept = keyed.join(stays, id_.eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("sha")), "left_semi")
    again = stored(numbered(docs).select(id_.alias("id"), normal(F.coalesce(text.cast("string"), F.lit(""))).alias("text")).groupBy("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.count("*").alias("n")).where("n > 1").select("id", "sha"), "repeated")
    if not again.limit(1).count():
        forget(again)
        return named(kept, names)
    same = id_.eqNullSafe(F.col("id")) & (F.col("_sha") == F.col("sha"))
    once = kept.join(again, same, "left_anti").drop("_sha")
    sortable = [c for c, f in zip(inner, docs.schema, strict=True) if f.dataType.typeName() not in ("map", "variant")]
    one = kept.join(again, same, "left_semi").groupBy(id_.alias("_id"), "_sha").agg(F.min_by(F.struct(*inner), F.struct(*sortable)).alias("_row"))
    return named(once.unionByName(one.select("_row.*")), names)


def copy_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row; see
    `exact_groups`."""
    return exact_groups(docs, **options).withColumnRenamed("sha", "text_sha256")
