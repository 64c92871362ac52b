"""Revisions named by their content: what is read is what was published."""

import os
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmill.sources import files, readers, revisions, writers

SCHEMA = "id long, split string, text string, nested struct<b:int,a:array<double>>, tags map<string,int>"
ROWS = [(k, ["train", "validation"][k % 4 == 0], None if k % 5 == 0 else f"text {k}", (k, [0.5 * k, None]) if k % 3 else None, {"x": k, "a": 1} if k % 2 else None) for k in range(40)]


def rows_of(df):
    return sorted(map(str, df.select("id", "split", "text", "nested", "tags").collect()))


@pytest.fixture
def base(tmp_path):
    return str(tmp_path / "store")


def test_both_revisions_are_read_by_name_and_by_tag(spark, base):
    df = spark.createDataFrame(ROWS, SCHEMA)
    one = revisions.publish(df, base, ["split"], "v1")
    two = revisions.publish(df.where("id < 30"), base, ["split"], "v2")
    assert one != two and revisions.history(spark, base) == {"v1": one, "v2": two, one: one, two: two}
    for name in (one, "v1"):
        assert rows_of(readers.pinned(spark, base, name)) == rows_of(df)
    assert rows_of(readers.pinned(spark, base, two)) == rows_of(df.where("id < 30"))
    assert [tuple(r) for r in revisions.changed_parts(spark, base, "v1", "v2").orderBy("part").collect()] == [("split=train", 30, 22), ("split=validation", 10, 8)]
    assert revisions.changed_parts(spark, base, one, "v1").count() == 0


def test_a_name_does_not_depend_on_order_files_or_columns(spark, base):
    df = spark.createDataFrame(ROWS, SCHEMA)
    one = revisions.publish(df, base, ["split"])
    other = df.orderBy(F.desc("id")).repartition(7).select("tags", "nested", "split", "text", "id")
    assert revisions.publish(other, base, ["split"]) == one
    assert len(files.names(spark, f"{base}/data")) == 1  # equal content is kept once
    assert revisions.publish(df.withColumn("text", F.coalesce("text", F.lit("null"))), base, ["split"]) != one
    swapped = df.withColumn("text", F.when(F.col("id") == 1, "text 2").when(F.col("id") == 2, "text 1").otherwise(F.col("text")))
    assert revisions.publish(swapped, base, ["split"]) != one
    doubled = df.unionByName(df.where("id = 3"))
    assert revisions.publish(doubled, base, ["split"]) != one
    assert revisions.publish(df.limit(0), f"{base}-empty") == revisions.root({})


def test_placeholders_and_unknown_names_are_refused(spark, base):
    revisions.publish(spark.range(3), base)
    for name in ("REPLACE_ME", "", None):
        with pytest.raises(ValueError, match="pinned"):
            readers.pinned(spark, base, name)
    for name in ("main", "../x", "v 1"):
        with pytest.raises(ValueError, match="no revision"):
            readers.pinned(spark, base, name)
    for tag in ("REPLACE_V1", "../x"):
        with pytest.raises(ValueError, match="not a tag"):
            revisions.publish(spark.range(3), base, tag=tag)


def _parts(base):
    return [p for p in Path(base, "data").rglob("*.parquet") if p.is_file()]


def test_changed_missing_and_added_files_are_refused(spark, base):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    name = revisions.publish(df, base, ["split"])
    victim = next(p for p in _parts(base) if "validation" in str(p))
    kept, crc = victim.read_bytes(), victim.with_name(f".{victim.name}.crc")
    if crc.exists():
        crc.unlink()

    def refused(verify, match):
        with pytest.raises(ValueError, match=match):
            readers.pinned(spark, base, name, verify=verify)

    t = pq.read_table(victim, partitioning=None)
    pq.write_table(t.set_column(t.column_names.index("id"), "id", [[x + (x == 4) for x in t.column("id").to_pylist()]]), victim)
    refused("content", "split=validation")
    victim.write_bytes(kept)
    assert readers.pinned(spark, base, name).count() == 40
    os.rename(victim, base + "-away")
    refused("files", victim.name)
    os.rename(base + "-away", victim)
    extra = victim.with_name("more.parquet")
    extra.write_bytes(kept)
    refused("files", "more.parquet")
    refused("content", "more.parquet")
    extra.unlink()
    assert readers.pinned(spark, base, name, verify="files").count() == 40
    with pytest.raises(ValueError, match="verify by"):
        readers.pinned(spark, base, name, verify="looks")


def test_a_changed_manifest_is_refused(spark, base):
    one = revisions.publish(spark.range(5), base)
    found = revisions.resolve(spark, base, one)
    spark.createDataFrame([("", 6, "0" * 64)], "part string, rows long, digest string").write.mode("overwrite").parquet(f"{base}/{found.manifest}/parts")
    with pytest.raises(ValueError, match="manifest"):
        readers.pinned(spark, base, one)


def test_a_job_that_fails_before_its_pointer_publishes_nothing(spark, base, monkeypatch):
    name = revisions.publish(spark.range(5), base, tag="v1")
    with monkeypatch.context() as m:
        m.setattr(files, "put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            revisions.publish(spark.range(9), base, tag="v1")
    assert revisions.history(spark, base) == {"v1": name, name: name}
    assert len(revisions.sweep(spark, base)) == 2 and revisions.sweep(spark, base) == []
    assert readers.pinned(spark, base, "v1").count() == 5
    again = revisions.publish(spark.range(9), base, tag="v1")
    assert revisions.history(spark, base)["v1"] == again and readers.pinned(spark, base, "v1").count() == 9


def test_published_splits_need_both(spark, base):
    df = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="validation"):
        writers.publish_revision(df.where("split = 'train'"), base)
    with pytest.raises(ValueError, match="demonstration"):
        writers.publish_revision(df, base, demo=True)
    name = writers.publish_revision(df, base, tag="v1")
    plan = readers.pinned(spark, base, name).where("split = 'train'").select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<id:bigint>" in plan
