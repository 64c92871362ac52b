"""Datasets in revisions that are named by their content.

A revision is a folder of Parquet that nobody changes, a manifest of what is
in it, and a pointer from its name to both.  The manifest has a digest of each
partition that does not depend on the order of its rows or on how they lie in
files: a row's sha256 in four numbers of 60 bits, each added up.  The
partitions' digests are the leaves of a hash tree whose root names the
revision, so equal content has one name, and a scan can tell whether what it
reads is what was published.

    base/data/<any>/split=train/...    rows
    base/manifests/<any>/parts, files  digests by partition, files
    base/pointers/<revision or tag>    which folders, which schema
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from . import files

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
PLACEHOLDER = "REPLACE_"


def _canonical(value: Column, kind: DataType) -> Column:
    """A value whose JSON text is one for equal values: maps by sorted
    entries, structs by sorted names."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(_canonical(e["key"], kind.keyType).alias("key"), _canonical(e["value"], kind.valueType).alias("value"))))
    return value


def row_digest(schema: StructType) -> Column:
    """sha256 of the row as JSON, columns by name, nulls written out."""
    fields = [_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(schema, key=lambda f: f.name)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def part_name(columns: list[str]) -> Column:
    """`split=train/lang=de`; one part without a name where there are none."""
    named = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("__null__"))) for c in columns]
    return F.concat_ws("/", *named) if named else F.lit("")


def contents(rows: DataFrame, partition_by: list[str]) -> DataFrame:
    """(part, rows, digest): partial sums, so what is shuffled is a row a task
    and part, however skewed the parts are."""
    numbers = [F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    hashed = rows.select(part_name(partition_by).alias("part"), row_digest(rows.schema).alias("h"))
    sums = hashed.groupBy("part").agg(F.count("*").alias("rows"), *[F.sum(x).alias(f"s{k}") for k, x in enumerate(numbers)])
    return sums.select("part", "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("digest"))


def root(leaves: dict[str, str]) -> str:
    """The root of the hash tree over the partitions' digests, in the order of
    their names; nothing has a root too."""
    level = [hashlib.sha256(f"{part}:{digest}".encode()).hexdigest() for part, digest in sorted(leaves.items())] or [hashlib.sha256(b"").hexdigest()]
    while len(level) > 1:
        pairs = [level[k : k + 2] for k in range(0, len(level), 2)]
        level = [hashlib.sha256("".join(p).encode()).hexdigest() if len(p) == 2 else p[0] for p in pairs]
    return level[0]


@dataclass(frozen=True)
class Revision:
    name: str
    base: str
    data: str
    manifest: str
    rows: int
    partition_by: list[str]
    schema: StructType

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.base}/{self.data}")

    def parts(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("part string, rows long, digest string").parquet(f"{self.base}/{self.manifest}/parts")

    def files(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("file string, length long").parquet(f"{self.base}/{self.manifest}/files")


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length) of the data files below a folder, listed by Spark;
    their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return found.select(F.substring_index("path", f"/{folder.rstrip('/').rpartition('/')[2]}/", -1).alias("file"), "length")


def publish(df: DataFrame, base: str, partition_by: list[str] | None = None, tag: str | None = None) -> str:
    """Write df as a revision and return its name, the root of its content.

    The rows are written first and their manifest is made from what can be
    read back; the pointer comes last, in one rename, so a revision is there
    as a whole or not at all, and a job that is run again ends with the same.
    Content that is there already is not kept twice.  A tag is a further name,
    which moves to the new revision.
    """
    spark, keys = df.sparkSession, partition_by or []
    if tag is not None and (not NAME.fullmatch(tag) or tag.startswith(PLACEHOLDER)):
        raise ValueError(f"not a tag: {tag!r}")
    own = uuid.uuid4().hex
    data, manifest = f"data/{own}", f"manifests/{own}"
    writer = df.write.partitionBy(*keys) if keys else df.write
    writer.parquet(f"{base}/{data}")
    order = [f for f in df.schema if f.name not in keys] + [f for f in df.schema if f.name in keys]
    schema = StructType(order)
    written = spark.read.schema(schema).parquet(f"{base}/{data}")
    contents(written, keys).write.parquet(f"{base}/{manifest}/parts")
    leaves = spark.read.parquet(f"{base}/{manifest}/parts").collect()  # a row a partition
    name = root({r["part"]: r["digest"] for r in leaves})
    if files.exists(spark, f"{base}/pointers/{name}"):
        files.remove(spark, f"{base}/{data}")
        files.remove(spark, f"{base}/{manifest}")
    else:
        _listing(spark, f"{base}/{data}").write.parquet(f"{base}/{manifest}/files")
        pointer = {"revision": name, "data": data, "manifest": manifest, "rows": sum(r["rows"] for r in leaves), "partition_by": keys, "schema": schema.jsonValue()}
        files.put(spark, f"{base}/pointers/{name}", json.dumps(pointer))
    if tag is not None:
        files.put(spark, f"{base}/pointers/{tag}", json.dumps({"tag": tag, "revision": name}))
    return name


def resolve(spark: SparkSession, base: str, name: str | None) -> Revision:
    """The revision of a name or a tag; a placeholder is refused, and so is a
    name that was never published."""
    if not name or name.startswith(PLACEHOLDER):
        raise ValueError(f"revision must be pinned, not {name!r}")
    if not NAME.fullmatch(name) or not files.exists(spark, f"{base}/pointers/{name}"):
        raise ValueError(f"no revision {name!r} in {base}")
    found = json.loads(files.get(spark, f"{base}/pointers/{name}"))
    if "tag" in found:
        return resolve(spark, base, found["revision"])
    return Revision(found["revision"], base, found["data"], found["manifest"], found["rows"], found["partition_by"], StructType.fromJson(found["schema"]))


def damage(spark: SparkSession, revision: Revision, how: str = "content") -> DataFrame:
    """(what, expected, found) of all that is not as it was published: by
    `files`, the files' names and lengths, from a listing alone; by `content`,
    also every partition's rows and digest, from a scan."""
    said = lambda rows, digest: F.when(rows.isNotNull(), F.concat_ws(" ", rows.cast("string"), digest))
    want = revision.files(spark).select(F.col("file").alias("what"), F.col("length").cast("string").alias("expected"))
    have = _listing(spark, f"{revision.base}/{revision.data}").select(F.col("file").alias("what"), F.col("length").cast("string").alias("found"))
    compared = [want.join(have, "what", "full")]
    if how == "content":
        parts = revision.parts(spark).select(F.col("part").alias("what"), said(F.col("rows"), F.col("digest")).alias("expected"))
        now = contents(revision.table(spark), revision.partition_by).select(F.col("part").alias("what"), said(F.col("rows"), F.col("digest")).alias("found"))
        compared.append(parts.join(now, "what", "full"))
    elif how != "files":
        raise ValueError(f"verify by content or by files, not by {how!r}")
    return reduce(DataFrame.unionByName, compared).where(~F.col("expected").eqNullSafe(F.col("found")))


def scan(spark: SparkSession, base: str, name: str | None, verify: str | None = "content") -> DataFrame:
    """The rows of one revision, under the schema it was published with.

    Verification comes first: the manifest must fold to the revision's name,
    and files or contents must be as the manifest says; else the scan is
    refused.  `content` costs one more pass over the data, `files` a listing.
    Partition filters and columns are pruned as in any Parquet scan.
    """
    found = resolve(spark, base, name)
    if verify:
        leaves = {r["part"]: r["digest"] for r in found.parts(spark).collect()}
        if root(leaves) != found.name:
            raise ValueError(f"the manifest of {found.name} was changed")
        wrong = damage(spark, found, verify).limit(10).collect()
        if wrong:
            raise ValueError(f"revision {found.name} was changed: " + "; ".join(f"{r['what']}: {r['expected']} is {r['found']}" for r in wrong))
    return found.table(spark)


def changed_parts(spark: SparkSession, base: str, old: str, new: str) -> DataFrame:
    """(part, old_rows, new_rows) of the partitions whose content differs
    between two revisions, from their manifests alone."""
    side = lambda name, word: resolve(spark, base, name).parts(spark).select("part", F.col("rows").alias(f"{word}_rows"), F.col("digest").alias(word))
    both = side(old, "old").join(side(new, "new"), "part", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("part", "old_rows", "new_rows")


def history(spark: SparkSession, base: str) -> dict[str, str]:
    """The revision behind every name in the store."""
    return {n: resolve(spark, base, n).name for n in files.names(spark, f"{base}/pointers") if not n.endswith(".tmp")}


def sweep(spark: SparkSession, base: str) -> list[str]:
    """Remove the folders that no pointer leads to: what jobs that failed
    before their rename have left.  Not while another job publishes."""
    kept = {p for n in files.names(spark, f"{base}/pointers") if not n.endswith(".tmp") for r in [resolve(spark, base, n)] for p in (r.data, r.manifest)}
    gone = [f"{kind}/{x}" for kind in ("data", "manifests") for x in files.names(spark, f"{base}/{kind}") if f"{kind}/{x}" not in kept]
    for folder in gone:
        files.remove(spark, f"{base}/{folder}")
    return gone
