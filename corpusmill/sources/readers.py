"""Sources: pinned scans, strict manifests, file trees and foreign schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import text as T
from ..operators.prefix import last_within
from . import revisions

TASK = "task_id string, repo_path string, request string, visible_test_command array<string>, hidden_test_command array<string>"


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows in memory under a declared schema (SRC-01): a row that lacks a
    field or has another one is refused, and so is a value of another type."""
    declared = StructType.fromDDL(schema)
    for k, row in enumerate(rows):
        if set(row) != set(declared.names):
            raise ValueError(f"row {k} has the fields {sorted(row)}, not {sorted(declared.names)}")
    return spark.createDataFrame([tuple(row[n] for n in declared.names) for row in rows], declared)


def pinned(spark: SparkSession, base: str, revision: str | None, name: str | None = None, verify: str | None = "content") -> DataFrame:
    """The rows of a published revision, of one named configuration below the
    base where there are several; placeholders, unknown revisions and changed
    data are refused (SRC-02/03/04)."""
    return revisions.scan(spark, f"{base}/{name}" if name else base, revision, verify)


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines task manifest: blank lines are skipped, any missing or
    further key fails the job (SRC-06)."""
    fields = [x.split()[0] for x in TASK.split(", ")]
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.array_sort(F.json_object_keys("value"))
    wrong = F.concat(F.lit("task fields differ: "), F.coalesce(F.array_join(keys, ","), F.lit("no JSON object")))
    checked = lines.withColumn("value", F.when(keys == F.array(*map(F.lit, sorted(fields))), F.col("value")).otherwise(F.raise_error(wrong)))
    return checked.select(F.from_json("value", TASK, {"mode": "FAILFAST"}).alias("t")).select("t.*")


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files below root except version control's, in
    distributed reads (SRC-09); relative paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:(//)?", "", root).rstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    return files.select(relative.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)\.git/"))


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """What is wrong with a regular expression, None if nothing is."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:  # noqa: BLE001  the JVM's exception for a bad pattern
        return str(e).strip().splitlines()[0]
    return None


def text_search(files: DataFrame, pattern: str, most_hits: int = 200, most_bytes: int = 5_000_000) -> DataFrame:
    """Lines that match, as path:line:text (FN-13/14, WIN-04/05), and a last
    row that says what was left out: an invalid pattern is answered with a
    message, not with an error.

    Files with NUL bytes are skipped and not counted; files after the byte
    budget, in path order, are not searched.  Where the budget runs out is
    looked up by ranges of path and size; contents are not moved for it.
    """
    spark, schema = files.sparkSession, "path string, line_number int, hit string"
    if wrong := pattern_error(spark, pattern):
        return spark.createDataFrame([(None, None, f"invalid regular expression: {wrong}")], schema)
    plain = files.where(~F.contains("content", F.lit(b"\0")))
    last, over = last_within(plain.select("path", F.octet_length("content").alias("size")), "path", "size", most_bytes)
    within = plain.where(F.col("path") <= F.lit(last)) if over else plain
    lines = within.select("path", F.posexplode(T.lines(F.decode("content", "UTF-8"))).alias("i", "line"))
    hits = lines.where(F.col("line").rlike(pattern)).orderBy("path", "i").limit(most_hits)
    found = hits.select("path", (F.col("i") + 1).alias("line_number"), F.concat_ws(":", "path", (F.col("i") + 1).cast("string"), "line").alias("hit"))
    n = found.agg(F.count("*").alias("n"))
    said = F.when(F.col("n") >= most_hits, f"[search truncated after {most_hits} matches]").when(F.lit(over), f"[search truncated after {most_bytes // 1_000_000} MB]")
    note = n.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line_number"), said.alias("hit"))
    return found.unionByName(note.where("hit is not null"))


def answer_tool(files: DataFrame, name: str, arguments: dict[str, str]) -> DataFrame:
    """One row (text): what a tool answers over a file tree (path, content)
    (CMP-07).  Patches and tests run programs and are not answered here."""
    path = arguments.get("path", "").strip("/")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), "\n")
    cut = lambda df: df.select(F.left(F.coalesce("text", F.lit("")), F.lit(20_000)).alias("text"))
    say = lambda t: files.sparkSession.createDataFrame([(t,)], "text string")
    if name in ("list_files", "read_file") and (arguments.get("path", "").startswith("/") or ".." in arguments.get("path", "").split("/")):
        return say("path leaves the repository")
    if name == "list_files":
        below = files.where(F.lit(path in ("", ".")) | F.col("path").startswith(path + "/"))
        first = below.select(F.col("path").alias("k"), F.col("path").alias("v")).orderBy("k").limit(200)
        return first.agg(text.alias("text")).select(F.when(F.col("text") == "", "[no files]").otherwise(F.col("text")).alias("text"))
    if name == "read_file":
        return cut(files.where(F.col("path") == path).agg(F.max(F.decode("content", "UTF-8")).alias("text")))
    if name == "search":
        hits = text_search(files, arguments["query"]).select(F.struct(F.col("path").isNull(), "path", "line_number").alias("k"), F.col("hit").alias("v"))
        return cut(hits.agg(text.alias("text")).select(F.when(F.col("text") == "", "[no matches]").otherwise(F.col("text")).alias("text")))
    return say("shell is disabled" if name == "shell" else f"unknown tool: {name}")


def audit(spark: SparkSession, paths: dict[str, str]) -> list[dict]:
    """One entry for each dataset: rows, sorted columns, rows whose messages
    are a list, no direct survival until rows are looked at, or the error that
    reading it gave (SRC-12)."""
    found = []
    for name, path in paths.items():
        try:
            df = spark.read.parquet(path)
            listed = "messages" in df.columns and isinstance(df.schema["messages"].dataType, ArrayType)
            row = df.agg(F.count("*").alias("n"), (F.count("messages") if listed else F.lit(0)).alias("m")).first()
            found.append({"dataset": name, "rows": row["n"], "columns": sorted(df.columns), "with_messages": row["m"], "planning_direct_survival": 0, "error": None})
        except Exception as e:  # noqa: BLE001  a broken source is a row of the report
            found.append({"dataset": name, "rows": 0, "columns": [], "with_messages": 0, "planning_direct_survival": 0, "error": f"{type(e).__name__}: {str(e).splitlines()[0]}"})
    return found
