"""Patches made from documents: a candidate changes a file's first line as it
should, appends to it, and for some adds notes outside of its task's folder.
Its last line of context was recorded short, so against long ones it fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patches as P
from ..operators.quantiles import quantiles
from ..sources.scratch import stored
from .registry import query, table

RECORDED = 80

#: DuckDB: what each patch does, from the lines it was made of.
PATCHES_SQL = f"""pl AS (SELECT doc_id, source, lang, text, string_split(text, chr(10)) AS l FROM documents),
    pt AS (SELECT doc_id, source, lang, length(text) AS chars, len(l) >= 4 AS longer, lang = 'de' AS notes, len(l) < 4 OR length(l[len(l)]) <= {RECORDED} AS applies FROM pl),
    patches AS (SELECT *, 1 + notes::INT AS files, 1 + longer::INT + 2 * notes::INT AS added, 1 AS removed, 2 AS relevant, 2 + longer::INT + 2 * notes::INT AS total, NOT notes AS in_scope FROM pt)"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, file, old, patch, wanted)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.split("text", "\n", -1).alias("old"))
    n, name = F.size("old"), F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    first, last = F.col("old")[0], F.get("old", n - 1)
    h = F.least(n, F.lit(2)).cast("string")
    head = F.concat(F.lit("--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"))
    one = F.concat(F.lit("@@ -1,"), h, F.lit(" +1,"), h, F.lit(" @@\n-"), first, F.lit("\n+"), first, F.lit("!\n"), F.when(n >= 2, F.concat(F.lit(" "), F.get("old", F.lit(1)), F.lit("\n"))).otherwise(""))
    two = F.when(n >= 4, F.concat(F.lit("@@ -"), n.cast("string"), F.lit(" +"), n.cast("string"), F.lit(",2 @@\n "), F.left(last, F.lit(RECORDED)), F.lit("\n+++ b/"), "source", F.lit("\n"))).otherwise("")
    notes = F.when(F.col("lang") == "de", F.concat(F.lit("--- /dev/null\n+++ b/notes/"), "lang", F.lit(".md\n@@ -0,0 +1,2 @@\n+"), "lang", F.lit("\n+--- a/x\n"))).otherwise("")
    git = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n"))
    return docs.select("doc_id", "source", "lang", name.alias("file"), "old", F.concat(git, head, one, two, notes).alias("patch"), F.concat(head, one).alias("wanted"))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, ok, files, added, removed, relevant, total,
    in_scope, applies, result_chars) of every patch."""
    read = patches(spark, sf_dir).withColumn("p", P.read_patch(F.col("patch"))).withColumn("w", P.read_patch(F.col("wanted")))
    lines = F.col("p.lines")
    count = lambda sign: F.size(F.filter(lines, lambda x: x["sign"] == sign)).cast("long")
    relevant, total = P.precision(lines, F.col("w.lines"))
    new = P.patched(lines, F.col("old"), F.col("file"))
    return read.select(
        "doc_id", "source", "lang", F.col("p.ok").alias("ok"), F.size(P.files_of(lines)).cast("long").alias("files"), count("+").alias("added"), count("-").alias("removed"), relevant.alias("relevant"), total.alias("total"),
        P.in_scope(lines, F.concat(F.lit("src/"), "source", F.lit("/"))).alias("in_scope"), P.applies(lines, F.col("old"), F.col("file")).alias("applies"), F.char_length(F.array_join(new, "\n")).cast("long").alias("result_chars"),
    )


@query(f"WITH {PATCHES_SQL} SELECT doc_id, true AS ok, files, added, removed, relevant, total, in_scope, applies, CASE WHEN applies THEN chars + 1 + CASE WHEN longer THEN 6 + length(source) ELSE 0 END END AS result_chars FROM patches")
def cmp_patch_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-08, CMP-20: every patch read, counted, held against its scope and
    applied to the text it is for."""
    return reviewed(spark, sf_dir).drop("source", "lang")


@query(f"WITH {PATCHES_SQL} SELECT lang, count(*) AS patches, round(sum(relevant) / sum(total), 6) AS patch_precision, round(count(*) FILTER (in_scope) / count(*), 6) AS in_scope, round(count(*) FILTER (applies) / count(*), 6) AS applies, round(quantile_cont(total, 0.5), 6) AS p50, round(quantile_cont(total, 0.95), 6) AS p95, max(total) AS longest FROM patches GROUP BY lang")
def met_patch_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MET-08, AGG-12: precision, scope, application and size of patches by
    language, from their texts."""
    rows = stored(reviewed(spark, sf_dir).select("lang", "relevant", "total", "in_scope", "applies"))
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    sums = rows.groupBy("lang").agg(F.count("*").alias("patches"), F.round(F.sum("relevant") / F.sum("total"), 6).alias("patch_precision"), rate("in_scope").alias("in_scope"), rate("applies").alias("applies"), F.max("total").alias("longest"))
    sizes = quantiles(rows, F.col("total"), (0.5, 0.95), ["lang"]).select("lang", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"))
    return sums.join(sizes, "lang").select("lang", "patches", "patch_precision", "in_scope", "applies", "p50", "p95", "longest")
