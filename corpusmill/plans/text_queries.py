"""Scalar functions on given tables and on inline completions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import text as T
from ..operators.quantiles import quantiles
from ..operators.split import family_split
from ..sources.scratch import stored
from .registry import NORMAL, WORDS, query, table


def inline(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def values(rows: list[tuple], columns: str) -> str:
    """The same rows for the oracle."""
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each conversation in order of their turns."""
    turn = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("messages"))


FOLD = """WITH c AS (SELECT *, min(CASE WHEN role NOT IN ('system', 'developer') THEN turn END) OVER (PARTITION BY conv_id) AS first_other FROM conversations),
    f AS (SELECT conv_id, -1 AS turn, 'system' AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM c WHERE first_other IS NULL OR turn < first_other GROUP BY conv_id
        UNION ALL SELECT conv_id, turn, role, text FROM c WHERE turn >= first_other)"""


@query(FOLD + " SELECT conv_id, count(*) AS n, arg_min(role, turn) AS first_role, arg_min(content, turn) AS first_content FROM f GROUP BY conv_id")
def fn_fold_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-04: leading system messages become one."""
    folded = _conversations(spark, sf_dir).withColumn("m", M.fold_system(F.col("messages")))
    return folded.select("conv_id", F.size("m").cast("long").alias("n"), F.col("m")[0]["role"].alias("first_role"), F.col("m")[0]["content"].alias("first_content"))


RENDER = FOLD + ", r AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text FROM f GROUP BY conv_id)"


@query(RENDER + f" SELECT conv_id, text, {WORDS} AS tokens FROM r")
def fn_render_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-05/09, CMP-02: conversations rendered and measured."""
    rendered = _conversations(spark, sf_dir).select("conv_id", M.render_chatml(F.col("messages")).alias("text"))
    return rendered.withColumn("tokens", T.word_count(F.col("text")))


@query(RENDER + f", s AS (SELECT conv_id, row_number() OVER (ORDER BY sha256(CAST(conv_id AS VARCHAR))) AS r, count(*) OVER () AS n FROM r) SELECT CASE WHEN s.r <= least(greatest(1, CAST(round_even(s.n * 0.1, 0) AS BIGINT)), s.n - 1) THEN 'validation' ELSE 'train' END AS split, count(*) AS rows, CAST(sum({WORDS}) AS BIGINT) AS tokens, max({WORDS}) AS longest, round(quantile_cont({WORDS}, 0.5), 6) AS p50, round(quantile_cont({WORDS}, 0.95), 6) AS p95 FROM r JOIN s USING (conv_id) GROUP BY 1")
def flagship_render_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation in one query: group, render, measure, split by
    hashed group, report by split."""
    rendered = stored(fn_render_chatml(spark, sf_dir).select(F.col("conv_id").cast("string").alias("family"), "tokens"))
    divided = family_split(rendered, "family")
    sums = divided.groupBy("split").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    return sums.join(quantiles(divided, F.col("tokens"), (0.5, 0.95), ["split"]).select("split", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95")), "split")


@query("SELECT doc_id, len(regexp_extract_all(text, '-?[0-9]+(\\.[0-9]+)?')) AS n, CASE WHEN len(regexp_extract_all(text, '-?[0-9]+(\\.[0-9]+)?')) > 0 THEN list_last(regexp_extract_all(text, '-?[0-9]+(\\.[0-9]+)?')) END AS last_number FROM documents")
def fn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-21: all numbers, the last one wins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.numbers(F.col("text")).alias("found"))
    return docs.select("doc_id", F.size("found").cast("long").alias("n"), F.when(F.size("found") > 0, F.element_at("found", -1)).alias("last_number"))


@query("SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - length(replace(replace(text, 'the', ''), chr(10), ''))) / length(text) ELSE 0 END, 6) AS share FROM documents")
def fn_gibberish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-23: share of characters that go with some strings."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.removed_share(F.col("text"), "the", "\n"), 6).alias("share"))


@query(f"SELECT doc_id, sha256({NORMAL}) AS h FROM documents")
def fn_norm_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-11/28: hashes of normalised texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{rule}') THEN '{name}' END" for name, rule in T.LEAK_RULES.items()) + ") AS leaks FROM documents")
def fn_pii_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-29: which leak rules each text breaks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.leaks(F.col("text")), ",").alias("leaks"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant') AS trained, count(*) FILTER (role <> 'assistant') AS masked, CAST(coalesce(sum(length(role) + 1 + length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS trained_chars FROM conversations GROUP BY conv_id")
def fn_assistant_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-27, CMP-18, AGG-11: which spans are trained on."""
    spans = _conversations(spark, sf_dir).withColumn("s", M.trainable(F.col("messages")))
    on = F.filter("s", lambda s: s["trainable"])
    chars = F.aggregate(on, F.lit(0).cast("long"), lambda a, s: a + F.char_length(s["text"]))
    return spans.select("conv_id", F.size(on).cast("long").alias("trained"), (F.size("s") - F.size(on)).cast("long").alias("masked"), chars.alias("trained_chars"))


@query("SELECT doc_id, left(text, 100) AS shown, length(text) > 100 AS truncated, length(text) AS original_length FROM documents")
def fn_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-30, WIN-05: bounded results say what was cut."""
    cut = T.truncated(F.col("text"), 100)
    return table(spark, sf_dir, "documents").select("doc_id", cut["text"].alias("shown"), cut["truncated"].alias("truncated"), cut["original_length"].alias("original_length"))


@query("SELECT concat_ws('', 'c', item_id) AS cell, substr(sha256('t' || chr(0) || item_id || chr(0) || 'code' || chr(0) || text), 1, 16) AS id FROM benchmark")
def snk_cell_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-06: deterministic identifiers from hashed fields."""
    key = F.concat_ws("\0", F.lit("t"), F.col("item_id").cast("string"), F.lit("code"), "text")
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("cell"), F.substring(F.sha2(key, 256), 1, 16).alias("id"))


@query("SELECT item_id, length(text) + 1 AS n, true AS ends, sha256(text || chr(10)) AS h FROM benchmark")
def fn_patch_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-08: exactly one line feed at the end, whatever stood there."""
    k = F.col("item_id") % 4
    fixed = T.patch_newline(F.concat("text", F.when(k == 0, "").when(k == 1, "\n").when(k == 2, "\r\n").otherwise("\n\r\n\n")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.char_length(fixed).cast("long").alias("n"), fixed.endswith("\n").alias("ends"), F.sha2(fixed, 256).alias("h"))


@query("""SELECT event_id, '{' || CASE WHEN event_id % 2 = 0 THEN '"a":' || event_id || ',' ELSE '' END || '"b":{' || CASE WHEN event_id % 3 = 0 THEN '"c":"' || event_type || '"' ELSE '' END || '},"d":[null,' || user_id || ']}' AS j FROM events""")
def fn_without_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-01: null members go at every depth, null elements of lists stay."""
    padded = F.concat(F.lit('{"a":'), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("null"), F.lit(',"b":{"c":'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("null"), F.lit(',"x":null},"d":[null,'), F.col("user_id").cast("string"), F.lit("]}"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.from_json(padded, "a bigint, b struct<c:string,x:string>, d array<bigint>")).alias("j"))


@query("SELECT item_id, text || '|' || item_id AS rest, '<|start|>user ' AS opening, length('<|start|>system x') AS dropped FROM benchmark WHERE NOT contains(text, '@@')")
def fn_template_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-15/24: what a template puts around a text, without its start mark."""
    from ..functions import foreign as X

    template = F.concat(F.lit("<bos><|start|>system x<|start|>user @@"), "text", F.lit("|"), F.col("item_id").cast("string"))
    full = X.without_start(template)
    before, after = X.around(full, "@@", "<|start|>")
    return table(spark, sf_dir, "benchmark").where(~F.col("text").contains("@@")).select("item_id", after.alias("rest"), before.alias("opening"), (F.instr(full, "@@") - 1 - F.char_length(before)).cast("long").alias("dropped"))


@query("SELECT doc_id, strlen(text) AS n_bytes FROM documents")
def udf_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-02: a function over whole Arrow columns."""
    from ..functions.batches import map_batches

    sizes = lambda text: pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
    return map_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], sizes, "n_bytes", "long").drop("text")


@query("SELECT doc_id, upper(lang) AS lang, n_chars // 100 AS hundreds FROM documents WHERE n_chars >= 100 AND lang <> 'de'")
def udf_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-01: a function of a row and a condition on a row."""
    from ..functions.batches import filter_rows, map_rows

    rows = filter_rows(table(spark, sf_dir, "documents"), lambda r: (r("n_chars") >= 100) & (r("lang") != "de"))
    return map_rows(rows, lambda r: {"doc_id": r("doc_id"), "lang": F.upper(r("lang")), "hundreds": F.floor(r("n_chars") / 100)}, drop=True)


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 1.5 + 1.0 + 4.0 WHEN 1 THEN 1.5 + 0.25 - 0.5 WHEN 2 THEN -0.5 - 0.5 - 0.5 ELSE 1.0 + 1.0 + 4.0 END AS DOUBLE) AS total FROM events")
def udf_reward_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-03, CMP-11/12/13: named rewards of completions, summed."""
    from ..operators import rewards as R

    n, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    reply = F.when(k == 1, F.concat(F.lit("that makes "), n, F.lit(" apples"))).otherwise(n)
    text = F.when(k == 2, F.concat(F.lit("only "), n)).otherwise(F.concat(F.when(k == 3, "").otherwise(" to=self<|message|>sum<|eom|>"), F.lit("<|start|>assistant to=user<|message|>"), reply, F.lit("<|eot|>")))
    gold = F.when(k == 1, F.lit("-1")).otherwise(n)
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("completion"), gold.alias("gold"))
    return rows.select("event_id", R.total(["channel_format", "number_format", "number_correct"], F.col("completion"), F.col).alias("total"))
