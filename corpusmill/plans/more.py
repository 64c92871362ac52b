"""Calibration and long rows, default rewards, stamps, near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.links import similar_pairs
from .registry import NORMAL, WORDS, query, table


@query(f"SELECT count(*) AS documents, CAST(sum({WORDS}) AS BIGINT) AS tokens, max({WORDS}) AS max_tokens FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 512)")
def cmp_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-17, SRC-11: the first 512 texts by key and their size; the limit is
    the feature."""
    first = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(512).select(T.word_count(F.col("text")).alias("n"))
    return first.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.max("n").alias("max_tokens"))


@query("SELECT count(*) AS chats, length(string_agg('<|im_start|>user' || chr(10) || 'Print item ' || item_id || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY item_id)) AS chars FROM benchmark")
def cmp_long_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-35: all books' chats rendered as one long row; the table is a list
    of books, so one row holds it."""
    turn = F.concat(F.lit("<|im_start|>user\nPrint item "), F.col("item_id").cast("string"), F.lit("<|im_end|>\n<|im_start|>assistant\n"), "text", F.lit("<|im_end|>\n"))
    chats = table(spark, sf_dir, "benchmark").agg(F.array_sort(F.collect_list(F.struct("item_id", turn.alias("turn")))).alias("t"))
    return chats.select(F.size("t").cast("long").alias("chats"), F.char_length(F.array_join(F.transform("t", lambda x: x["turn"]), "")).cast("long").alias("chars"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 1.0::DOUBLE END, 0.0::DOUBLE) AS reward FROM documents LEFT JOIN labels USING (doc_id)")
def cmp_reward_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-16: a verifier that gives nothing, or fails, is worth 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, 1.0), F.lit(0.0)).alias("reward"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, round(value / 3, 3) AS elapsed FROM events")
def fn_utc_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-25: compact UTC stamps and rounded seconds."""
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'").alias("stamp"), F.round(F.col("value") / 3, 3).alias("elapsed"))


def _shingles(n: str) -> str:
    return f"SELECT {n} AS id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))) AS s FROM (SELECT {n}, string_split({NORMAL}, ' ') AS w FROM documents) WHERE len(w) >= 5"


@query(
    f"""WITH k AS ({_shingles('doc_id')}), r AS (SELECT min(id) AS id, any_value(s) AS s FROM (SELECT id, s, md5(list_aggregate(list_sort(s), 'string_agg', '|')) AS h FROM k) GROUP BY h),
    x AS (SELECT id, len(s) AS n, unnest(s) AS g FROM r), p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
    SELECT a, b, shared, na + nb - shared AS either FROM p WHERE 100 * shared >= 75 * (na + nb - shared)"""
)
def cmp_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-08, CMP-26: pairs of different texts with a similarity of 0.75 or
    more on sets of five words, exactly.  Pairs are between representatives;
    cmp_near_dedup_members says which texts each stands for.

    Texts with equal sets become one (their smallest id) first.  Then prefix
    filtering: with windows in one order, infrequent ones first, two sets as
    similar as asked share one of the first n - ceil(0.75 n) + 1 of either, so
    only these are joined, only pairs of fitting sizes that share enough of
    them, and whole sets only of pairs whose bitmaps are near enough.
    """
    return similar_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    f"""WITH k AS ({_shingles('doc_id')}), m AS (SELECT id, md5(list_aggregate(list_sort(s), 'string_agg', '|')) AS h FROM k)
    SELECT id AS doc_id, min(id) OVER (PARTITION BY h) AS representative, count(*) OVER (PARTITION BY h) AS copies FROM m"""
)
def cmp_near_dedup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-08, CMP-26: every text of five words or more with the representative
    that stands for it in cmp_near_dedup, and how many texts that one stands
    for.  Two texts are linked if they share a representative or if theirs are
    a pair.  Only ids and digests of the sets are joined."""
    windows = F.array_sort(F.array_distinct(T.word_windows(F.col("text"), 5)))
    digest = T.bound(windows, lambda s: F.when(F.size(s) > 0, F.sha2(F.array_join(s, "|"), 256)))
    # exploded and dealt out by id: a filter would compute the digest again, each side of the join too
    sets = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(F.array(digest)).alias("h")).where("h is not null").repartition("doc_id")
    reps = sets.groupBy("h").agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies"))
    return sets.join(reps, "h").select("doc_id", "representative", "copies")
