"""Splits and exclusions that no linked text gets around."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.links import exclusions, leak_free_split, link_texts, protected_windows
from ..sources.scratch import stored
from .registry import NORMAL, query, table

#: DuckDB: every text's representative, all links between representatives,
#: and components by reaching as far as links go.
_SETS = f"SELECT id, w, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))) END AS s FROM (SELECT doc_id AS id, string_split({NORMAL}, ' ') AS w FROM documents)"
LINKS_SQL = f"""k AS MATERIALIZED (SELECT id, s, CASE WHEN s IS NULL THEN '=' || list_aggregate(w, 'string_agg', ' ') ELSE md5(list_aggregate(list_sort(s), 'string_agg', '|')) END AS h FROM ({_SETS})),
    m AS MATERIALIZED (SELECT id, min(id) OVER (PARTITION BY h) AS rep FROM k),
    x AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS g FROM k WHERE id IN (SELECT rep FROM m) AND s IS NOT NULL),
    p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
    l AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT rep, rep FROM m),
    r AS (SELECT a AS node, b AS reached FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
    q AS MATERIALIZED (SELECT node, min(reached) AS component FROM r GROUP BY node),
    d AS MATERIALIZED (SELECT m.id AS doc_id, rep, component FROM m JOIN q ON rep = node),
    f AS (SELECT component, row_number() OVER (ORDER BY sha256(component::VARCHAR)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM d)),
    z AS (SELECT component, CASE WHEN r <= least(greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)), n - 1) THEN 'validation' ELSE 'train' END AS split FROM f)"""
_HELD = f"SELECT unnest(list_transform(range(1, len(w) - 6), lambda i: list_aggregate(w[i:i+7], 'string_agg', ' '))) AS g FROM (SELECT string_split({NORMAL}, ' ') AS w FROM benchmark) WHERE len(w) >= 8"
_SHOWN = f"SELECT id, unnest(list_transform(range(1, len(w) - 6), lambda i: list_aggregate(w[i:i+7], 'string_agg', ' '))) AS g FROM (SELECT doc_id AS id, string_split({NORMAL}, ' ') AS w FROM documents) WHERE len(w) >= 8"


@query(f"WITH RECURSIVE {LINKS_SQL} SELECT doc_id, component, split FROM d JOIN z USING (component)")
def cmp_leak_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-03, JON-08: every document with its component of equal texts and
    near copies, which goes to one side of the split as a whole."""
    return leak_free_split(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "component", "split")


@query(
    f"""WITH RECURSIVE {LINKS_SQL}, e AS (SELECT 'near' AS kind, p.a AS a, p.b AS b FROM p UNION ALL SELECT 'equal', rep, id FROM m WHERE rep <> id)
    SELECT kind, count(*) > 0 AS present, count(*) FILTER (x.split <> y.split) AS across FROM e JOIN (SELECT doc_id, split FROM d JOIN z USING (component)) x ON e.a = x.doc_id JOIN (SELECT doc_id, split FROM d JOIN z USING (component)) y ON e.b = y.doc_id GROUP BY kind"""
)
def jon_links_across_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-08, SET-06: links whose ends are on different sides of the split,
    none; the SQL counts them over all pairs of near copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    linked = link_texts(docs)
    side = stored(leak_free_split(docs, linked=linked).select(F.col("doc_id").alias("id"), "split"))
    links = linked.near.select(F.lit("near").alias("kind"), "a", "b").unionByName(linked.members.where("rep <> id").select(F.lit("equal").alias("kind"), F.col("rep").alias("a"), F.col("id").alias("b")))
    end = lambda e: side.select(F.col("id").alias(e), F.col("split").alias(f"{e}_split"))
    return links.join(end("a"), "a").join(end("b"), "b").groupBy("kind").agg((F.count("*") > 0).alias("present"), F.count_if(F.col("a_split") != F.col("b_split")).alias("across"))


#: What may be trained on: a verdict for every document, after LINKS_SQL.
VERDICT_SQL = f"""c AS (SELECT DISTINCT id FROM ({_SHOWN}) WHERE g IN ({_HELD}) UNION SELECT doc_id FROM documents WHERE sha256({NORMAL}) IN (SELECT sha256({NORMAL}) FROM benchmark)),
    verdicts AS MATERIALIZED (SELECT d.doc_id, CASE WHEN id IS NOT NULL THEN 'contaminated' WHEN d.doc_id <> rep THEN 'equal' WHEN d.doc_id <> component THEN 'near' ELSE 'kept' END AS verdict FROM d LEFT JOIN c ON d.doc_id = c.id)"""


@query(f"WITH RECURSIVE {LINKS_SQL}, {VERDICT_SQL} SELECT doc_id, verdict FROM verdicts")
def cmp_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-26: what may be trained on: rows that hold a benchmark text or eight
    words in a row of one are excluded, and so are equal texts and near copies
    but the first of each component; what is kept passes three anti joins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exclusions(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("doc_id"), "verdict")


_TALKED = f"SELECT conv_id, turn, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')))) AS g FROM (SELECT conv_id, turn, string_split({NORMAL}, ' ') AS w FROM conversations UNION ALL SELECT -1 - doc_id, -1, string_split({NORMAL}, ' ') FROM documents) WHERE len(w) >= 5"
_HIDDEN = f"SELECT unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))) AS g FROM (SELECT string_split({NORMAL}, ' ') AS w FROM benchmark) WHERE len(w) >= 5"


@query(f"SELECT conv_id AS row, turn, count(*) AS windows FROM ({_TALKED}) WHERE g IN ({_HIDDEN}) GROUP BY conv_id, turn")
def cmp_hidden_test_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-29, JON-07: turns and documents that hold five words in a row of a
    hidden test (a benchmark item), and how many such windows; documents have
    negative rows.  Windows pass a Bloom filter before they are joined."""
    turns = table(spark, sf_dir, "conversations").select(F.struct(F.col("conv_id").alias("row"), "turn").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.struct((-1 - F.col("doc_id")).alias("row"), F.lit(-1).cast("long").alias("turn")).alias("id"), "text")
    found = protected_windows(turns.unionByName(docs), table(spark, sf_dir, "benchmark"), 5, id_col="id")
    return found.groupBy("id").agg(F.count("*").alias("windows")).select("id.row", "id.turn", "windows")
