"""Sources, projections, filters and gates, on the given tables.

`documents.source` stands for the repository family, `documents.text` for the
rendered text, `labels.quality` for verification, `events` for the tool-call
log (event_type error is a failed call, value its seconds, props its
arguments).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import revisions
from ..sources.readers import answer_tool, pinned
from ..sources.scratch import scratch
from .registry import WORDS, query, table


TOXIC = "SELECT doc_id FROM labels WHERE toxic = 1"


def two_revisions(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """A store with the documents' facts in two revisions by language, all of
    them (tag v1) and without toxic ones (tag clean), and both names."""
    base = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    first = revisions.publish(docs, base, ["lang"], tag="v1")
    return base, first, revisions.publish(docs.join(toxic, "doc_id", "left_anti"), base, ["lang"], tag="clean")


@query(f"SELECT 'v1' AS revision, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang UNION ALL SELECT 'clean', lang, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents WHERE doc_id NOT IN ({TOXIC}) GROUP BY lang")
def src_scan_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-02/04: two published revisions, one read by its name and one by its
    tag, each verified against its manifest; placeholders are refused."""
    base, first, _ = two_revisions(spark, sf_dir)
    summed = lambda label, name: pinned(spark, base, name).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.lit(label).alias("revision"), "lang", "n", "chars")
    return summed("v1", first).unionByName(summed("clean", "clean"))


_NUMBERS = " || ':' || ".join(f"sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT)::VARCHAR" for k in range(4))


@query(f"SELECT 'lang=' || lang AS part, count(*) AS rows, sha256(count(*) || ':' || {_NUMBERS}) AS digest FROM (SELECT lang, sha256(to_json({{'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source}})::VARCHAR) AS h FROM documents) GROUP BY lang")
def src_revision_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04, SNK-02: the manifest of a revision: rows and a digest of each
    partition that does not depend on order or files."""
    base, first, _ = two_revisions(spark, sf_dir)
    return revisions.resolve(spark, base, first).parts(spark)


@query(f"SELECT 'lang=' || lang AS part, count(*) AS old_rows, nullif(count(*) FILTER (doc_id NOT IN ({TOXIC})), 0) AS new_rows FROM documents GROUP BY lang HAVING count(*) FILTER (doc_id IN ({TOXIC})) > 0")
def src_revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: what differs between two revisions, told from their manifests
    without reading a row of either."""
    base, first, second = two_revisions(spark, sf_dir)
    return revisions.changed_parts(spark, base, first, second)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07/08: a JSON string column parsed with a declared schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    """SELECT 'documents' AS dataset, (SELECT count(*) FROM documents) AS n_rows, 'doc_id,lang,n_chars,source,text' AS columns, (SELECT count(text) FROM documents) AS with_text
    UNION ALL SELECT 'conversations', (SELECT count(*) FROM conversations), 'conv_id,role,text,turn', (SELECT count(text) FROM conversations)
    UNION ALL SELECT 'benchmark', (SELECT count(*) FROM benchmark), 'item_id,text', (SELECT count(text) FROM benchmark)"""
)
def src_schema_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, AGG-10: rows, the sorted union of columns and rows with text."""
    out = None
    for name in ("documents", "conversations", "benchmark"):
        df = table(spark, sf_dir, name)
        row = df.agg(F.count("*").alias("n_rows"), F.count("text").alias("with_text")).select(F.lit(name).alias("dataset"), "n_rows", F.lit(",".join(sorted(df.columns))).alias("columns"), "with_text")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def src_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: the union of keys over rows."""
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def src_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05/11: the first n rows, which need an explicit order."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").orderBy("doc_id").limit(100)


@query(
    """SELECT doc_id, '[{"role":"system","content":"Answer in ' || lang || '."},{"role":"user","content":"source ' || source || '"},{"role":"assistant","content":"quality ' || quality || '"}]' AS conversation
    FROM documents JOIN labels USING (doc_id)"""
)
def prj_pair_to_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-03/07: columns zipped to a conversation with a system prompt."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    talk = F.array(turn("system", F.concat(F.lit("Answer in "), "lang", F.lit("."))), turn("user", F.concat(F.lit("source "), "source")), turn("assistant", F.concat(F.lit("quality "), F.col("quality").cast("string"))))
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.to_json(talk).alias("conversation"))


@query("SELECT doc_id, 'v1' AS schema_version, source AS repo_family, n_chars AS size FROM documents")
def prj_stamp_rename_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01/02/04/06: literal columns, renamed and dropped ones."""
    return table(spark, sf_dir, "documents").withColumn("schema_version", F.lit("v1")).withColumnsRenamed({"source": "repo_family", "n_chars": "size"}).drop("text", "lang")


@query("""SELECT item_id, 'image,text' AS kinds, '[{"type":"image"},{"type":"text","text":"item ' || item_id || '"}]' AS content FROM benchmark""")
def prj_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08: typed content parts of a multimodal prompt."""
    none = F.lit(None).cast("string")
    parts = F.array(F.struct(F.lit("image").alias("type"), none.alias("text")), F.struct(F.lit("text").alias("type"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(parts, lambda p: p["type"]), ",").alias("kinds"), F.to_json(parts).alias("content"))


@query(f"SELECT doc_id, {WORDS} AS tokens FROM documents WHERE {WORDS} <= 512")
def flt_length_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, FN-09: texts over the budget go whole, none is cut."""
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("tokens")).where(F.col("tokens") <= 512)


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0 AND bool_and(role <> 'assistant' OR coalesce(text, '') <> '')")
def flt_forall_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07: every assistant turn has content, and there is one."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("n"), F.bool_and((F.col("role") != "assistant") | (F.coalesce("text", F.lit("")) != "")).alias("ok"))
    return rows.where("n > 0 AND ok").select("conv_id")


@query("SELECT role, count(*) AS n FROM conversations WHERE role IN ('system', 'user') GROUP BY role")
def flt_allowed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01/09: equality and membership, pushed to the scan."""
    return table(spark, sf_dir, "conversations").where(F.col("role").isin("system", "user")).groupBy("role").agg(F.count("*").alias("n"))


@query(
    """SELECT doc_id, CAST(quality AS DOUBLE) AS chosen_reward, CAST(toxic AS DOUBLE) AS rejected_reward, CASE WHEN doc_id % 7 = 0 THEN 'infra_failed' WHEN quality > toxic THEN 'ok' ELSE 'not_preferred' END AS verdict FROM labels"""
)
def gate_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GATE-05: infrastructure first, then strictly better."""
    ok = F.when(F.col("doc_id") % 7 == 0, "infra_failed").when(F.col("quality") > F.col("toxic"), "ok").otherwise("not_preferred")
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("chosen_reward"), F.col("toxic").cast("double").alias("rejected_reward"), ok.alias("verdict"))


@query("SELECT lang, count(*) AS n, count(*) > 0 AS present FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY lang")
def gate_required_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GATE-02, SET-05: required groups with their counts, missing ones too."""
    want = spark.sql("SELECT explode(array('en','de','fr','es')) AS lang")
    have = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return want.join(have, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) > 0).alias("present"))


FLOATS = [(1, "42", 42.0), (2, " -3.5\t", -3.5), (3, "1e5", 100000.0), (4, "1_000", 1000.0), (5, "inf", float("inf")), (6, "-Infinity", float("-inf")), (7, "1__0", None), (8, "3d", None), (9, "", None), (10, ".5", 0.5), (11, "5.", 5.0), (12, "1,2", None), (13, "\u20037\u00a0", 7.0), (14, "0x10", None), (15, "+2E-1", 0.2), (16, None, None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if x is None else repr(x) + '::DOUBLE' if abs(x) != float('inf') else chr(39) + str(x) + chr(39) + '::DOUBLE'})" for i, _, x in FLOATS) + ") t(id, number) UNION ALL SELECT event_id + 1000, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END FROM events")
def flt_try_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04: numbers by attempted reading: padding, exponents, infinities
    and underscores count, type suffixes and doubled underscores do not; and
    every event's value as text, a fifth of them spoilt."""
    texts = spark.createDataFrame([(i, t) for i, t, _ in FLOATS], "id long, text string")
    value = F.col("value").cast("string")
    events = table(spark, sf_dir, "events").select((F.col("event_id") + 1000).alias("id"), F.when(F.col("event_id") % 5 == 0, F.concat(value, F.lit(" s"))).otherwise(F.concat(F.lit(" "), value)).alias("text"))
    return texts.unionByName(events).select("id", T.float_text(F.col("text")).alias("number"))


@query("SELECT 'documents' AS config, lang AS key, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role")
def src_named_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: scans of named configurations below one base, each at its own
    pinned revision."""
    base = scratch(spark)
    made = {"documents": ("lang", ["doc_id", "lang"]), "conversations": ("role", ["conv_id", "turn", "role"])}
    names = {c: revisions.publish(table(spark, sf_dir, c).select(*columns), f"{base}/{c}") for c, (_, columns) in made.items()}
    counted = [pinned(spark, base, names[c], c).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(c).alias("config"), "key", "n") for c, (key, _) in made.items()]
    return reduce(DataFrame.unionByName, counted)


@query("SELECT event_id, json_extract_string(j, '$.params.input[0].content') AS content, CAST(json_extract(j, '$.params.limits.calls') AS BIGINT) AS calls FROM (SELECT event_id, '{\"params\":{\"input\":[{\"role\":\"user\",\"content\":\"' || event_type || ' ' || user_id || '\"},{\"role\":\"system\"}],\"limits\":{\"calls\":' || user_id % 7 || '}}}' AS j FROM events)")
def src_nested_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-07: values from inside nested JSON, by a declared schema."""
    j = F.concat(F.lit('{"params":{"input":[{"role":"user","content":"'), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit('"},{"role":"system"}],"limits":{"calls":'), (F.col("user_id") % 7).cast("string"), F.lit("}}}"))
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(j, "params struct<input:array<struct<role:string,content:string>>,limits:struct<calls:bigint>>").alias("r"))
    return rows.select("event_id", F.get("r.params.input", F.lit(0))["content"].alias("content"), F.col("r.params.limits.calls").alias("calls"))


PATHS = "SELECT 'src/' || CAST(doc_id % 7 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents"


@query(
    f"""WITH f AS ({PATHS}), t AS (SELECT *, sum(strlen(text)) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS total FROM f WHERE NOT contains(text, chr(0))),
    l AS (SELECT path, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT path, CASE WHEN text LIKE '%' || chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS p FROM t WHERE total <= 5000000)),
    h AS (SELECT path, i, path || ':' || i || ':' || line AS hit FROM l WHERE regexp_matches(line, 'rights reserved') ORDER BY path, i LIMIT 200)
    SELECT 'list_files' AS tool, left(string_agg(path, chr(10) ORDER BY path), 20000) AS answer FROM (SELECT path FROM f WHERE path LIKE 'src/3/%' ORDER BY path LIMIT 200)
    UNION ALL SELECT 'read_file', left(max(text), 20000) FROM f WHERE path = 'src/5/5.txt'
    UNION ALL SELECT 'search', left(coalesce(string_agg(hit, chr(10) ORDER BY path, i), '') || CASE WHEN count(*) >= 200 THEN chr(10) || '[search truncated after 200 matches]' WHEN (SELECT max(total) FROM t) > 5000000 THEN chr(10) || '[search truncated after 5 MB]' ELSE '' END, 20000) FROM h
    UNION ALL SELECT 'shell', 'shell is disabled' UNION ALL SELECT 'grep', 'unknown tool: grep'"""
)
def cmp_tool_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-07, FN-13/14, WIN-04/05: what the tools answer over a file tree."""
    path = F.concat(F.lit("src/"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    asked = [("list_files", {"path": "src/3"}), ("read_file", {"path": "src/5/5.txt"}), ("search", {"query": "rights reserved"}), ("shell", {}), ("grep", {})]
    return reduce(DataFrame.unionByName, [answer_tool(files, name, arguments).select(F.lit(name).alias("tool"), F.col("text").alias("answer")) for name, arguments in asked])
