"""The registered queries of this subpackage: each applies one operator with
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .copies import copy_report
from .decontaminate import decontamination_report
from .lexical import rank_documents
from .licenses import scan_licenses
from .lloyd import clusters
from .nearest import nearest
from .neardup import near_duplicates
from .packing import pack
from .pii import pii_report
from .quality import quality_scores
from .repeats import remove_repeats
from .shared import table
from .tokens import token_counts
from .toxicity import toxicity_scores

TOKENIZER = "byte_bpe_50k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document: a null or empty text gets the score of
    a chunk of padding; repeated rows repeat; no documents, no rows."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and expressions of every whole document; a null or empty
    text has no words and no labels; repeated rows repeat."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of 2048; a null or empty text is the
    end id alone; repeated rows are packed each."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document; a null text has none."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every whole document; a null text has no words,
    an empty benchmark hits nothing."""
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates; texts without words link with nothing,
    rows with a null id have a null component and are kept."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start
    elsewhere too; repeated rows lose such strings all, null is empty."""
    left = remove_repeats(table(spark, sf_dir, "documents"))
    sizes = F.transform("removed", lambda r: r["end"] - r["start"])
    return left.select("doc_id", "n_bytes", F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document: a null or empty text gets the score
    of an empty window; repeated rows repeat."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every query; unusable vectors take no part, ties
    go to the smaller id, a repeated row is one row."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document; a null or empty text has none;
    repeated rows repeat."""
    return pii_report(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item; a null text has no terms
    and an item without terms no results; repeated rows are documents each."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters after ten rounds over every vector of 64 finite
    components; others take no part, ties go to the smaller number."""
    return clusters(table(spark, sf_dir, "embeddings"))


def op13_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over every document; a null text is empty and
    equal to an empty one, a null id loses to all others."""
    return copy_report(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents),
    s AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS total FROM d WHERE len(t) > 0),
    p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term, docs),
    q AS (SELECT DISTINCT i, item_id, term FROM (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark)),
    c AS (SELECT i, item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * docs) // total))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM c WHERE score > 0) WHERE rank <= 50
"""


def _rounds_sql(rounds: int = 10, k: int = 8, d: int = 64) -> str:
    """Each round as a pair of common tables: the nearest centroid of every
    vector, and the centroids after it."""
    near = lambda j: f"a{j} AS MATERIALIZED (SELECT r, min(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * {k} + c) AS m FROM v, c{j} c GROUP BY r)"
    mean = lambda j: f"""s{j} AS (SELECT c, list(x ORDER BY i) AS q FROM (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM (SELECT (m % {k})::INTEGER AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{j} JOIN v USING (r)) GROUP BY c, i) GROUP BY c),
        c{j + 1} AS MATERIALIZED (SELECT c, coalesce(s.q, o.q) AS q FROM c{j} o LEFT JOIN s{j} s USING (c))"""  # noqa: E731
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {d})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1)::INTEGER AS c, q FROM v QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), q) <= {k})",
    ]
    for j in range(rounds):
        parts += [near(j), mean(j)]
    parts.append(near(rounds))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, (m % {k})::INTEGER AS cluster, m // {k} AS distance, (sum(m // {k}) OVER (PARTITION BY m % {k}))::BIGINT AS cluster_inertia, (sum(m // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
FROM (SELECT vec_id, m FROM a{rounds} JOIN v USING (r)) JOIN c{rounds} ON c = m % {k}"""


OP13_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_license_scan, op3_packing, op4_token_counts, op5_decontamination, op6_near_duplicates, op7_repeated_strings, op8_toxicity, op9_nearest, op10_personal_data, op11_lexical_search, op12_centroids, op13_exact_copies)}


def oracle_sql() -> dict[str, str]:
    return {"op11_lexical_search": OP11_SQL, "op12_centroids": _rounds_sql(), "op13_exact_copies": OP13_SQL}
