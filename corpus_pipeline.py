"""A training corpus from raw documents: toxic documents go, near-duplicate
groups keep one document, contaminated documents go, personal data is
replaced, and what is left is packed into sequences.

Every stage reads all that the one before it kept.  All but the last return
the columns of documents.  A null text passes the filters as an empty one;
extra columns stay and may have any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.decontaminate import find_contamination, is_contaminated
from corpusmill.llm.neardup import one_of_each
from corpusmill.llm.packing import pack
from corpusmill.llm.pii import redact
from corpusmill.llm.shared import named, numbered, stored, table
from corpusmill.llm.toxicity import score_toxicity, toxicity_model

TOXIC = 0.7
TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores under the threshold.  A null
    or empty text has the score of an empty window; repeated rows are judged
    alike; without labels of both classes every score is 0.5 or that class.
    An empty table stays empty."""
    names = docs.columns
    model = toxicity_model(docs, table(spark, sf_dir, "labels"), threshold=TOXIC)
    scored = score_toxicity(numbered(docs), model, "toxic_score", f"c{names.index('text')}")
    return named(scored.where(F.col("toxic_score") < TOXIC), names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, the smallest id's, of
    repeated rows the one whose columns are smallest.  Rows without words or
    without an id stay; an empty table stays empty."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth.  A
    null or empty text has no words and stays; repeated rows are judged alike;
    an empty benchmark leaves all, an empty table stays empty."""
    names = docs.columns
    found = find_contamination(numbered(docs), table(spark, sf_dir, "benchmark"), text_col=f"c{names.index('text')}")
    return named(found.where(~is_contaminated()), names)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each found span of a text is its kind in brackets, and
    n_chars counts the new text.  A null text stays null with its n_chars,
    an empty one empty; repeated rows are changed alike, and an empty table
    stays empty."""
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    names = docs.columns
    n, text = (f"c{names.index(c)}" for c in ("n_chars", "text"))
    return named(numbered(clean).withColumn(n, F.coalesce(F.char_length(text).cast(docs.schema["n_chars"].dataType), F.col(n))), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids and an end id in sequences of 2048, a row a piece.
    A null or empty text is the end id alone; repeated rows are packed each;
    an empty table gives no pieces."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("packing", pack_sequences),
]

#: No SQL can train the networks; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
