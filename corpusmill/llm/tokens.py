"""Token counts of whole texts, by rank-synchronous array merging (bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import batch_of, slices, texts_of


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row.

    tokenizer: path of a byte-level BPE file, on every executor.  One map over
    the rows without a shuffle; a worker holds 1 MB of text, or one document,
    at a time.  A null text counts as empty: 0 bytes, 0 tokens.  Bytes that are no
    UTF-8 count as the replacement character.  A null id stays null; repeated rows give repeated rows; an empty table gives none.
    Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bpe.load(tokenizer)
        for b in slices(batches, "text"):
            raw = texts_of(b.column("text"))
            n = table.count_many([x.decode("utf-8", "replace") for x in raw])
            yield batch_of(schema, doc_id=b.column("doc_id").cast(pa.int64()).to_pylist(), n_bytes=np.fromiter(map(len, raw), np.int64, len(raw)), n_tokens=n, over_limit=n > limit)

    return source.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
