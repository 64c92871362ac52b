"""Bounded labelled samples, Adam and calibration for the trained models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, stored


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


#: Rows of a class that fit into its bytes whatever comes first by hash: texts
#: over this part of the bytes are only taken after all shorter ones.
LEAST_ROWS = 8


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, most_bytes: int = 4 << 20) -> list[tuple[bytes, int]]:
    """Whole texts and labels outside the held-out fold: per class the
    `per_class` labelled documents whose hashed ids come first, and of these
    all, in the same order, that still fit into `most_bytes`; one that does
    not is passed over and the next is tried.  The two bounds are the only
    sampling of the classifiers; no text is cut, in training or in scoring.

    Texts over an eighth of the bytes come after all others of the class, the
    shortest of them first, so a few very long ones cannot use up the sample.
    A class that has labelled documents and none that fits is an error.
    Labels without a document and rows without a label are left out; of
    several labels of an id the largest counts, of several texts of an id the
    smallest."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").where(fold("id", folds) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = texts.select("id", F.octet_length("text").cast("long").alias("size")).join(known, "id").groupBy("id", "y").agg(F.max("size").alias("size"))
    labelled = stored(sizes.where(F.col("y").isin(0, 1)), "labelled")
    long = F.when(F.col("size") * LEAST_ROWS > most_bytes, F.col("size")).otherwise(0)
    chosen: dict = {}
    for y in (0, 1):
        left, first = most_bytes, labelled.where(F.col("y") == y).orderBy(long, F.xxhash64("id"), "id").limit(per_class).collect()
        for r in first:
            if r["size"] <= left:
                left -= r["size"]
                chosen[r["id"]] = y
        if first and y not in chosen.values():
            raise ValueError(f"{label} = {y}: the shortest labelled text has {first[0]['size']} bytes, more than the {most_bytes} of a sample")
    forget(labelled)
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], texts.select("id").schema)  # 2 * per_class rows at most
    rows = texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"))
    return [(r["text"].encode(), chosen[r["id"]]) for r in sorted(rows.collect(), key=lambda r: r["id"])]


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(logit: np.ndarray, y: np.ndarray, threshold: float) -> tuple[float, float]:
    """Scale and shift after which the cut that divides the classes best (by
    balanced accuracy, in the middle of its gap) has the probability
    `threshold`, and the classes' means are about 6 apart."""
    order = np.argsort(logit, kind="stable")
    x, t = logit[order], y[order]
    right = (t == 0).cumsum() / max((t == 0).sum(), 1) + (t == 1).sum() / max((t == 1).sum(), 1) - (t == 1).cumsum() / max((t == 1).sum(), 1)
    gap = np.append(np.diff(x), 0.0)
    k = max(range(len(x) - 1), key=lambda i: (round(right[i], 9), gap[i])) if len(x) > 1 else 0
    cut = (x[k] + x[min(k + 1, len(x) - 1)]) / 2
    apart = abs(x[t == 1].mean() - x[t == 0].mean()) if 0 < t.sum() < len(t) else 1.0
    scale = 6 / max(apart, 1e-3)
    return scale, math.log(threshold / (1 - threshold)) - scale * cut
