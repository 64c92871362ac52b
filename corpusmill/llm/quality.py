"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all of it.  Learned
filters run over each chunk's bytes and are max-pooled over the chunk.  One
more input is computed, not learned: the largest share of bytes that repeat
those some places before, which a filter over byte values cannot see.  The
chunks' pools are combined (largest and mean), and one probability comes out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import Adam, calibrate, fold, labelled_sample, sigmoid
from .shared import batch_of, slices, texts_of

CHUNK, OVERLAP, WIDTH, STRIDE, FILTERS, LAGS, BOX = 512, 64, 8, 2, 16, 40, 32
#: Scale of the share of repeated bytes beside the filters' responses.
REPEATED = np.float32(4)
PAD = 256


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts (rows of byte values, padded at the end) and the
    first chunk of each text; an empty text is one chunk of padding."""
    starts, first = [], [0]
    for t in texts:
        at = np.arange(0, max(len(t) - OVERLAP, 1), CHUNK - OVERLAP)
        starts.append(at)
        first.append(first[-1] + len(at))
    out = np.full((first[-1], CHUNK), PAD, np.int16)
    for t, at, k in zip(texts, starts, first, strict=False):
        raw = np.frombuffer(t, np.uint8)
        for i, s in enumerate(at.tolist()):
            part = raw[s : s + CHUNK]
            out[k + i, : len(part)] = part
    return out, np.array(first)


class Network:
    """kernel[k, byte, filter]: a filter over one-hot bytes; `out` weighs the
    pooled filters."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.kernel = rng.normal(0, 0.15, (WIDTH, 257, FILTERS)).astype(np.float32)
        self.kernel[:, PAD] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS + 2).astype(np.float32)
        self.last = np.zeros(1, np.float32)
        self.scale, self.shift = 1.0, 0.0

    @staticmethod
    def repeats(rows: np.ndarray) -> np.ndarray:
        """Of each chunk, the largest share of bytes equal to those `lag`
        places before, over boxes of 64 bytes and all lags."""
        best = np.zeros(len(rows), np.int16)
        real = rows != PAD
        for lag in range(1, LAGS + 1):
            same = np.zeros(rows.shape, bool)
            np.logical_and(rows[:, lag:] == rows[:, :-lag], real[:, lag:], out=same[:, lag:])
            box = same.reshape(len(rows), -1, BOX).sum(axis=2, dtype=np.int16)
            np.maximum(best, (box[:, 1:] + box[:, :-1]).max(axis=1), out=best)
        return best.astype(np.float32) / (2 * BOX)

    def pool(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest response in each chunk, and its place."""
        best = np.empty((len(rows), FILTERS), np.float32)
        place = np.empty((len(rows), FILTERS), np.int64) if where else None
        for a in range(0, len(rows), 128):  # stays in the cache
            part = rows[a : a + 128]
            n = (CHUNK - WIDTH) // STRIDE + 1
            acc = self.kernel[0][part[:, 0 : STRIDE * n : STRIDE]]
            for k in range(1, WIDTH):
                acc += self.kernel[k][part[:, k : k + STRIDE * n : STRIDE][:, :n]]
            if place is not None:
                at = acc.argmax(axis=1)
                place[a : a + 128] = at * STRIDE
                best[a : a + 128] = np.take_along_axis(acc, at[:, None, :], 1)[:, 0]
            else:
                best[a : a + 128] = acc.max(axis=1)
        return np.maximum(best + self.bias, 0), place

    def features(self, pooled: np.ndarray, repeated: np.ndarray, first: np.ndarray) -> np.ndarray:
        both = np.concatenate([pooled, REPEATED * repeated[:, None]], axis=1)
        size = np.diff(first)[:, None]
        return np.concatenate([np.maximum.reduceat(both, first[:-1], axis=0), np.add.reduceat(both, first[:-1], axis=0) / size], axis=1)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        rows, first = chunks(texts)
        return self.features(self.pool(rows)[0], self.repeats(rows), first) @ self.out + self.last[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.scale * self.logits(texts).astype(np.float64) + self.shift)

    def gradients(self, rows: np.ndarray, repeated: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The weighted logistic loss of documents whose chunks these are, and
        its gradient by kernel, bias, out and last."""
        sizes = np.diff(first)
        doc = np.repeat(np.arange(len(y)), sizes)
        pooled, place = self.pool(rows, True)
        x = self.features(pooled, repeated, first)
        logit = x @ self.out + self.last[0]
        error = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / len(y) + 0.5e-5 * (self.kernel**2).sum() + 0.5e-4 * (self.out**2).sum())
        back, half = error[:, None] * self.out[None], FILTERS + 1
        best = pooled >= np.maximum.reduceat(pooled, first[:-1], axis=0)[doc]
        top = back[:, :FILTERS][doc] * best / np.add.reduceat(best.astype(np.float32), first[:-1], axis=0)[doc]  # chunks that are equally good share it
        grad = (top + back[:, half : half + FILTERS][doc] / sizes[doc][:, None]) * (pooled > 0)
        g = np.zeros_like(self.kernel)
        f = np.broadcast_to(np.arange(FILTERS), place.shape)
        for k in range(WIDTH):
            np.add.at(g[k], (rows[np.arange(len(rows))[:, None], place + k], f), grad)
        g[:, PAD] = 0
        return loss, [g + 1e-5 * self.kernel, grad.sum(axis=0), x.T @ error + 1e-4 * self.out, np.array([error.sum()], np.float32)]

    def fit(self, texts: list[bytes], y: np.ndarray, threshold: float, epochs: int = 14, batch: int = 24) -> Network:
        rng = np.random.default_rng(11)
        rows, first = chunks(texts)
        repeated = self.repeats(rows)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        adam = Adam([self.kernel, self.bias, self.out, self.last], 0.01)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                docs = order[a : a + batch]
                own = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                begin = np.concatenate([[0], np.cumsum([first[d + 1] - first[d] for d in docs])])
                adam.step(self.gradients(rows[own], repeated[own], begin, y[docs], weight[docs])[1])
        self.scale, self.shift = calibrate(self.logits(texts), y, threshold)
        return self


def train(sample: list[tuple[bytes, int]], threshold: float) -> Network | float:
    """The fitted network, or the one class's score where the sample has not
    both: 0.5 without labels."""
    y = np.array([b for _, b in sample])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    # short texts are rare but must not look poor for holding little: beginnings of good ones
    short = [t[: 15 + (37 * k) % 60] for k, (t, b) in enumerate(sample) if b == 1 and k % 3 == 0]
    return Network().fit([a for a, _ in sample] + short, np.append(y, np.ones(len(short), y.dtype)), threshold)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, per_class: int = 400) -> DataFrame:
    """(doc_id, held_out, score, predicted): the quality of each whole text.

    The driver trains on whole texts of `per_class` labelled rows of each class
    and 4 MB of a class at most, never of the held-out fold, and on the
    beginnings of some good ones as further short texts; the weights (about 130 kB) go to the workers,
    which map over the rows without a shuffle, 1 MB of text or one document at
    a time.  A null text counts as empty and gets the score of a chunk of
    padding; a null id is hashed as ''; repeated rows give repeated rows; an
    empty table gives none; without labels of both classes the score is that
    class, or 0.5.
    """
    model = train(labelled_sample(docs, labels, "quality", folds, held_out, per_class), threshold)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", fold("doc_id", folds).alias("fold"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in slices(batches, "text", 1 << 20):
            texts = texts_of(b.column("text"))
            score = np.full(len(texts), net) if isinstance(net, float) else net.scores(texts)
            yield batch_of(schema, doc_id=b.column("doc_id").to_pylist(), held_out=b.column("fold").to_numpy() == held_out, score=score, predicted=(score >= threshold).astype(np.int32))

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
