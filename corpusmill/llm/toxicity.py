"""Toxicity: a bidirectional gated recurrent network with attention pooling,
in numpy.

A document's words are read in overlapping windows that cover all of it.  Each
word enters as learned vectors of the word and of its 3- to 5-byte pieces,
trained with the network, and beside them as evidence: how much more often the
word and its pieces stand in toxic texts of the labelled sample.  Two gated
recurrent passes run over a window, attention weighs their states, and the
document's score is that of its most toxic window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learn import Adam, calibrate, fold, labelled_sample, sigmoid
from .shared import named, numbered, slices, texts_of
from .words import _BYTES, ALNUM, LOWER, U, mix, words

WINDOW, STEP, HIDDEN, BUCKETS = 32, 24, 8, 1 << 18
GRAMS = (3, 4, 5)
EVIDENCE = 3 + 2 * len(GRAMS)
#: Learned numbers of a word and of its pieces, and buckets of either table.
VECTOR, ROWS, VECTOR_RATE = 4, 1 << 15, 0.02
INPUTS = EVIDENCE + 2 * VECTOR


class Tokens:
    """Texts as ids of their different words, and each word's inputs' keys."""

    def __init__(self, texts: list[bytes]) -> None:
        w = words(texts, ALNUM)
        unique, at, self.ids = np.unique(w.hash, return_index=True, return_inverse=True)
        self.first = w.first
        self.word = (unique % U(BUCKETS)).astype(np.int64)
        raw = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        start, size = w.start[at], (w.end - w.start)[at]
        # each different word with a mark before and after, on one line
        room = size + 2
        begin = np.cumsum(room) - room
        line = np.full(int(room.sum()) + max(GRAMS), 32, np.uint8)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        line[np.repeat(begin + 1, size) + place] = raw[np.repeat(start, size) + place]
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # bucket of each piece; first piece of each word
        code = _BYTES[line]
        for g in GRAMS:
            h = np.zeros(len(line) - g + 1, U)
            for k in range(g):
                h = h * U(0x2545F4914F6CDD1D) + code[k : k + len(h)]
            many = np.maximum(room - g + 1, 1)
            first = np.cumsum(many) - many
            own = np.repeat(begin, many) + np.arange(int(many.sum())) - np.repeat(first, many)
            self.grams.append(((mix(h[own] + U(g)) % U(BUCKETS)).astype(np.int64), first))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (plus one; 0 is none) of each window, and each text's
        first window; a text without words has one empty window."""
        counts = np.diff(self.first)
        many = np.maximum(1, -(-(counts - (WINDOW - STEP)) // STEP))
        first = np.concatenate([[0], np.cumsum(many)])
        doc = np.repeat(np.arange(len(counts)), many)
        at = (np.arange(first[-1]) - first[doc]) * STEP
        place = at[:, None] + np.arange(WINDOW)
        real = place < counts[doc][:, None]
        padded = np.concatenate([self.ids + 1, np.zeros(1, np.int64)])
        return np.where(real, padded[np.minimum(self.first[doc][:, None] + place, len(self.ids))], 0), first


class Evidence:
    """How much more often words and pieces stand in toxic texts of a sample:
    shrunken log ratios of document counts."""

    def __init__(self) -> None:
        self.count = np.zeros((2, 1 + len(GRAMS), BUCKETS), np.float32)
        self.docs = np.zeros(2)

    def add(self, texts: list[bytes], y: np.ndarray) -> Evidence:
        for t, label in zip(texts, y, strict=True):
            tokens = Tokens([t])
            self.docs[label] += 1
            self.count[label, 0, np.unique(tokens.word)] += 1
            for g, (bucket, _) in enumerate(tokens.grams):
                self.count[label, 1 + g, np.unique(bucket)] += 1
        return self

    def finish(self) -> Evidence:
        n, p = self.count
        ratio = np.log((p + 0.5) / (self.docs[1] + 1)) - np.log((n + 0.5) / (self.docs[0] + 1))
        self.table = (ratio * (n + p) / (n + p + 2)).astype(np.float32)
        self.seen = np.log1p(n[0] + p[0]).astype(np.float32) / 5
        return self

    def inputs(self, tokens: Tokens) -> np.ndarray:
        """The inputs of each different word; row 0 is no word."""
        out = np.zeros((len(tokens.word) + 1, EVIDENCE), np.float32)
        if len(tokens.word):
            out[1:, 0] = self.table[0, tokens.word] / 2
            out[1:, 1] = self.seen[tokens.word]
            out[1:, 2] = 1
            for g, (bucket, first) in enumerate(tokens.grams):
                v = self.table[1 + g, bucket] / 2
                out[1:, 3 + 2 * g] = np.maximum.reduceat(v, first)
                out[1:, 4 + 2 * g] = np.minimum.reduceat(v, first)
        return out


class Vectors:
    """Learned vectors of words and of pieces, in hashed tables that begin at
    zero: what the sample does not have says nothing."""

    def __init__(self) -> None:
        self.tables = [np.zeros((ROWS, VECTOR), np.float32) for _ in range(2)]
        self.seen = [np.full((ROWS, 1), 1e-6, np.float32) for _ in range(2)]

    @staticmethod
    def _pieces(tokens: Tokens, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each size: the rows of these words' pieces, and how many each
        word has."""
        out = []
        for bucket, first in tokens.grams:
            many = np.diff(np.append(first, len(bucket)))[words]
            at = np.repeat(first[words] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            out.append((bucket[at] % ROWS, many))
        return out

    def inputs(self, tokens: Tokens, words: np.ndarray) -> np.ndarray:
        """The vectors of these different words, their pieces' averaged."""
        out = np.zeros((len(words), 2 * VECTOR), np.float32)
        if len(words):
            out[:, :VECTOR] = self.tables[0][tokens.word[words] % ROWS]
            for rows, many in self._pieces(tokens, words):
                out[:, VECTOR:] += np.add.reduceat(self.tables[1][rows], np.cumsum(many) - many) / (many[:, None] * len(GRAMS))
        return out

    def step(self, tokens: Tokens, words: np.ndarray, grad: np.ndarray, rate: float) -> None:
        """Descend along the gradients of these words' vectors, each row at a
        rate of its own."""
        if len(words):
            self._move(0, tokens.word[words] % ROWS, grad[:, :VECTOR], rate)
            for rows, many in self._pieces(tokens, words):
                self._move(1, rows, np.repeat(grad[:, VECTOR:] / (many[:, None] * len(GRAMS)), many, axis=0), rate)

    def _move(self, which: int, rows: np.ndarray, grad: np.ndarray, rate: float) -> None:
        own, at = np.unique(rows, return_inverse=True)
        total = np.zeros((len(own), VECTOR), np.float32)
        np.add.at(total, at, grad)
        self.seen[which][own] += (total**2).mean(axis=1, keepdims=True)
        self.tables[which][own] -= rate * total / np.sqrt(self.seen[which][own])


class Network:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)

        # of either direction: input, recurrent and bias of update, reset and candidate
        self.params = [normal(INPUTS, 3 * HIDDEN), normal(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32), normal(INPUTS, 3 * HIDDEN), normal(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32), normal(2 * HIDDEN, HIDDEN), normal(HIDDEN), normal(2 * HIDDEN), np.zeros(1, np.float32)]
        self.scale, self.shift = 1.0, 0.0

    @staticmethod
    def _gates(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zr = 1 / (1 + np.exp(-np.clip(x[:, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN], -15, 15)))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        return z, r, np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])

    def forward(self, inputs: np.ndarray, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """A logit of each window; with keep, what `backward` needs."""
        p, n = self.params, len(windows)
        states, memory = np.empty((n, WINDOW, 2 * HIDDEN), np.float32), {}
        real = (windows > 0).astype(np.float32)
        for d in (0, 1):
            x = inputs @ p[3 * d] + p[3 * d + 2]
            h, log = np.zeros((n, HIDDEN), np.float32), []
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                z, r, c = self._gates(x[windows[:, t]], h, p[3 * d + 1])
                z = z * real[:, t : t + 1]  # no word leaves the state as it is
                new = h + z * (c - h)
                if keep:
                    log.append((t, h, z, r, c))
                h = new
                states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
            memory[d] = log
        a = np.tanh(states @ p[6])
        e = np.where(real > 0, a @ p[7], -30)
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", w, states)
        memory |= {"a": a, "w": w, "pooled": pooled, "states": states, "real": real}
        return pooled @ p[8] + p[9][0], memory

    def backward(self, inputs: np.ndarray, windows: np.ndarray, m: dict, error: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Gradients of the parameters, and of the inputs at each place."""
        p, g = self.params, [np.zeros_like(x) for x in self.params]
        dx = np.zeros((*windows.shape, INPUTS), np.float32)
        g[8], g[9] = m["pooled"].T @ error, np.array([error.sum()], np.float32)
        dp = error[:, None] * p[8]
        ds = m["w"][:, :, None] * dp[:, None, :]
        dw = np.einsum("nh,nth->nt", dp, m["states"])
        de = m["w"] * (dw - (m["w"] * dw).sum(axis=1, keepdims=True)) * m["real"]
        g[7] = np.einsum("nt,nth->h", de, m["a"])
        da = de[:, :, None] * p[7] * (1 - m["a"] ** 2)
        g[6] = np.einsum("ntk,nth->kh", m["states"], da)
        ds += da @ p[6].T
        for d in (0, 1):
            u, dh = p[3 * d + 1], np.zeros((len(windows), HIDDEN), np.float32)
            for t, h, z, r, c in reversed(m[d]):
                dh = dh + ds[:, t, d * HIDDEN : (d + 1) * HIDDEN]
                dc = dh * z * (1 - c**2)
                dz = dh * (c - h) * z * (1 - z) * m["real"][:, t : t + 1]
                drh = dc @ u[:, 2 * HIDDEN :].T
                dr = drh * h * r * (1 - r)
                back = np.concatenate([dz, dr, dc], axis=1)
                x = inputs[windows[:, t]]
                dx[:, t] += back @ p[3 * d].T
                g[3 * d] += x.T @ back
                g[3 * d + 2] += back.sum(axis=0)
                g[3 * d + 1] += np.concatenate([h.T @ back[:, : 2 * HIDDEN], (r * h).T @ dc], axis=1)
                dh = dh * (1 - z) + back[:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T + drh * r
        return g, dx


class Model:
    """Evidence, vectors and network; score is the largest window's
    probability."""

    def __init__(self, evidence: Evidence, vectors: Vectors, net: Network) -> None:
        self.evidence, self.vectors, self.net = evidence, vectors, net

    def inputs(self, tokens: Tokens) -> np.ndarray:
        return self.joined(self.evidence.inputs(tokens), tokens)

    def joined(self, evidence: np.ndarray, tokens: Tokens) -> np.ndarray:
        """Evidence and vectors of each different word; row 0 is no word."""
        vectors = self.vectors.inputs(tokens, np.arange(len(tokens.word)))
        return np.concatenate([evidence, np.concatenate([np.zeros((1, 2 * VECTOR), np.float32), vectors])], axis=1)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        tokens = Tokens(texts)
        windows, first = tokens.windows()
        return np.maximum.reduceat(self.of_windows(self.inputs(tokens), windows), first[:-1])

    def of_windows(self, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.net.forward(inputs, windows[a : a + 2048])[0] for a in range(0, len(windows), 2048)])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.net.scale * self.logits(texts).astype(np.float64) + self.net.shift)


#: Epochs before which every window of every text is scored anew, and the one
#: that scores highest in each text becomes the one that is trained.
LOOK_AGAIN = {0, 1, 2, 4, 6, 9, 12}


def train(sample: list[tuple[bytes, int]], threshold: float, epochs: int = 16, rate: float = 0.02) -> Model | float:
    """Evidence counted on one half of the sample is what the network is
    trained with on the other, and the other way round, so that it learns how
    far evidence carries over; at the end all of it is counted.  Vectors are
    trained with the network, with those of half the words left out at random
    in each step, so that they add to the evidence and do not replace it.  Of
    a text the window that scores highest of all its windows is trained.  A
    sample of one class gives that class, an empty one 0.5."""
    y = np.array([b for _, b in sample])
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    texts, rng = [a for a, _ in sample], np.random.default_rng(17)
    half = np.zeros(len(y), int)
    for label in (0, 1):
        own = np.flatnonzero(y == label)
        half[own] = np.arange(len(own)) % 2
    parts = []
    model = Model(Evidence(), Vectors(), Network())
    net, vectors = model.net, model.vectors
    for k in (0, 1):
        learn, use = np.flatnonzero(half != k), np.flatnonzero(half == k)
        evidence = Evidence().add([texts[i] for i in learn], y[learn]).finish()
        tokens = Tokens([texts[i] for i in use])
        parts.append((tokens, evidence.inputs(tokens), *tokens.windows(), y[use]))
    adam = Adam(net.params, rate)
    balance = (y == 0).sum() / max((y == 1).sum(), 1)
    tops: list[np.ndarray] = [np.zeros(0, int)] * 2
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / (epochs + 4))
        for k, (tokens, evidence, windows, first, label) in enumerate(parts):
            if epoch in LOOK_AGAIN:
                logit = model.of_windows(model.joined(evidence, tokens), windows)
                tops[k] = np.array([a + logit[a:b].argmax() for a, b in zip(first[:-1], first[1:], strict=True)])
            order = rng.permutation(len(label))
            for a in range(0, len(order), 64):
                i = order[a : a + 64]
                part = windows[tops[k][i]]
                words, at = np.unique(np.append(part.reshape(-1), 0), return_inverse=True)  # the first is no word
                at = at[:-1].reshape(part.shape)
                shown = rng.random(len(words) - 1) < 0.5
                local = np.zeros((len(words), INPUTS), np.float32)
                local[:, :EVIDENCE] = evidence[words]
                local[1:, EVIDENCE:] = vectors.inputs(tokens, words[1:] - 1) * shown[:, None]
                out, memory = net.forward(local, at, True)
                weight = np.where(label[i] == 1, min(balance, 4.0), 1.0)
                grads, dx = net.backward(local, at, memory, ((sigmoid(out) - label[i]) * weight / len(i)).astype(np.float32))
                adam.step(grads)
                moved = np.zeros((len(words), 2 * VECTOR), np.float32)
                np.add.at(moved, at.reshape(-1), dx[:, :, EVIDENCE:].reshape(-1, 2 * VECTOR))
                vectors.step(tokens, words[1:][shown] - 1, moved[1:][shown], VECTOR_RATE)
    logits = [np.maximum.reduceat(model.of_windows(model.joined(evidence, tokens), windows), first[:-1]) for tokens, evidence, windows, first, _ in parts]
    net.scale, net.shift = calibrate(np.concatenate(logits), np.concatenate([p[4] for p in parts]), threshold)
    model.evidence = Evidence().add(texts, y).finish()
    return model


def toxicity_model(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, per_class: int = 700) -> Model | float:
    """Trained on the driver on whole texts of `per_class` labelled rows of
    each class and 4 MB of a class at most, never of the held-out fold."""
    return train(labelled_sample(docs, labels, "toxic", folds, held_out, per_class), threshold)


def score_toxicity(docs: DataFrame, model: Model | float, column: str = "score", text_col: str = "text") -> DataFrame:
    """The columns of docs and the score of each whole text, in one map over
    the rows without a shuffle; a worker reads 1 MB of text or one document at
    a time.  A null or empty text gets the score of an empty window."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    place, inner = f"c{names.index(text_col)}", [f"c{i}" for i in range(len(names))]
    out = numbered(docs).withColumn(column, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for b in slices(batches, place, 1 << 20):
            texts = texts_of(b.column(place))
            score = np.full(len(texts), found) if isinstance(found, float) else found.scores(texts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in inner), pa.array(score, pa.float64())], names=[*inner, column])

    return named(out.mapInArrow(run, out.schema), names, column)


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    A null text counts as empty; a null id is hashed as ''; repeated rows give
    repeated rows; an empty table gives none; without labels of both classes
    the score is that class, or 0.5.  Other columns are not read.
    """
    model = toxicity_model(docs, labels, folds, held_out, threshold)
    scored = score_toxicity(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
