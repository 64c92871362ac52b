"""Score-aware (anisotropic) product quantisation with four-bit codes, over a
coarse partition, in numpy."""

from __future__ import annotations

import numpy as np

CODES = 16  # of a subspace: four bits


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that very
    large and very small components are safe."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        own = ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


class Quantiser:
    """Fitted on a sample of unit vectors.

    The loss of a code is the squared residual, its part parallel to the
    vector weighted by (d - 1) t^2 / (1 - t^2): an error along the vector
    changes the large inner products, which decide who is nearest, most.
    """

    def __init__(self, x: np.ndarray, clusters: int, width: int = 2, t: float = 0.2, rounds: int = 6, seed: int = 1) -> None:
        self.d = x.shape[1]
        self.m = -(-self.d // width)
        self.width = width
        x = self._padded(x)
        self.weight = max((self.d - 1) * t * t / (1 - t * t), 1.0)
        self.centres = k_means(x, clusters, 10, seed)
        own = self.cluster(x)
        r = x - self.centres[own]
        # a tight cluster's residuals are coded as finely, for their size, as a wide one's
        total = np.bincount(own, weights=(r * r).sum(axis=1), minlength=clusters) / np.maximum(np.bincount(own, minlength=clusters), 1)
        self.scale = np.maximum(np.sqrt(total), 1e-6).astype(np.float32)
        r = r / self.scale[own][:, None]
        self.books = np.stack([k_means(r[:, self._part(s)], CODES, 8, seed + s) for s in range(self.m)])
        codes = np.stack([((self.books[s] ** 2).sum(axis=1)[None] - 2 * r[:, self._part(s)] @ self.books[s].T).argmin(axis=1) for s in range(self.m)], axis=1)
        for _ in range(rounds):
            codes = self._improve(x, r, codes)
            self._refit(x, r, codes)
        self.probes = clusters

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(np.asarray(x, np.float32), ((0, 0), (0, self.m * self.width - x.shape[1])))

    def _part(self, s: int) -> slice:
        return slice(s * self.width, (s + 1) * self.width)

    def cluster(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1)[None] - 2 * x @ self.centres.T).argmin(axis=1)

    def _decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[s][codes[:, s]] for s in range(self.m)], axis=1)

    def _improve(self, x: np.ndarray, r: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Coordinate descent over the subspaces under the anisotropic loss."""
        codes = codes.copy()
        parallel = ((r - self._decoded(codes)) * x).sum(axis=1)
        for s in range(self.m):
            xs, rs = x[:, self._part(s)], r[:, self._part(s)]
            left = rs[:, None, :] - self.books[s][None]
            along = np.einsum("ncw,nw->nc", left, xs)
            rest = parallel - along[np.arange(len(x)), codes[:, s]]
            loss = (left**2).sum(axis=2) + (self.weight - 1) * (rest[:, None] + along) ** 2
            codes[:, s] = loss.argmin(axis=1)
            parallel = rest + along[np.arange(len(x)), codes[:, s]]
        return codes

    def _refit(self, x: np.ndarray, r: np.ndarray, codes: np.ndarray) -> None:
        """Least-squares code words for given codes."""
        for s in range(self.m):
            parallel = ((r - self._decoded(codes)) * x).sum(axis=1)
            xs, rs = x[:, self._part(s)].astype(np.float64), r[:, self._part(s)].astype(np.float64)
            own = self.books[s][codes[:, s]]
            rest = parallel - ((rs - own) * xs).sum(axis=1) + (rs * xs).sum(axis=1)
            for c in np.unique(codes[:, s]):
                i = codes[:, s] == c
                a = i.sum() * np.eye(self.width) + (self.weight - 1) * xs[i].T @ xs[i]
                self.books[s, c] = np.linalg.solve(a, rs[i].sum(axis=0) + (self.weight - 1) * (xs[i] * rest[i, None]).sum(axis=0))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and codes of unit vectors."""
        x = self._padded(x)
        own = self.cluster(x)
        r = (x - self.centres[own]) / self.scale[own][:, None]
        codes = np.stack([((self.books[s] ** 2).sum(axis=1)[None] - 2 * r[:, self._part(s)] @ self.books[s].T).argmin(axis=1) for s in range(self.m)], axis=1)
        for _ in range(2):
            codes = self._improve(x, r, codes)
        return own, codes.astype(np.uint8)

    def nearest_clusters(self, q: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(self._padded(q) @ self.centres.T), axis=1, kind="stable")[:, :n]

    def scan(self, q: np.ndarray, cluster: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries with the codes of a cluster:
        sums of entries of four-bit tables."""
        q = self._padded(q)
        out = np.repeat((q @ self.centres[cluster])[:, None], len(codes), axis=1)
        for s in range(self.m):
            tables = q[:, self._part(s)] @ self.books[s].T
            out += (self.scale[cluster] * tables)[:, codes[:, s]]
        return out


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes in a byte."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return even[:, ::2] | (even[:, 1::2] << 4)


def unpack(packed: np.ndarray, m: int) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & 15, packed >> 4
    return out[:, :m]
