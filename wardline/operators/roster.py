"""The most similar of many known vectors, exactly, without comparing every pair."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Similarities closer than this are told apart by a product in a fixed order.
CLOSE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass
class Known:
    """Known unit vectors in blocks, each about a pivot: the smallest and largest angle between it and its vectors. Of angles
    the triangle inequality holds, so a vector at an angle a to the pivot is within max(0, a - high, low - a) of none of them; a
    block is compared with those that could still find a better one in it. Blocks are matrices, compared as such."""

    pivots: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray, float, float]]  # rows, vectors, low, high
    zero: np.ndarray  # rows of vectors without a direction, which are 0 to all

    @classmethod
    def of(cls, vectors: np.ndarray, each: int = 256, rounds: int = 4) -> Known:
        x = unit(vectors)
        live = np.flatnonzero(np.abs(x).sum(axis=1) > 0)
        zero = np.setdiff1d(np.arange(len(x)), live)
        if not live.size:
            return cls(np.zeros((0, x.shape[1])), [], zero)
        pivots = x[live[:: max(1, -(-live.size // max(1, live.size // each)))]]
        for _ in range(rounds):  # pivots move to the middle of their vectors
            of = np.argmax(x[live] @ pivots.T, axis=1)
            sums = np.zeros_like(pivots)
            np.add.at(sums, of, x[live])
            pivots = unit(np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, sums, pivots))
        of, blocks, used = np.argmax(x[live] @ pivots.T, axis=1), [], []
        for k in np.unique(of):
            rows = live[of == k]
            angle = np.arccos(np.clip(x[rows] @ pivots[k], -1, 1))
            blocks.append((rows, x[rows], float(angle.min()) - 1e-7, float(angle.max()) + 1e-7))
            used.append(k)
        return cls(pivots[used], blocks, zero)

    def nearest(self, faces: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each vector the row of the most similar known one, the first of equals, its cosine, and how many pairs were compared. A
        vector without a direction is 0 to all."""
        f = unit(faces)
        n, compared = len(f), 0
        best, row = np.full(n, -np.inf), np.full(n, -1, np.int64)
        if self.zero.size:
            best[:], row[:] = 0.0, self.zero[0]
        if not self.blocks:
            return row, best, 0
        angle = np.arccos(np.clip(f @ self.pivots.T, -1, 1))
        low, high = (np.array([b[k] for b in self.blocks]) for k in (2, 3))
        bound = np.cos(np.minimum(np.maximum(0.0, np.maximum(angle - high, low - angle)), np.pi))
        flat = np.abs(f).sum(axis=1) == 0
        bound[flat] = 1.0
        order = np.argsort(-bound, axis=1)
        for turn in range(len(self.blocks)):
            mine = order[:, turn]
            open_ = bound[np.arange(n), mine] >= best - CLOSE
            if not open_.any():
                break
            for k in np.unique(mine[open_]):
                at = np.flatnonzero(open_ & (mine == k))
                rows, x = self.blocks[k][:2]
                got = f[at] @ x.T
                compared += got.size
                near = got >= np.maximum(got.max(axis=1), best[at])[:, None] - CLOSE
                i, j = np.nonzero(near)
                s = np.einsum("ij,ij->i", f[at[i]], x[j])  # the same sum wherever a vector stands
                for p, r, v in zip(at[i], rows[j], s):
                    if v > best[p] or v == best[p] and r < row[p]:
                        best[p], row[p] = v, r
        return row, best, compared
