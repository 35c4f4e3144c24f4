"""The k best columns of every row of a score matrix, kept over slices of the matrix.

Scores of vectors are first taken in single precision. Its error is bounded, so only pairs that can be among the best are
scored again in double precision, and the result is that of double precision alone.
"""

from __future__ import annotations

import numpy as np

from memloom.functions.scoring import SCORE_DIGITS

#: Rows and columns of one slice of scores, and pairs whose vectors are gathered at once.
ROWS, COLUMNS = 1024, 2048
_PAIRS = 1 << 13


class Best:
    """The k best (score, tie) of each row so far; a smaller tie wins. `bar` is the k-th score, minus infinity before that."""

    def __init__(self, rows: int, k: int):
        self.k, self.bar = k, np.full(rows, -np.inf)
        self.row, self.score, self.tie = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, row: np.ndarray, score: np.ndarray, tie: np.ndarray) -> None:
        if not len(row):
            return
        row, score = np.concatenate((self.row, row)), np.concatenate((self.score, score))
        tie = tie if self.tie is None else np.concatenate((self.tie, tie))
        code = np.unique(tie, return_inverse=True)[1] if tie.dtype == object else tie
        order = np.lexsort((code, -score, row))
        ordered = row[order]
        place = np.arange(len(row)) - np.searchsorted(ordered, ordered)
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        self.bar[row[last]] = score[last]
        self.row, self.score, self.tie = row[keep], score[keep], tie[keep]


def candidates(score: np.ndarray, bar: np.ndarray, k: int, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) that may be among the k best, where a score may be wrong by `slack` and the bar is not."""
    floor = bar - slack
    new = np.isneginf(bar)
    if k < score.shape[1] and new.any():
        floor[new] = np.partition(score[new], -k, axis=1)[:, -k] - 2 * slack
    return np.nonzero((score >= floor[:, None].astype(np.float64)) & (score > -np.inf))


def _cut(rows: int, k: int, r: np.ndarray, c: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """No more than the k best of each row; earlier columns win ties."""
    if len(r) <= rows * k:
        return r, c, score
    few = Best(rows, k)
    few.add(r, score, c)
    return few.row, few.tie, few.score


def add_nearest(best: Best, a: np.ndarray, b: np.ndarray, names: np.ndarray, allowed: np.ndarray | None = None) -> None:
    """Takes in the cosines of unit vectors a (the rows of best) and b; names(b) ascend and decide ties."""
    single_a, single_b = a.astype(np.float32), b.astype(np.float32)
    slack = (a.shape[1] + 8) * 2.0 ** -24 + 10.0 ** -SCORE_DIGITS
    whole = best.bar
    for left in range(0, len(a), ROWS):
        rows = slice(left, min(left + ROWS, len(a)))
        part = Best(rows.stop - left, best.k)
        mine = (best.row >= left) & (best.row < rows.stop)
        part.bar = whole[rows].copy()
        part.row, part.score, part.tie = best.row[mine] - left, best.score[mine], None if best.tie is None else best.tie[mine]
        for right in range(0, len(b), COLUMNS):
            cols = slice(right, right + COLUMNS)
            mask = None if allowed is None else ~allowed[rows, cols]
            score = single_a[rows] @ single_b[cols].T
            if mask is not None:
                score[mask] = -np.inf
            r, c = candidates(score, part.bar, best.k, slack)
            if 4 * len(r) > score.size:
                # Very many ties: the slice is scored in double precision at once.
                score = np.round(a[rows] @ b[cols].T, SCORE_DIGITS)
                if mask is not None:
                    score[mask] = -np.inf
                r, c = candidates(score, part.bar, best.k)
                exact = score[r, c]
            else:
                exact = np.zeros(len(r))
                for i in range(0, len(r), _PAIRS):
                    at = slice(i, i + _PAIRS)
                    exact[at] = np.einsum("ij,ij->i", a[r[at] + left], b[c[at] + right])
                exact = np.round(exact, SCORE_DIGITS)
            r, c, exact = _cut(rows.stop - left, best.k, r, c, exact)
            part.add(r, exact, names[c + right])
        whole[rows] = part.bar
        if part.tie is not None:
            others = ~mine
            best.row, best.score = np.concatenate((best.row[others], part.row + left)), np.concatenate((best.score[others], part.score))
            best.tie = part.tie if best.tie is None else np.concatenate((best.tie[others], part.tie))
