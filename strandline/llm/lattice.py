"""Segmentations of words into pieces of a fixed vocabulary, for many words at a time."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


class PieceTable:
    """Looks up pieces by a 64-bit polynomial hash of their characters, a sorted table for each length."""

    def __init__(self, ids: dict[str, int]):
        self.longest = max(map(len, ids), default=1)
        self.power = np.array([pow(BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for piece, k in ids.items():
            h = 0
            for c in piece:
                h = (h * BASE + ord(c)) & _MASK
            own[len(piece)].append((h, k))
        self.hashes = {n: np.array([h for h, _ in sorted(x)], np.uint64) for n, x in own.items()}
        self.ids = {n: np.array([k for _, k in sorted(x)], np.int64) for n, x in own.items()}

    def find(self, n: int, h: np.ndarray) -> np.ndarray:
        """The ids of pieces of ``n`` characters with these hashes, -1 where there is none."""
        if n not in self.hashes:
            return np.full(h.shape, -1)
        at = np.minimum(np.searchsorted(self.hashes[n], h), len(self.hashes[n]) - 1)
        return np.where(self.hashes[n][at] == h, self.ids[n][at], -1)


def lattices(words: list[str], table: PieceTable, unknown: int):
    """Groups of words of one length: (their indices, grid); grid[w, end, n - 1]: the piece of n characters that ends
    before ``end + 1``, or -1. A character that no piece covers alone is the piece ``unknown``."""
    by_length = defaultdict(list)
    for k, w in enumerate(words):
        by_length[len(w)].append(k)
    for n, own in by_length.items():
        codes = np.array([words[k] for k in own], f"<U{n}").view("<u4").reshape(len(own), n).astype(np.uint64)
        prefix = np.zeros((len(own), n + 1), np.uint64)
        for end in range(n):
            prefix[:, end + 1] = prefix[:, end] * np.uint64(BASE) + codes[:, end]
        most = min(n, table.longest)
        grid = np.full((len(own), n, most), -1, np.int64)
        for m in range(1, most + 1):
            grid[:, m - 1 :, m - 1] = table.find(m, prefix[:, m:] - prefix[:, : n + 1 - m] * table.power[m])
        grid[:, :, 0][grid[:, :, 0] < 0] = unknown
        yield np.array(own), grid


#: So many characters go on between two rescalings: too few for a float to run out, with pieces of 16.
RESCALED = 4


def log_forward_words(grid: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """The logarithms (words x languages) of the sums, over all segmentations of each word, of the product of its pieces'
    probabilities; ``prob``: (pieces and a row of zeros for -1) x languages. Sums are rescaled on the way, so that none of them
    is too small for a float."""
    count, n, most = grid.shape
    alpha, scale = np.zeros((count, n + 1, prob.shape[1])), np.zeros((count, prob.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, n + 1):
        for m in range(1, min(most, end) + 1):
            alpha[:, end] += alpha[:, end - m] * prob[grid[:, end - 1, m - 1]]
        if end % RESCALED == 0:
            now = alpha[:, end].copy()
            alpha[:, max(0, end - most + 1) : end + 1] /= now[:, None]
            scale += np.log(now)
    return np.log(alpha[:, n]) + scale


def log_ways(grid: np.ndarray, log_prob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha[w, end], beta[w, start]): the logarithms of the sums over all segmentations of the words' first ``end`` characters,
    and of those from ``start``; ``log_prob``: of pieces, and minus infinity for -1."""
    count, n, most = grid.shape
    alpha, beta = np.full((count, n + 1), -np.inf), np.full((count, n + 1), -np.inf)
    alpha[:, 0] = beta[:, n] = 0
    for end in range(1, n + 1):
        for m in range(1, min(most, end) + 1):
            alpha[:, end] = np.logaddexp(alpha[:, end], alpha[:, end - m] + log_prob[grid[:, end - 1, m - 1]])
    for start in range(n - 1, -1, -1):
        for m in range(1, min(most, n - start) + 1):
            beta[:, start] = np.logaddexp(beta[:, start], beta[:, start + m] + log_prob[grid[:, start + m - 1, m - 1]])
    return alpha, beta


def long_grid(word: str, table: PieceTable, unknown: int) -> np.ndarray:
    """The grid of one word of any length: (length, pieces' lengths)."""
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    n, prefix, h = len(codes), np.zeros(len(codes) + 1, np.uint64), 0
    for end, c in enumerate(codes.tolist()):
        h = (h * BASE + c) & _MASK
        prefix[end + 1] = h
    grid = np.full((n, min(n, table.longest)), -1, np.int32)
    for m in range(1, grid.shape[1] + 1):
        grid[m - 1 :, m - 1] = table.find(m, prefix[m:] - prefix[: n + 1 - m] * table.power[m])
    grid[:, 0][grid[:, 0] < 0] = unknown
    return grid


def log_forward(grid: np.ndarray, log_prob: np.ndarray) -> np.ndarray:
    """As ``forward`` for one word, in logarithms: a product over many pieces is too small for a float."""
    n, most = grid.shape
    alpha = np.full((n + 1, log_prob.shape[1]), -np.inf)
    alpha[0] = 0
    for end in range(1, n + 1):
        m = min(most, end)
        alpha[end] = np.logaddexp.reduce(alpha[end - m : end][::-1] + log_prob[grid[end - 1, :m]])
    return alpha


def log_backward(grid: np.ndarray, log_prob: np.ndarray) -> np.ndarray:
    n, most = grid.shape
    beta = np.full((n + 1, log_prob.shape[1]), -np.inf)
    beta[n] = 0
    for start in range(n - 1, -1, -1):
        m = np.arange(1, min(most, n - start) + 1)
        beta[start] = np.logaddexp.reduce(beta[start + m] + log_prob[grid[start + m - 1, m - 1]])
    return beta
