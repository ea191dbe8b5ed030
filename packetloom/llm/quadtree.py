"""A K-squared tree (K = 2) over the non-zero cells of a matrix, and its joint traversal by pairs of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def interleaved(rows: np.ndarray, cols: np.ndarray, bits: int) -> np.ndarray:
    """Codes whose base-4 digits, from the top, name the quadrant at each level."""
    codes = np.zeros(len(rows), np.int64)
    for bit in range(bits):
        codes |= ((rows >> bit) & 1) << (2 * bit + 1) | ((cols >> bit) & 1) << (2 * bit)
    return codes


@dataclass
class Tree:
    """Per level, of each quadrant that is not all zero: which of its four quadrants are not, and where the
    first of these stands in the next level. Those of the last level are the cells in order of their codes."""

    bits: int
    masks: list[np.ndarray]
    firsts: list[np.ndarray]

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """Where a quadrant of each node stands in the next level; -1 if it, or the node, is all zero."""
        if not len(self.masks[level]):
            return np.full(len(node), -1)
        mask = np.where(node >= 0, self.masks[level][node], 0)
        place = self.firsts[level][node] + np.bitwise_count(mask & ((1 << quadrant) - 1))
        return np.where((mask >> quadrant) & 1, place, -1)


def build(codes: np.ndarray, bits: int) -> Tree:
    """The tree over sorted distinct codes."""
    masks, firsts = [], []
    for level in range(bits):
        children = np.unique(codes >> 2 * (bits - 1 - level))
        first = np.flatnonzero(np.diff(children >> 2, prepend=-1))
        digits = (1 << (children & 3)).astype(np.uint8)
        masks.append(np.bitwise_or.reduceat(digits, first) if len(first) else digits)
        firsts.append(first)
    return Tree(bits, masks, firsts)


def term(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) in whole numbers."""
    return (p - q) ** 2 // q


def pair_sums(
    rows: np.ndarray, cols: np.ndarray, p: np.ndarray, empty: np.ndarray, width: int, split: int = 0
) -> np.ndarray:
    """Sum of :func:`term` over ``width`` columns for each ordered pair of different rows.

    ``p`` belongs to the non-zero cells, ``empty`` is what a row has in its all-zero cells. The pair descends the
    tree together. A quadrant that is all zero for both rows of every pair in it isn't opened: its columns are
    counted, and priced once per pair in the end. ``split`` restricts to pairs of a row below it and one from it on.
    """
    n = len(empty)
    bits = max(int(max(n, width, 2) - 1).bit_length(), 1)
    codes = interleaved(rows, cols, bits)
    order = np.argsort(codes)
    p, tree = p[order], build(codes[order], bits)
    sums, zeros = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    root = np.zeros(1, np.int64)
    a, b, ra, rb, c = (root if len(codes) else root - 1), (root if len(codes) else root - 1), root, root, root
    for level in range(bits):
        side = 1 << (bits - 1 - level)
        found = []
        for da, db, dc in np.ndindex(2, 2, 2):
            ra2, rb2, c2 = 2 * ra + da, 2 * rb + db, 2 * c + dc
            inside = (ra2 <= rb2 if side > 1 else ra2 < rb2) & (rb2 * side < n) & (c2 * side < width)
            if split:
                inside &= (ra2 * side < split) & ((rb2 + 1) * side > split)
            at = np.flatnonzero(inside)
            a2, b2 = tree.child(level, a[at], 2 * da + dc), tree.child(level, b[at], 2 * db + dc)
            ra2, rb2, c2 = ra2[at], rb2[at], c2[at]
            zero = (a2 < 0) & (b2 < 0)
            _price(zeros, ra2[zero], rb2[zero], np.minimum(side, width - c2[zero] * side), side)
            found.append([x[~zero] for x in (a2, b2, ra2, rb2, c2)])
        a, b, ra, rb, c = (np.concatenate(x) for x in zip(*found))
    pa = np.where(a >= 0, p[a], empty[ra]) if len(p) else empty[ra]
    pb = np.where(b >= 0, p[b], empty[rb]) if len(p) else empty[rb]
    np.add.at(sums, (ra, rb), term(pa, pb))
    np.add.at(sums, (rb, ra), term(pb, pa))
    zeros = np.triu(zeros, 1)
    return sums + (zeros + zeros.T) * term(empty[:, None], empty[None, :])


def _price(zeros: np.ndarray, ra: np.ndarray, rb: np.ndarray, columns: np.ndarray, side: int) -> None:
    """Add the columns of all-zero quadrants to every pair of rows in them."""
    if not len(ra):
        return
    n = len(zeros)
    blocks = -(-n // side)
    found = np.zeros((blocks, blocks), np.int64)
    np.add.at(found, (ra, rb), columns)
    zeros += np.repeat(np.repeat(found, side, axis=0), side, axis=1)[:n, :n]
