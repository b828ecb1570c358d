"""A small gradient booster for bounded tables of labelled examples, compiled to a Column.

Depth-limited regression trees on the logistic loss, fitted in plain Python on the driver (the tables have
a few hundred rows), then written as nested CASE expressions, so that scoring stays inside Catalyst.

Defined cases: without rows, or with rows of one label only, all margins are alike; ties between splits go to the
first feature and the lowest cut; a threshold that no margin reaches with the precision asked for is infinite.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Node = tuple


def _leaf(grad: list[float], hess: list[float], idx: list[int], lam: float) -> float:
    return sum(grad[i] for i in idx) / (sum(hess[i] for i in idx) + lam)


def _grow(rows, grad, hess, idx, depth, lam, least) -> Node:
    g, h = sum(grad[i] for i in idx), sum(hess[i] for i in idx)
    best = (1e-9, None, None)
    if depth:
        for f in range(len(rows[0]) if rows else 0):
            order = sorted(idx, key=lambda i: rows[i][f])
            gl = hl = 0.0
            for a, (i, j) in enumerate(zip(order, order[1:])):
                gl, hl = gl + grad[i], hl + hess[i]
                if rows[i][f] == rows[j][f] or a + 1 < least or len(order) - a - 1 < least:
                    continue
                gain = gl * gl / (hl + lam) + (g - gl) ** 2 / (h - hl + lam) - g * g / (h + lam)
                if gain > best[0] + 1e-12:
                    best = (gain, f, (rows[i][f] + rows[j][f]) / 2)
    if best[1] is None:
        return ("leaf", _leaf(grad, hess, idx, lam))
    _, f, cut = best
    left, right = [i for i in idx if rows[i][f] <= cut], [i for i in idx if rows[i][f] > cut]
    return ("split", f, cut, _grow(rows, grad, hess, left, depth - 1, lam, least), _grow(rows, grad, hess, right, depth - 1, lam, least))


def _value(node: Node, row) -> float:
    while node[0] == "split":
        node = node[3] if row[node[1]] <= node[2] else node[4]
    return node[1]


class Booster:
    """``fit`` on rows of numbers and 0/1 labels; ``margin`` per row; ``column`` for Spark."""

    def __init__(self, trees: int = 12, depth: int = 3, rate: float = 0.4, lam: float = 1.0, least: int = 4):
        self.n, self.depth, self.rate, self.lam, self.least = trees, depth, rate, lam, least
        self.bias, self.trees, self.width = 0.0, [], 0

    def fit(self, rows: list[list[float]], labels: list[int]) -> Booster:
        p = (sum(labels) + 1) / (len(labels) + 2)
        self.bias, self.trees, self.width = math.log(p / (1 - p)), [], len(rows[0]) if rows else 0
        score = [self.bias] * len(rows)
        for _ in range(self.n):
            prob = [1 / (1 + math.exp(-s)) for s in score]
            tree = _grow(rows, [y - q for y, q in zip(labels, prob)], [q * (1 - q) for q in prob], list(range(len(rows))), self.depth, self.lam, self.least)
            self.trees.append(tree)
            score = [s + self.rate * _value(tree, r) for s, r in zip(score, rows)]
        return self

    def margin(self, row) -> float:
        return self.bias + sum(self.rate * _value(t, row) for t in self.trees)

    def column(self, features: list[Column]) -> Column:
        def of(node: Node) -> Column:
            if node[0] == "leaf":
                return F.lit(float(node[1] * self.rate))
            return F.when(features[node[1]] <= F.lit(float(node[2])), of(node[3])).otherwise(of(node[4]))

        out = F.lit(float(self.bias))
        for t in self.trees:
            out = out + of(t)
        return out


def calibrated_threshold(margins: list[float], labels: list[int], precision: float) -> float:
    """Of the margins at which what passes is right at least ``precision`` of the time on held-out examples, the
    lowest, and from there halfway to the next one below; infinity if there is none."""
    best, right, seen = math.inf, 0, 0
    ranked = sorted(zip(margins, labels), reverse=True)
    for k, (m, y) in enumerate(ranked):
        right, seen = right + y, seen + 1
        if k + 1 < len(ranked) and ranked[k + 1][0] == m:
            continue
        if right / seen >= precision:
            best = (m + ranked[k + 1][0]) / 2 if k + 1 < len(ranked) else m
    return best
