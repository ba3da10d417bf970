"""Gradient-boosted trees on binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class BoostConfig:
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    ridge: float = 1.0
    least: float = 3.0  # sum of second derivatives that each side of a split needs at least


class BoostedTrees:
    """Second-order boosting for the logistic loss; every tree is a full one of fixed depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cfg: BoostConfig):
        self.cfg = cfg
        points = np.quantile(x, np.linspace(0, 1, cfg.bins + 1)[1:-1], axis=0)
        self.edges = [np.unique(points[:, f]) for f in range(x.shape[1])]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        binned, margin = self.binned(x), np.full(len(y), self.start)
        for _ in range(cfg.trees):
            p = sigmoid(margin)
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._leaf(binned, tree)

    def binned(self, x: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        return np.stack(columns, axis=1)

    def _grow(self, binned, grad, hess):
        cfg, (n, features) = self.cfg, binned.shape
        bins = cfg.bins + 1
        split_on = np.zeros(2**cfg.depth - 1, int)
        split_at = np.full(2**cfg.depth - 1, bins)  # a bin no row reaches: all go left
        node = np.zeros(n, int)
        for level in range(cfg.depth):
            nodes, first = 2**level, 2**level - 1
            cell = (node[:, None] * features + np.arange(features)) * bins + binned
            shape = (nodes, features, bins)
            size = nodes * features * bins
            g = np.bincount(cell.ravel(), np.repeat(grad, features), size).reshape(shape)
            h = np.bincount(cell.ravel(), np.repeat(hess, features), size).reshape(shape)
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + cfg.ridge) + right_g**2 / (right_h + cfg.ridge)
            gain -= all_g**2 / (all_h + cfg.ridge)
            gain[(left_h < cfg.least) | (right_h < cfg.least)] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(nodes), best] > 1e-9
            split_on[first : first + nodes] = np.where(good, best // bins, 0)
            split_at[first : first + nodes] = np.where(good, best % bins, bins)
            at = first + node
            node = 2 * node + (binned[np.arange(n), split_on[at]] > split_at[at])
        g = np.bincount(node, grad, 2**cfg.depth)
        h = np.bincount(node, hess, 2**cfg.depth)
        return split_on, split_at, -cfg.rate * g / (h + cfg.ridge)

    def _leaf(self, binned, tree):
        split_on, split_at, value = tree
        node = np.zeros(len(binned), int)
        rows = np.arange(len(binned))
        for level in range(self.cfg.depth):
            at = 2**level - 1 + node
            node = 2 * node + (binned[rows, split_on[at]] > split_at[at])
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self.binned(x)
        return self.start + sum((self._leaf(binned, t) for t in self.trees), np.zeros(len(x)))


class Isotonic:
    """Pool-adjacent-violators fit of labels on margins, linear between the pools' centres."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        order = np.argsort(margin, kind="stable")
        pools: list[list[float]] = []  # weight, sum of labels, sum of margins
        for m, label in zip(margin[order].tolist(), y[order].tolist()):
            pools.append([1.0, label, m])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last)]
        weight, ones, sums = np.array(pools).T
        self.at = sums / weight
        self.rate = (ones + 0.01) / (weight + 0.02)
        self.rate = np.maximum.accumulate(self.rate)

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        # A little of the raw probability keeps the order of margins within a pool.
        return 0.99 * np.interp(margin, self.at, self.rate) + 0.01 * sigmoid(margin)
