"""What the two classifiers share: their training rows, boosted trees, isotonic steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import TRAIN_REMAINDERS, remainder


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y, fold 0 or 1) of at most ``most`` labelled ids, in hash order of the id.

    Only ids whose crc32 mod 5 is not 0 take part. An id labelled twice has its larger label, and
    of several documents of one id the smallest text is taken; unlabelled and null ids have none.
    """
    named = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & remainder(F.col("doc_id")).isin(*TRAIN_REMAINDERS))
    few = named.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).withColumn("fold", (remainder(F.col("doc_id")) % 2).cast("int"))


class Trees:
    """Gradient-boosted regression trees for log odds, over quantile bins of dense features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 4):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1) if n else np.zeros((0, d), int)
        rate = np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4)
        self.bias, self.trees = float(np.log(rate / (1 - rate))), []
        f = np.full(n, self.bias)
        for _ in range(self.rounds if n and 0 < y.sum() < n else 0):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, int)  # heap order
            tree = np.full((2 ** (self.depth + 1) - 1, 3), -1.0)  # feature, bin, value
            for level in range(self.depth + 1):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(node == k)
                    if not len(own):
                        continue
                    sg, sh = g[own].sum(), h[own].sum()
                    tree[k] = (-1, 0, self.rate * sg / (sh + self.ridge))
                    if level == self.depth or len(own) < 2 * self.least:
                        continue
                    top, at = sg**2 / (sh + self.ridge) + 1e-6, None
                    for j in range(d):
                        width = len(self.cuts[j]) + 1
                        if width < 2:
                            continue
                        b = binned[own, j]
                        lg, lh, ln = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[own], h[own], np.ones(len(own))))
                        gain = np.where((ln >= self.least) & (len(own) - ln >= self.least), lg**2 / (lh + self.ridge) + (sg - lg) ** 2 / (sh - lh + self.ridge), -1)
                        if gain.max() > top:
                            top, at = gain.max(), (j, int(gain.argmax()))
                    if at:
                        tree[k, 0], tree[k, 1] = at
                        node[own] = 2 * k + 1 + (binned[own, at[0]] > at[1])
            f += tree[node, 2]
            self.trees.append(tree)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        f = np.full(len(x), self.bias)
        if not len(x):
            return f
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        rows = np.arange(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = tree[node, 0].astype(int)
                down = np.where(binned[rows, np.maximum(j, 0)] > tree[node, 1], 2, 1) + 2 * node
                node = np.where(j >= 0, down, node)
            f += tree[node, 2]
        return f


class Isotonic:
    """Least-squares rising steps (pool adjacent violators), read by linear interpolation."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, sum of x
        for v, t in zip(x[order], y[order]):
            blocks.append([float(t), 1.0, float(v)])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, s = blocks.pop()
                a = blocks[-1]
                blocks[-1] = [(a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, a[2] + s]
        self.x = np.array([b[2] / b[1] for b in blocks]) if blocks else np.zeros(1)
        self.y = np.array([b[0] for b in blocks]) if blocks else np.zeros(1)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A thousandth of the logistic keeps the order within a step."""
        return np.clip(0.999 * np.interp(x, self.x, self.y) + 0.001 / (1 + np.exp(-np.clip(x, -30, 30))), 0, 1)
