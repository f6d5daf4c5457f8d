"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are boosted on a bounded sample of labelled documents; every
path from a root becomes a conjunctive rule.  A lasso logistic regression over
the rules' truth values keeps few of them, and the weighted rules are compiled
into one Spark expression of comparisons: scoring is JVM code.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out
from .quality_rules import Condition, _covers
from .textstats import base_stats, labelled_ratios, ratios

#: Labelled documents per class that the ensemble is fitted to, at most.
SAMPLE = 6000
TREES, DEPTH, CUTS, LEAST, RATE = 30, 3, 24, 8, 0.3
LASSO, STEPS = 0.002, 1500


def _cuts(column: np.ndarray) -> np.ndarray:
    values = np.unique(column)
    mids = (values[1:] + values[:-1]) / 2
    return mids if len(mids) <= CUTS else np.unique(np.quantile(mids, np.linspace(0, 1, CUTS)))


def _tree(x, gradient, weight, rows, depth, path, paths, values):
    """Split ``rows`` by the best second-order gain; note every path."""
    if path:
        paths.append(list(path))
    g, h = gradient[rows].sum(), weight[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * LEAST:
        for f in range(x.shape[1]):
            column = x[rows, f]
            cuts = _cuts(column)
            if not len(cuts):
                continue
            at = np.searchsorted(cuts, column, side="left")  # cut c separates at <= c from at > c
            n = len(cuts) + 1
            gs, hs, ns = (np.cumsum(np.bincount(at, v, n))[:-1] for v in (gradient[rows], weight[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, float(cuts[k])))
    if best[1] is None:
        values[rows] = RATE * g / (h + 1)
        return
    f, cut = best[1]
    over = x[rows, f] > cut
    for above in (False, True):
        _tree(x, gradient, weight, rows[over == above], depth - 1, [*path, Condition(f, above, cut)], paths, values)


def boosted_paths(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[list[Condition]]:
    """The distinct paths of TREES boosted trees, in the order they appear."""
    score, found = np.zeros(len(x)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        paths, values = [], np.zeros(len(x))
        _tree(x, (y - p) * weight, p * (1 - p) * weight, np.arange(len(x)), DEPTH, [], paths, values)
        score += values
        for path in paths:
            found.setdefault(tuple(sorted(path, key=lambda c: (c.feature, c.above, c.cut))), path)
    return list(found.values())


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1 logistic regression, by accelerated proximal steps."""
    weight = weight / weight.sum()
    full = np.hstack([np.ones((len(z), 1)), z])
    beta, ahead, t = np.zeros(full.shape[1]), np.zeros(full.shape[1]), 1.0
    step = 4 / np.linalg.eigvalsh((full * weight[:, None]).T @ full)[-1]
    for _ in range(STEPS):
        grad = full.T @ (weight * (1 / (1 + np.exp(-full @ ahead)) - y))
        new = ahead - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * LASSO, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, beta, t = new + (t - 1) / t_new * (new - beta), new, t_new
    return float(beta[0]), beta[1:]


class RuleEnsemble:
    """Weighted conjunctions; ``score`` gives the expression of their logistic sum."""

    def __init__(self, names: list[str], bias: float, rules: list[tuple[float, list[Condition]]]):
        self.names, self.bias, self.rules = names, bias, rules

    @classmethod
    def fit(cls, names, x, y) -> "RuleEnsemble":
        """Without rows of both classes, or with too few to split, the score is the share of label 1, or one half."""
        weight = np.ones(len(x))
        paths = boosted_paths(x, y, weight) if len(x) and y.min() != y.max() else []
        if not paths:
            share = float(np.clip(y.mean() if len(x) else 0.5, 0.01, 0.99))
            return cls(names, float(np.log(share / (1 - share))), [])
        z = np.column_stack([_covers(p, x) for p in paths]).astype(float)
        bias, beta = lasso(z, y.astype(float), weight)
        return cls(names, bias, [(float(b), p) for b, p in zip(beta, paths, strict=True) if abs(b) > 1e-6])

    def score(self, values: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            hit = F.lit(True)
            for c in rule:
                v = values[self.names[c.feature]]
                hit = hit & (v > c.cut if c.above else v <= c.cut)
            total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, rule in self.rules:
            total += weight * _covers(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> RuleEnsemble:
    """Only labels that are not held out are learned from; inputs are text statistics alone."""
    return RuleEnsemble.fit(*labelled_ratios(docs, labels, "quality", limit, held_out=True))


def score_quality(docs: DataFrame, labels: DataFrame, model: RuleEnsemble | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null texts score as empty ones.

    Very long texts are read whole.  Rows that repeat a doc_id each keep their
    row, and equal texts get equal scores.  An empty table gives an empty one.
    """
    model = model or fit(docs, labels)
    named = ratios(F.col("s"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_stats(F.col("text")).alias("s"))
    rows = rows.select("doc_id", F.struct(*[v.alias(k) for k, v in named.items()]).alias("x"))
    rows = rows.select("doc_id", model.score({k: F.col(f"x.{k}") for k in named}).alias("score"))
    return rows.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
