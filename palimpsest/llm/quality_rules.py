"""Quality rules: a learned decision list over text statistics.

Sequential covering: rules are conjunctions of thresholds that cover rejected
documents.  Each is grown on two thirds of the labelled sample by the best gain
in information, pruned from its end on the other third, kept if it is precise
on all labelled rows that are left, and what it covers is taken out before the
next one is grown.  The list
is emitted as one ordered conditional expression, so scoring is JVM code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .textstats import base_stats, labelled_ratios, ratios

#: Labelled documents per class that the list is learned from, at most.
SAMPLE = 6000
MAX_RULES, MAX_CONDITIONS, MIN_COVERED, MIN_PRECISION, CUTS = 16, 4, 5, 0.97, 24


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    cut: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.feature] > self.cut) == self.above


def _covers(rule, x):
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Conditions added one by one while they gain information about ``bad``."""
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < MAX_CONDITIONS:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if p == 0 or n == 0:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        xs, ys = x[inside], bad[inside]
        for f in range(x.shape[1]):
            values = np.unique(xs[:, f])
            mids = (values[1:] + values[:-1]) / 2
            cuts = mids if len(mids) <= CUTS else np.unique(np.concatenate([np.quantile(mids, np.linspace(0, 1, CUTS)), np.quantile(xs[ys, f], np.linspace(0, 1, CUTS))]))
            for cut in cuts:
                over = xs[:, f] > cut
                for above in (True, False):
                    hit = over if above else ~over
                    got, lost = int(ys[hit].sum()), int((~ys[hit]).sum())
                    if got >= MIN_COVERED and lost < n:
                        gain = got * (np.log2(got / (got + lost)) - base)
                        if gain > best[0]:
                            best = (gain, Condition(f, above, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def _prune(rule, x, bad):
    """The prefix of ``rule`` that is worth most on rows it was not grown on."""

    def worth(r):
        hit = _covers(r, x)
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        return (p - n) / (p + n + 1)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(x: np.ndarray, bad: np.ndarray) -> list[list[Condition]]:
    """Ordered rejecting rules; none if there is nothing to learn from."""
    if not len(x) or not bad.any() or bad.all():
        return []
    prune = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), dtype=bool), []
    while len(rules) < MAX_RULES and bad[left].sum() >= MIN_COVERED:
        rule = _grow(x[left & ~prune], bad[left & ~prune])
        if not rule:
            break
        if (left & prune).any():
            rule = _prune(rule, x[left & prune], bad[left & prune])
        hit = _covers(rule, x) & left
        if hit.sum() < MIN_COVERED or bad[hit].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules, names: list[str], values: dict[str, Column]) -> Column:
    """The number of the first rule that rejects, from 1; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        hit = F.lit(True)
        for c in rule:
            v = values[names[c.feature]]
            hit = hit & (v > c.cut if c.above else v <= c.cut)
        out = out.when(hit, F.lit(k))
    return out


def describe(rules, names) -> list[str]:
    return [" AND ".join(f"{names[c.feature]} {'>' if c.above else '<='} {c.cut:.6g}" for c in r) for r in rules]


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> tuple[list[str], list[list[Condition]]]:
    names, x, good = labelled_ratios(docs, labels, "quality", limit, held_out=False)
    return names, learn(x, good == 0)


def apply_rules(docs: DataFrame, labels: DataFrame, stats: str = "stats", rule: str = "rule") -> DataFrame:
    """``docs`` with a struct of statistics and the rule that rejects a row.

    ``rule`` is 0 for rows that the base thresholds reject (under ten words, or
    over a fifth of the words in repeated five-word windows), the number of the
    learned rule, or null for kept rows.  Null and empty texts have no words and
    fall to the base thresholds; very long ones are read whole.  Every row is
    judged by itself, so repeated rows get the same rule.  Without labels only
    the base thresholds apply; an empty table gives an empty one.
    """
    names, rules = fit(docs, labels)
    out = docs.withColumn(stats, base_stats(F.col("text")))
    s = F.col(stats)
    base = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    return out.withColumn(rule, F.when(base, F.lit(0)).otherwise(verdict(rules, names, ratios(s))))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    stats, rule = fresh(docs.columns, "stats", "rule")
    out = apply_rules(docs, labels, stats, rule).filter(F.col(rule).isNull())
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
