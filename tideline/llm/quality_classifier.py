"""Operator 9: quality classifier as a sparse rule ensemble.

Small boosted trees over text statistics propose conjunctive rules (every path
from a root to a node); a lasso logistic regression keeps few of them; the
kept rules are compiled into one Spark column expression.  Training sees a
bounded sample of labelled rows (``max_labels``); scoring sees every text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import is_held_out, table, text_batches
from tideline.llm.stats import FEATURES, document_stats, labelled_sample, stats_of

MAX_LABELS = 8000
ACCEPT = 0.3

Condition = tuple[int, bool, float]  # feature, above, threshold


@dataclass(frozen=True)
class RuleModel:
    """Logit = intercept + sum of the weights of the rules that hold."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as one Spark expression over the :data:`FEATURES` columns."""
        logit = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for f, above, cut in conditions:
                c = F.col(FEATURES[f])
                holds = holds & ((c > cut) if above else (c <= cut))
            logit = logit + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy, for training checks."""
        z = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            z += weight * rule_matrix(x, [conditions])[:, 0]
        return 1 / (1 + np.exp(-z))


def rule_matrix(x: np.ndarray, rules: list[tuple[Condition, ...]]) -> np.ndarray:
    out = np.ones((len(x), len(rules)), dtype=np.float64)
    for j, conditions in enumerate(rules):
        for f, above, cut in conditions:
            out[:, j] *= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        cuts.append(v[v < x[:, f].max()])
    return cuts


def _grow(x, grad, hess, cuts, rows, depth, path, out) -> None:
    """Greedy gradient tree; every node's path is a rule, leaves carry a value."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, None)
    if depth and len(rows) >= 20:
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = np.searchsorted(cut, x[rows, f], side="left")  # bin b: x <= cut[b]
            gl = np.cumsum(np.bincount(b, grad[rows], minlength=len(cut) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, hess[rows], minlength=len(cut) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, float(cut[k])))
    if best[1] is None:
        out.append((path, g / (h + 1), rows))
        return
    f, cut = best[1]
    above = x[rows, f] > cut
    for side in (False, True):
        sub = (*path, (f, side, cut))
        out.append((sub, None, None))
        _grow(x, grad, hess, cuts, rows[above == side], depth - 1, sub, out)


def propose_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3,
                  bins: int = 64, seed: int = 11) -> list[tuple[Condition, ...]]:
    """Distinct tree paths of a small boosted ensemble."""
    rng, z, cuts = np.random.default_rng(seed), np.zeros(len(y)), _cuts(x, bins)
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        nodes: list = []
        _grow(x, y - p, p * (1 - p), cuts, rows, depth, (), nodes)
        for path, value, _ in nodes:
            if path:
                rules[path] = None
            if value is not None:
                z += rate * value * rule_matrix(x, [path])[:, 0]
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    n, k = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    step = 4 * n / (np.linalg.norm(a, 2) ** 2 + 1e-9)
    w = np.zeros(k + 1)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleModel:
    """No labels: a constant 0.5; labels of one class: a constant near it."""
    if len(y) == 0:
        return RuleModel(0.0)
    prior = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return RuleModel(float(np.log(prior / (1 - prior))))
    rules = propose_rules(x, y)
    m = rule_matrix(x, rules)
    use = [j for j in range(m.shape[1]) if 0 < m[:, j].mean() < 1]
    if not use:
        return RuleModel(float(np.log(prior / (1 - prior))))
    scale = m[:, use].std(axis=0)
    b, w = lasso_logistic(m[:, use] / scale, y.astype(float), penalty)
    return RuleModel(b, [(rules[j], float(c / s)) for j, c, s in zip(use, w, scale, strict=True) if c])


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> RuleModel:
    """Fit on about ``max_labels`` labelled rows outside the hold-out."""
    sample = labelled_sample(docs, labels, "quality", max_labels, only=~is_held_out(F.col("doc_id")))
    stats = sample.select("y", stats_of(F.col("text")).alias("stats")).select("y", "stats.*")
    rows = stats.select("y", *FEATURES).collect()
    rows.sort()
    data = np.array([tuple(r) for r in rows], dtype=np.float64).reshape(-1, 1 + len(FEATURES))
    return fit_rules(data[:, 1:], data[:, 0])


def score_documents(docs: DataFrame, model: RuleModel, accept: float = ACCEPT) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of ``docs``.

    Null and empty texts are scored from their all-zero statistics.  One pass,
    no shuffle.
    """
    scored = document_stats(docs).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))


def accepted(docs: DataFrame, model: RuleModel, accept: float = ACCEPT) -> DataFrame:
    """``docs`` without the rejected texts; kept rows are unchanged. One pass, no shuffle."""
    text_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), stats_of(F.col("text")).alias("stats"))
    return rows.select("row", "stats.*").where(model.column() >= accept).select("row.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
