"""Operator 5: quality rules with an isolation forest over rule statistics.

Two fixed rules decide first (too few words, too many repeated ones).  For all
other texts an isolation forest gives an anomaly score from path lengths over
random splits; each tree draws its rows from the whole corpus by a hash rank of
its own.  Splits fall more often on features that tell the labelled classes
apart.  The score above which a text goes is calibrated on both classes of all
labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import delete, save, table, text_batches
from tideline.llm.stats import FEATURES, document_stats, sample_share_of, stats_of

TREES, TREE_ROWS = 200, 256
MAX_LOSS = 0.004  # share of labelled good texts that calibration may give up
SCORE_BINS = 1 << 14  # of the score histogram; a power of two, so a bin's edge is exact
_RANKS = 1 << 40
LEAST_WEIGHT = 0.05  # of a feature that does not tell the labelled classes apart
#: Length is not a fault by itself, so the forest sees the length-free ratios.
FOREST_FEATURES = tuple(f for f in FEATURES if f not in ("log_words", "line_words"))


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n keys."""
    n = np.asarray(n, dtype=np.float64)
    m = np.maximum(n, 2.0)
    return np.where(n > 1, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, 0.0)


def draw_weights(means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """How often a split falls on each feature, from the (bad, good) class means and variances.

    d / (1 + d) for a class difference of d standard deviations, over a floor:
    no feature is left out, as a new kind of fault may show in any of them.
    """
    apart = np.abs(means[0] - means[1]) / np.sqrt((variances[0] + variances[1]) / 2 + 1e-12)
    return np.round(LEAST_WEIGHT + apart / (1 + apart), 2)


@dataclass(frozen=True)
class Forest:
    """Per tree, node arrays: split feature (-1: leaf), cut, children, path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    depth: int
    norm: np.ndarray  # expected path of each tree

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path): near 1 for anomalies, below 0.5 for the bulk."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[t][node]
                inner = f >= 0
                if not inner.any():
                    break
                above = x[rows, np.maximum(f, 0)] > self.cut[t][node]
                node = np.where(inner, np.where(above, self.right[t][node], self.left[t][node]), node)
            total += self.length[t][node] / self.norm[t]
        return np.exp2(-total / max(len(self.feature), 1))


def grow_forest(samples: list[np.ndarray], seed: int = 5, weights: np.ndarray | None = None) -> Forest | None:
    """One tree a sample that has rows; ``weights`` of the features' draw, equal ones by default.

    None without rows: then nothing is an anomaly.
    """
    samples = [x for x in samples if len(x)]
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    trees, take = len(samples), max(map(len, samples))
    weights = np.ones(samples[0].shape[1]) if weights is None else weights
    depth = max(1, int(np.ceil(np.log2(max(take, 2)))))
    size = 2 ** (depth + 1)
    feature = np.full((trees, size), -1, dtype=np.int64)
    cut, length = np.zeros((trees, size)), np.zeros((trees, size))
    left, right = np.zeros((trees, size), dtype=np.int64), np.zeros((trees, size), dtype=np.int64)
    for t, x in enumerate(samples):
        todo, used = [(0, np.arange(len(x)), 0)], 1
        while todo:
            node, own, d = todo.pop()
            spread = np.flatnonzero(x[own].max(axis=0) > x[own].min(axis=0)) if d < depth and len(own) > 1 else ()
            if not len(spread):
                length[t, node] = d + _average_path(len(own))
                continue
            f = int(rng.choice(spread, p=weights[spread] / weights[spread].sum()))
            lo, hi = x[own, f].min(), x[own, f].max()
            c = min(rng.uniform(lo, hi), np.nextafter(hi, lo))
            above = x[own, f] > c
            feature[t, node], cut[t, node], left[t, node], right[t, node] = f, c, used, used + 1
            todo += [(used, own[~above], d + 1), (used + 1, own[above], d + 1)]
            used += 2
    return Forest(feature, cut, left, right, length, depth,
                  np.array([max(_average_path(len(x)), 1.0) for x in samples]))


def calibrate(score: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS,
              count: np.ndarray | None = None) -> float:
    """The cut with the best F1 of the bad class among those that give up at most ``max_loss`` of the good rows.

    ``count`` says how many rows have a score; one each by default.  Rows above
    the cut go.  Of equally good cuts the middle one is taken.  Without labels
    of either kind nothing is removed (threshold 1).
    """
    if good.all() or not good.any():
        return 1.0
    count = np.ones(len(score), dtype=np.int64) if count is None else count
    cuts, at = np.unique(score, return_inverse=True)
    n_good, n_bad = count[good].sum(), count[~good].sum()
    lost = n_good - np.cumsum(np.bincount(at[good], count[good], minlength=len(cuts)))
    gone = n_bad - np.cumsum(np.bincount(at[~good], count[~good], minlength=len(cuts)))
    f1 = np.where(lost <= max_loss * n_good, 2 * gone / (gone + lost + n_bad), 0.0)
    if f1.max() <= 0:
        return 1.0
    best = np.flatnonzero(f1 == f1.max())
    return float(cuts[best[len(best) // 2]])


@dataclass(frozen=True)
class QualityRules:
    forest: Forest | None
    threshold: float


def _forest_udf(forest: Forest | None):
    @F.pandas_udf("double")
    def anomaly(cols: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for c in cols:
            x = np.column_stack([s.to_numpy(dtype=np.float64) for s in c])
            yield pd.Series(forest.score(x) if forest is not None else np.zeros(len(x)))

    return anomaly


def keyed_stats(docs: DataFrame) -> DataFrame:
    """The statistics of every row of ``docs``, with a hash of id and text that ranks it."""
    text_batches(docs.sparkSession)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row_hash"), stats_of(text).alias("stats"))
    return rows.select("doc_id", "row_hash", "stats.*")


def tree_samples(stats: DataFrame, trees: int = TREES, rows: int = TREE_ROWS) -> list[np.ndarray]:
    """For each tree the features of the ``rows`` texts first in its own hash order of the whole corpus.

    About half as many again are offered to each tree, whatever the corpus, and
    the first ``rows`` of them taken.  Rows of one id and text have one rank, so a
    tree can get fewer where most of the corpus is one such row.
    """
    stats = stats.where("n_words > 0")
    n = stats.count()
    least = int(_RANKS * min(1.0, 1.5 * rows / max(n, 1)))
    ranked = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)),
                         lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64(t, "row_hash"), F.lit(_RANKS)).alias("rank")))
    offers = F.filter(ranked, lambda o: o["rank"] < least) if least < _RANKS else ranked
    offered = stats.select("row_hash", *FOREST_FEATURES, offers.alias("offers")).where(F.size("offers") > 0)
    first = [F.first(c).alias(c) for c in (*FOREST_FEATURES, "offers")]
    got = sorted(offered.groupBy("row_hash").agg(F.count("*").alias("times"), *first).collect())
    x = np.array([[r[f] for f in FOREST_FEATURES] for r in got], dtype=np.float64).reshape(-1, len(FOREST_FEATURES))
    order: list[list[tuple[int, int]]] = [[] for _ in range(trees)]
    for i, r in enumerate(got):
        for o in r["offers"]:
            order[o["tree"]].append((o["rank"], i))
    times = np.array([min(r["times"], rows) for r in got], dtype=np.int64)
    picks = [np.array([i for _, i in sorted(o)], dtype=np.int64) for o in order]
    return [x[np.repeat(p, times[p])[:rows]] for p in picks]


def labelled_stats(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every labelled row that passes the base rules, with the label ``y``.

    Null ids, null labels and ids with contradicting labels are left out.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    lab = lab.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y_max")).where("y = y_max").drop("y_max")
    return stats.where(~base_failed()).select("doc_id", *FOREST_FEATURES).join(lab, "doc_id")


def fit_stats(stats: DataFrame, labels: DataFrame, fit_rows: int | None = None,
              max_labels: int | None = None) -> QualityRules:
    """Forest and threshold from the :func:`keyed_stats`, which are read several times."""
    if max_labels is not None:
        share = sample_share_of(labels, max_labels)
        labels = labels.where(share(F.col("doc_id").cast("long")))
    known = labelled_stats(stats, labels)
    moments = [f(c) for f in (F.avg, F.var_pop) for c in FOREST_FEATURES]
    by = {r["y"]: np.array(r[1:], dtype=np.float64).reshape(2, -1) for r in known.groupBy("y").agg(*moments).collect()}
    weights = draw_weights(*np.stack([by[0], by[1]], axis=1)) if len(by) == 2 else None
    if fit_rows is not None:
        share = sample_share_of(stats, fit_rows)
        stats = stats.where(share(F.col("row_hash")))
    forest = grow_forest(tree_samples(stats), weights=weights)
    if forest is None or len(by) < 2:
        return QualityRules(forest, 1.0)
    level = F.ceil(_forest_udf(forest)(*FOREST_FEATURES) * SCORE_BINS).alias("level")
    found = known.select("y", level).groupBy("y", "level").count().collect()  # at most two rows a bin
    y, level, count = np.array(found, dtype=np.int64).T
    return QualityRules(forest, calibrate(level / SCORE_BINS, y == 1, count=count))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int | None = None, max_labels: int | None = None) -> QualityRules:
    """:func:`fit_stats` on all rows; ``fit_rows`` and ``max_labels`` bound the forest's rows and the labels of a trial."""
    stats = save(keyed_stats(docs), "quality-stats")
    rules = fit_stats(stats, labels, fit_rows, max_labels)
    delete(stats)
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge_stats(stats: DataFrame, rules: QualityRules) -> DataFrame:
    """``stats`` with base_failed, anomaly score and kept."""
    scored = stats.withColumn("base_failed", base_failed()).withColumn("anomaly", _forest_udf(rules.forest)(*FOREST_FEATURES))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(rules.threshold)))


def judge(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, anomaly score and kept.

    Null and empty texts have no words and fail the base rules; ids may be
    null or repeated.  One pass over the texts, no shuffle.
    """
    return judge_stats(document_stats(docs), rules)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts are read once; their statistics go to the shared folder."""
    stats = save(keyed_stats(table(spark, sf_dir, "documents")), "quality-stats")
    out = judge_stats(stats, fit_stats(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "anomaly")
