"""Operator 4: packing with optimal length buckets.

Texts are cut into pieces of at most ``max_len`` words.  Dynamic programming
over the global histogram of piece lengths (at most ``max_len`` rows, whatever
the corpus) chooses the bucket boundaries that minimise padding.  Inside each
bucket, token-budget batches hold as many pieces as fit when all are padded to
the bucket's boundary.

Batches are formed inside slices of a bucket.  A slice is a hash range of pieces
(id, piece and length) holding about ``slice_rows`` pieces; every slice ends with
at most one batch that is not full.  Equal pieces are one counted row until their
batches are known, and are then dealt out in chunks.  So no task ranks a whole
bucket or writes all pieces of a null or repeated id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import save, table, word_count
from tideline.operators.skew import explode_range, repeat_rows

MAX_LEN = 2048
BUCKETS = 16
BUDGET = 16384
SLICE_ROWS = 8192


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (always existing lengths) of at most ``buckets`` buckets with least padding.

    Padding is boundary minus length, summed over pieces.  Ties go to fewer
    buckets, then to the smaller last cuts.
    """
    if not lengths:
        return []
    size = np.array(lengths, dtype=np.float64)
    n = np.concatenate([[0.0], np.cumsum(np.array(counts, dtype=np.float64))])
    total = np.concatenate([[0.0], np.cumsum(size * np.array(counts, dtype=np.float64))])
    m = len(lengths)
    cost = np.full(m + 1, np.inf)   # least padding of the first j lengths
    cost[0] = 0.0
    cuts: list[np.ndarray] = []
    for _ in range(min(buckets, m)):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        for j in range(1, m + 1):
            c = cost[:j] + size[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])
            cut[j] = int(np.argmin(c))
            new[j] = c[cut[j]]
        cuts.append(cut)
        cost = new
        if cost[m] == 0:
            break
        cost[0] = np.inf
    bounds, j = [], m
    for cut in reversed(cuts):
        bounds.append(int(lengths[j - 1]))
        j = int(cut[j])
    return bounds[::-1]


def pieces_of(docs: DataFrame, max_len: int) -> DataFrame:
    """doc_id, piece (from 0) and n_words of every piece; texts without words give none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("words"))
    rows = rows.where("words > 0")
    last = ((F.col("words") - 1) / max_len).cast("long")
    cut = rows.select("doc_id", "words", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(max_len), F.col("words") - F.col("piece") * max_len).alias("n_words"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET,
         slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, n_words, bucket (its boundary), slice, batch, padding.

    (bucket, slice, batch) names a batch; a batch has at most
    max(1, budget // bucket) rows.  Texts without a word are not packed.  Null
    ids share one slice order like any other id; repeated rows are packed as
    often as they occur (equal rows are interchangeable).  An empty table gives
    an empty result.
    """
    pieces = save(pieces_of(docs, max_len), "pieces")  # texts are read once
    histogram = pieces.groupBy("n_words").count().orderBy("n_words").collect()  # at most max_len rows
    lengths, counts = [r["n_words"] for r in histogram], [r["count"] for r in histogram]
    bounds = best_boundaries(lengths, counts, buckets)
    per = dict.fromkeys(bounds, 0)
    for length, count in zip(lengths, counts, strict=True):
        per[next(b for b in bounds if b >= length)] += count
    if not bounds:
        bounds, per = [max_len], {max_len: 0}
    bucket = F.lit(bounds[-1])
    slices = F.lit(max(1, -(-per[bounds[-1]] // slice_rows)))
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_words") <= b, F.lit(b)).otherwise(bucket)
        slices = F.when(F.col("n_words") <= b, F.lit(max(1, -(-per[b] // slice_rows)))).otherwise(slices)
    ident = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", "n_words")
    spread = F.conv(F.substring(F.md5(ident), 1, 8), 16, 10).cast("long")
    rows = pieces.withColumn("bucket", bucket.cast("long")).withColumn("slice", (spread % slices).cast("long"))
    # Equal rows are counted first, so a repeated id gives the window its distinct rows only.
    kinds = rows.groupBy("bucket", "slice", "doc_id", "piece", "n_words").agg(F.count("*").alias("times"))
    w = Window.partitionBy("bucket", "slice").orderBy("doc_id", "piece", "n_words")
    last = F.sum("times").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = kinds.withColumn("last", last).withColumn("fits", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket"))))
    # Equal pieces fill the batches from that of their first place to that of their last.
    first = F.col("last") - F.col("times")
    filled = explode_range(placed, F.floor(first / F.col("fits")), F.floor((F.col("last") - 1) / F.col("fits")), "batch")
    end = F.least(F.col("last"), (F.col("batch") + 1) * F.col("fits"))
    filled = filled.withColumn("copies", end - F.greatest(first, F.col("batch") * F.col("fits")))
    return repeat_rows(filled.select("doc_id", "piece", "n_words", "bucket", "slice", "batch",
                                     (F.col("bucket") - F.col("n_words")).alias("padding"), "copies"), "copies")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
