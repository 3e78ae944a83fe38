"""Operator 13: ranked lexical search by hashed max-sketches.

An index pass over the documents folds each one's term counts into ``ROWS``
hashed rows of coordinatewise maxima (an impact grows with the count, so the
maximum of counts is the maximum of impacts), and counts, per task, in how many
documents each term occurs.  A term's count is at most the least of its
coordinates, so for a batch of queries the looked-up impacts times the terms'
weights, summed, bound every score from above.

The documents of highest bound are scored exactly on their whole texts.  The
``k``-th best exact score is a threshold no later result can fall below: all
documents whose bound reaches it are scored exactly as well, and the rest are
out for certain.  Queries run in blocks of ``QUERY_BLOCK`` items.

Equal texts score alike: a text is scored once for all its copies and expanded
to its ``k`` smallest ids.

Null texts have no terms.  An item without terms gives no rows; items that share
an id and a text are one item, those that share an id only are answered
separately under it.  Rows that share a doc_id are documents of their own; a
null id ranks after all others.  Other columns are ignored.  Empty tables give
an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import delete, save, table

TOP = 20
ROWS = 3             # hashed rows of a sketch
SPARSE = 2           # coordinates of a row for each distinct term, at least
FIRST = 64           # documents scored for each item before the threshold is known
QUERY_BLOCK = 512    # items bounded in one pass
DF_TERMS = 1 << 18   # terms a task counts before it hands its counts on
DOC_BLOCK = 64       # documents whose bounds are computed at once

#: Upper ends of the count classes that a coordinate's four bits name; a text of 2^31 bytes has at most 2^30 terms.
LEVELS = np.array([0, 1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, 1 << 30], dtype=np.int64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_SKETCHES = "doc_id long, digest binary, n long, sketch binary, term binary, df long"


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters; only A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def coordinates(keys: np.ndarray, width: int) -> np.ndarray:
    """Coordinate of each key in each row."""
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64)[None, :] * _MIX[:ROWS, None]) >> np.uint64(40) & np.uint64(width - 1)).astype(np.int64)


def fold(counts: dict[bytes, int]) -> bytes:
    """Sketch of a document: ROWS rows of four-bit classes, a power of two wide."""
    width = max(64, 1 << (SPARSE * len(counts) - 1).bit_length())
    keys = np.fromiter((crc32(t) for t in counts), dtype=np.uint64, count=len(counts))
    level = np.searchsorted(LEVELS, np.fromiter(counts.values(), dtype=np.int64, count=len(counts))).astype(np.uint8)
    out = np.zeros((ROWS, width), dtype=np.uint8)
    for row, at in zip(out, coordinates(keys, width), strict=True):
        np.maximum.at(row, at, level)
    return (out[:, ::2] << 4 | out[:, 1::2]).tobytes()


def unfold(sketches: list[bytes], width: int) -> np.ndarray:
    """Classes of equally wide sketches: documents x ROWS x width."""
    packed = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(sketches), ROWS, width // 2)
    out = np.empty((len(sketches), ROWS, width), dtype=np.uint8)
    out[:, :, ::2], out[:, :, 1::2] = packed >> 4, packed & 15
    return out


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def digest(text: Column) -> Column:
    """Names a text: equal texts, and for all purposes only those, share it."""
    return F.unhex(F.sha2(text.cast("string"), 256))


def _index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df: Counter[bytes] = Counter()

    def counted() -> pa.RecordBatch:
        n = len(df)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
             pa.array(df.keys(), pa.binary()), pa.array(df.values(), pa.int64())], names=names)

    names = ["doc_id", "digest", "n", "sketch", "term", "df"]
    for batch in batches:
        ns, sketches = [], []
        for text in batch.column("text"):
            terms = terms_of(text.as_py())
            counts = Counter(terms)
            df.update(counts.keys())
            ns.append(len(terms))
            sketches.append(fold(counts) if counts else None)
        n = len(ns)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(ns, pa.int64()), pa.array(sketches, pa.binary()),
             pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names=names)
        if len(df) > DF_TERMS:
            yield counted()
            df.clear()
    if df:
        yield counted()


@dataclass
class Index:
    rows: DataFrame  # sketches of documents, and partial document counts of terms
    docs: int        # documents with a term
    length: int      # terms of all documents

    @property
    def sketches(self) -> DataFrame:
        return self.rows.where("n > 0").select("doc_id", "digest", "n", "sketch")

    def frequencies(self, terms: DataFrame) -> DataFrame:
        """term and df of the given distinct ``terms`` that occur."""
        return self.rows.where("term is not null").join(terms, "term").groupBy("term").agg(F.sum("df").alias("df"))


def build_index(docs: DataFrame) -> Index:
    """One pass over all texts; the result lies in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"),
                       F.col("text").cast("string").cast("binary").alias("text"))
    rows = save(rows.mapInArrow(_index_task, _SKETCHES), "sketches")
    n, length = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    return Index(rows, n, length or 0)


@dataclass
class Batch:
    """A block of queries: their postings, sorted by query; weights include repeats in the query."""

    terms: list[bytes]     # distinct terms of the block
    at: np.ndarray         # posting -> term
    weight: np.ndarray     # posting -> weight times repeats
    start: np.ndarray      # query -> its first posting
    docs: int
    length: int

    def damping(self, n: np.ndarray) -> np.ndarray:
        return 100 - 25 + 25 * n * self.docs // self.length

    def summed(self, impacts: np.ndarray) -> np.ndarray:
        """documents x terms impacts -> documents x queries scores."""
        return np.add.reduceat(impacts[:, self.at] * self.weight, self.start, axis=1)

    def bounds(self, sketches: list[bytes], n: np.ndarray) -> np.ndarray:
        """Upper bound of each document's score for each query."""
        out = np.empty((len(sketches), len(self.start)), dtype=np.int64)
        sizes = np.array([len(s) for s in sketches])
        keys = np.array([crc32(t) for t in self.terms], dtype=np.uint64)
        for size in np.unique(sizes):
            own, width = np.flatnonzero(sizes == size), int(size) * 2 // ROWS
            at = coordinates(keys, width)
            for i in range(0, len(own), DOC_BLOCK):
                part = own[i:i + DOC_BLOCK]
                rows = unfold([sketches[j] for j in part], width)
                level = rows[:, 0, at[0]]
                for r in range(1, ROWS):
                    np.minimum(level, rows[:, r, at[r]], out=level)
                by_level = impact(LEVELS[None, :], self.damping(n[part])[:, None])
                out[part] = self.summed(np.take_along_axis(by_level, level.astype(np.int64), axis=1))
        return out

    def scores(self, text: bytes, queries: np.ndarray) -> np.ndarray:
        """Exact scores of one document for some queries."""
        terms = terms_of(text)
        counts = Counter(terms)
        tf = np.array([counts.get(t, 0) for t in self.terms], dtype=np.int64)
        return self.summed(impact(tf, self.damping(np.array(len(terms))))[None, :])[0, queries]


def _batch(index: Index, items: list[list[bytes]], spark: SparkSession) -> Batch:
    counts = [Counter(i) for i in items]
    terms = sorted(set().union(*counts))
    df = {bytes(r["term"]): r["df"] for r in index.frequencies(spark.createDataFrame([(t,) for t in terms], "term binary")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.docs + 2) / (2 * df.get(t, 0) + 1))) for t in terms}
    place = {t: i for i, t in enumerate(terms)}
    at = np.array([place[t] for c in counts for t in c], dtype=np.int64)
    weights = np.array([weight[t] * k for c in counts for t, k in c.items()], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum([len(c) for c in counts])[:-1]]).astype(np.int64)
    return Batch(terms, at, weights, start, index.docs, index.length)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], np.ndarray]]:
    """Digest, sketch and n of documents, equal texts of a batch once."""
    for b in batches:
        digests = b.column("digest").to_pylist()
        once = list({d: i for i, d in enumerate(digests)}.values())
        yield [digests[i] for i in once], b.column("sketch").take(pa.array(once, pa.int64())).to_pylist(), b.column("n").to_numpy(zero_copy_only=False)[once]


_FOUND = "query int, digest binary, bound long"


def _found(query: np.ndarray, digests: list, bound: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(digests, pa.binary()), pa.array(bound, pa.int64())],
                                      names=["query", "digest", "bound"])


def highest(index: Index, batch: Batch, first: int) -> DataFrame:
    """The ``first`` texts of highest bound for each query."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[bytes, int]] = [{} for _ in batch.start]
        for digests, sketches, n in _bounded(batches):
            bounds = batch.bounds(sketches, n)
            for q, own in enumerate(best):
                top = np.argpartition(-bounds[:, q], first - 1)[:first] if len(bounds) > first else np.arange(len(bounds))
                own.update((digests[i], int(bounds[i, q])) for i in top if bounds[i, q] > 0)
                if len(own) > 2 * first:
                    best[q] = dict(sorted(own.items(), key=lambda x: -x[1])[:first])
        for q, own in enumerate(best):
            top = sorted(own.items(), key=lambda x: (-x[1], x[0]))[:first]
            if top:
                yield _found(np.full(len(top), q), [d for d, _ in top], np.array([b for _, b in top]))

    found = index.sketches.select("digest", "n", "sketch").mapInArrow(task, _FOUND).distinct()
    w = Window.partitionBy("query").orderBy(F.desc("bound"), "digest")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first).select("query", "digest")


def reaching(index: Index, batch: Batch, threshold: np.ndarray) -> DataFrame:
    """All texts whose bound reaches the query's threshold."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, sketches, n in _bounded(batches):
            bounds = batch.bounds(sketches, n)
            doc, query = np.nonzero(bounds >= threshold)
            yield _found(query, [digests[i] for i in doc], bounds[doc, query])

    found = index.sketches.select("digest", "n", "sketch").mapInArrow(task, _FOUND)
    return found.select("query", "digest").distinct()


def rescored(docs: DataFrame, batch: Batch, found: DataFrame) -> DataFrame:
    """query, digest and exact score of each found pair, from the whole texts."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text, queries in zip(b.column("digest"), b.column("text"), b.column("queries"), strict=True):
                queries = np.array(sorted(queries.as_py()), dtype=np.int64)
                score = batch.scores(text.as_py(), queries)
                yield _found(queries, [name.as_py()] * len(queries), score)

    asked = found.groupBy("digest").agg(F.collect_list("query").alias("queries"))  # at most a block's queries
    texts = docs.select(digest(F.col("text")).alias("digest"), F.col("text").cast("string").cast("binary").alias("text"))
    texts = texts.join(asked.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    return texts.join(asked, "digest").mapInArrow(task, _FOUND).withColumnRenamed("bound", "score")


def _thresholds(scores: DataFrame, queries: int, k: int) -> np.ndarray:
    """The k-th best score of each query, 1 where there are fewer."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), "digest")
    out = np.ones(queries, dtype=np.int64)
    for q, score in scores.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query", "score").collect():
        out[q] = max(1, score)
    return out


def search(docs: DataFrame, index: Index, items: DataFrame, k: int = TOP, first: int = FIRST, query_block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    asked = asked.where("text is not null").distinct()
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    parts = [p for b in range(blocks) if (p := _search_block(docs, index, asked.where(F.col("block") == b), k, first)) is not None]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search_block(docs: DataFrame, index: Index, items: DataFrame, k: int, first: int) -> DataFrame | None:
    spark = docs.sparkSession
    rows = [(r["item_id"], t) for r in items.collect() if (t := terms_of(bytes(r["text"])))]  # at most about query_block rows
    if not rows or not index.docs:
        return None
    batch = _batch(index, [t for _, t in rows], spark)
    tried = save(highest(index, batch, first), "lexical-first")
    scored = save(rescored(docs, batch, tried), "lexical-scores")
    threshold = _thresholds(scored, len(rows), k)
    rest = save(reaching(index, batch, threshold).join(tried, ["query", "digest"], "left_anti"), "lexical-rest")
    scored_rest = save(rescored(docs, batch, rest), "lexical-scores")
    scores = scored.unionByName(scored_rest)

    final = spark.createDataFrame(list(enumerate(_thresholds(scores, len(rows), k).tolist())), "query int, least long")
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(rows)], "query int, item_id long")
    best = scores.join(final, "query").where("score >= least").select("query", "digest", "score")
    ids = index.sketches.select("doc_id", "digest").join(best.select("digest").distinct(), "digest", "left_semi")
    w = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last())
    ids = ids.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("digest", "doc_id")
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = best.join(ids, "digest").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = save(ranked.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical")
    for x in (tried, scored, rest, scored_rest):
        delete(x)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = build_index(docs)
    out = search(docs, index, table(spark, sf_dir, "benchmark"))
    delete(index.rows)
    return out
