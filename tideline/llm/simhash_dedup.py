"""Operator 6: SimHash near-duplicates through covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority over the hashes of its word
shingles.  For a radius r, bit i gets a vector m(i) of r + 1 bits, and the mask
of a non-zero vector v keeps the bits i with <m(i), v> odd.  The m(i) of at
most r differing bits span at most r dimensions, so some v is orthogonal to
all of them and its mask drops every differing bit: each pair within the
radius collides in at least one of the 2^(r+1) - 1 tables.

Equal fingerprints are one node.  Fingerprints that share a bucket with
another one are linked without emitting a bucket's pairs: two fingerprints
differ in at most 2 bits exactly when some value lies within 1 bit of both.
Each candidate offers itself and its one-bit neighbours as such values; at most
65 fingerprints can meet at one value, and all that do are linked to the
smallest.  For other radii the values are all those within r // 2 bits, and
an odd radius adds an exact check of the links between values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import save, table, text_batches
from tideline.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
_BLOCK = 1 << 15  # shingle hashes counted at once
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash; zero for a null text or one without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _BLOCK):
        hashes = np.fromiter((digest(b" ".join(words[i:i + shingle]), SEED) for i in range(start, min(n, start + _BLOCK))),
                             dtype=np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a long that holds its 64 bits."""

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in t], dtype=np.uint64).view(np.int64))

    return run.asNondeterministic()(text.cast("string"))


def covering_masks(radius: int) -> list[int]:
    """One mask per non-zero vector of radius + 1 bits, as signed 64-bit values."""
    dims = radius + 1
    vectors = [1 + i % ((1 << dims) - 1) for i in range(BITS)]  # every non-zero vector about equally often
    masks = []
    for v in range(1, 1 << dims):
        mask = sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints(fp)`` distinct -> links ``(a, b)`` that connect every pair within ``radius`` bits.

    Only fingerprints that meet another one in a bucket of some covering table
    are looked at further.
    """
    if radius == 0:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where("false")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket"))
                       for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.bucket")
    # A bucket counts as shared when its smallest and largest members differ.
    shared = rows.groupBy("t", "bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    near = rows.join(shared.select("t", "bucket"), ["t", "bucket"], "left_semi").select("fp").distinct()
    reach = radius // 2
    flips = [_signed(sum(1 << i for i in c)) for k in range(reach + 1) for c in combinations(range(BITS), k)]
    around = near.select("fp", F.explode(F.array(*[F.lit(f) for f in flips])).alias("flip"))
    around = around.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    if radius % 2 == 0:
        w = Window.partitionBy("value")
        met = around.withColumn("least", F.min("fp").over(w))
        return met.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    # Odd radius: one of the two values is a further bit away.
    bits = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    further = around.select("fp", "value", F.explode(bits).alias("bit"))
    further = further.select(F.col("fp").alias("other"), F.col("value").bitwiseXOR(F.col("bit")).alias("value"))
    pairs = around.join(further, "value").where("fp < other").select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    component_id is the smallest doc_id whose fingerprint is reachable over
    links of at most ``radius`` bits, itself included; texts without words have
    fingerprint zero and are linked like any other.  Null ids keep their row
    and take part in links, but never name a component that has a non-null id.
    """
    text_batches(docs.sparkSession)
    rows = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text"), shingle).alias("fp")), "simhash")
    out = _with_least(rows, F.col("doc_id"), radius)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def _with_least(rows: DataFrame, value: Column, radius: int) -> DataFrame:
    """``rows`` (with ``fp``) and the smallest ``value`` of each row's component as ``least``."""
    nodes = rows.groupBy("fp").agg(F.min(value).alias("first"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius))
    grouped = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    by_print = grouped.select("fp", "root").join(least, "root").select(F.col("fp").alias("of"), "least")
    return rows.join(by_print, F.col("fp") == F.col("of")).drop("of")


def one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with exactly the first row of each group: by id, null ids last, then by the text's hash.

    Rows are told apart by id and text, so that a repeated id never takes a
    clean text along.  Of rows equal in both, the smallest by all columns stays.
    """
    text_batches(docs.sparkSession)
    key = [F.col("doc_id").cast("long").alias("key_id"), F.xxhash64(F.col("text").cast("string")).alias("version")]
    rows = save(docs.select(*key, fingerprints(F.col("text"), shingle).alias("fp")), "simhash")
    order = F.struct(F.isnull("key_id").alias("last"), F.col("key_id"), F.col("version"))
    placed = _with_least(rows, order, radius)
    stays = F.col("key_id").eqNullSafe(F.col("least.key_id")) & (F.col("version") == F.col("least.version"))
    keys = placed.groupBy("key_id", "version").agg(F.max(stays).alias("stays"), F.count("*").alias("times"))
    marked = save(keys.where("not stays or times > 1").select(
        F.col("key_id").alias("m_id"), F.col("version").alias("m_version"), "stays"), "simhash-marked")
    same = F.col("key_id").eqNullSafe(F.col("m_id")) & (F.col("version") == F.col("m_version"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    single = keyed.join(marked, same, "left_anti").select("row.*")
    repeated = keyed.join(marked.where("stays"), same, "left_semi")
    return single.union(repeated.groupBy("key_id", "version").agg(F.min("row").alias("row")).select("row.*"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
