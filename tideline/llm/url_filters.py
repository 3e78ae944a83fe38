"""Operator 8: URL filters held in Bloom filter cascades.

Every url yields a few candidate keys (host suffix + path prefix).  The listed
keys go into level 1 of a cascade; those candidate keys of the whole corpus
that level 1 wrongly accepts go into level 2, the listed keys that level 2
accepts into level 3, and so on until a level accepts nothing wrongly.  Over
the complete key universe that the cascade was built on, membership is then
exact, and judging a url needs no join.

The list is a bounded parameter.  Level 1 is sized by the number of keys in the
corpus so that it wrongly accepts about as many keys as are listed, so the
whole cascade stays in proportion to the list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import table

ALLOW = ("org/", "com/fr/")
BLOCK = ("example.org/es/", "example.org/en/1", "com/de/")
MAX_LEVELS = 64


@dataclass(frozen=True)
class Bloom:
    """Bits set by double hashing of a key's two 64-bit hashes."""

    bits: np.ndarray
    hashes: int
    salt: int

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a = (h1.astype(np.uint64) + np.uint64(self.salt)) * np.uint64(0x9E3779B97F4A7C15)
        a ^= a >> np.uint64(31)
        i = np.arange(self.hashes, dtype=np.uint64)
        x = a[:, None] + i * (h2.astype(np.uint64) | np.uint64(1))[:, None]
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9)) % np.uint64(len(self.bits))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.bits[self.slots(h1, h2)].all(axis=1) if len(h1) else np.zeros(0, dtype=bool)

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, false_rate: float, salt: int) -> Bloom:
        rate = min(0.5, max(false_rate, 1e-9))
        size = max(64, math.ceil(len(h1) * math.log(1 / rate) / math.log(2) ** 2))
        b = cls(np.zeros(size, dtype=bool), max(1, round(math.log2(1 / rate))), salt)
        b.bits[b.slots(h1, h2)] = True
        return b


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Listed when the first level that rejects the key is an even one (counted from 1)."""
        listed = np.zeros(len(h1), dtype=bool)
        alive = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            ok = level.has(h1[alive], h2[alive])
            listed[alive[~ok]] = i % 2 == 1
            alive = alive[ok]
        listed[alive] = len(self.levels) % 2 == 1
        return listed


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path as the contract defines them; both empty for null or no ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Every host suffix joined with the path prefixes of the listed lengths, longest key first."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    prefixes = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in path_lengths])
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    ranked = F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k")))
    return F.when(host != "", F.transform(F.array_sort(ranked), lambda x: x["k"])).otherwise(F.array().cast("array<string>"))


def _hashes(keys: list[str], spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", *_hash_columns(F.col("k"))).collect() if keys else []
    by = {r["k"]: (r[1], r[2]) for r in rows}
    h = np.array([by[k] for k in keys], dtype=np.int64).reshape(-1, 2)
    return h[:, 0].copy(), h[:, 1].copy()


def _hash_columns(k: Column) -> tuple[Column, Column]:
    return F.xxhash64(k), F.xxhash64(F.lit(1), k)


def build_cascade(listed: list[str], universe: DataFrame, rows: int) -> Cascade:
    """Cascade over ``universe`` (column ``key``; ``rows`` of them, repeats included).

    Only keys that level 1 wrongly accepts leave the executors: about as many
    as are listed, by level 1's size.
    """
    spark = universe.sparkSession
    listed = sorted(set(listed))
    if not listed:
        return Cascade(())
    a1, a2 = _hashes(listed, spark)
    first = Bloom.of(a1, a2, len(listed) / max(rows, 2 * len(listed)), salt=1)

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(first.has(h1.to_numpy(dtype=np.int64), h2.to_numpy(dtype=np.int64)))

    wrong = universe.where(passes(*_hash_columns(F.col("key")))).distinct()
    wrong = sorted(k for (k,) in wrong.join(F.broadcast(spark.createDataFrame([(k,) for k in listed], "key string")),
                                            "key", "left_anti").collect())
    levels, inside, outside = [first], (a1, a2), _hashes(wrong, spark)
    while len(outside[0]):
        if len(levels) == MAX_LEVELS:
            raise ValueError("a listed and an unlisted key share both hashes")
        levels.append(Bloom.of(*outside, 0.5, salt=len(levels) + 1))
        ok = levels[-1].has(*inside)
        inside, outside = outside, (inside[0][ok], inside[1][ok])
    return Cascade(tuple(levels))


def judge_urls(pages: DataFrame, allow: tuple[str, ...] = ALLOW, block: tuple[str, ...] = BLOCK) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The longest listed key among a url's candidates is its rule, and its list
    the verdict; equally long ones go by the key's text, and a key on both
    lists is allowed.  A url that no rule fits, an empty host included, is on
    no list: verdict ``allow``.  Null ids and repeated rows pass through.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(k) - k.index("/") for k in (*allow, *block)})
    keyed = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    size = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    allowed, blocked = (build_cascade(list(k), universe, size) for k in (allow, block))

    @F.pandas_udf("rule int, allowed boolean")
    def first_listed(both: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h1, h2 in both:
            sizes = np.array([len(x) for x in h1], dtype=np.int64)
            a = np.concatenate([np.asarray(x, dtype=np.int64) for x in h1] or [np.zeros(0, np.int64)])
            b = np.concatenate([np.asarray(x, dtype=np.int64) for x in h2] or [np.zeros(0, np.int64)])
            yes, no = allowed.has(a, b), blocked.has(a, b)
            at = np.flatnonzero(yes | no)
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            rows_hit, pick = np.unique(row, return_index=True)  # the first listed key of each row
            rule, ok = np.full(len(sizes), -1, dtype=np.int32), np.ones(len(sizes), dtype=bool)
            rule[rows_hit] = at[pick] - (np.cumsum(sizes) - sizes)[rows_hit]
            ok[rows_hit] = yes[at[pick]]
            yield pd.DataFrame({"rule": rule, "allowed": ok})

    h1 = F.transform("keys", lambda k: F.xxhash64(k))
    h2 = F.transform("keys", lambda k: F.xxhash64(F.lit(1), k))
    judged = keyed.withColumn("j", first_listed.asNondeterministic()(h1, h2))
    rule = F.when(F.col("j.rule") >= 0, F.element_at("keys", F.col("j.rule") + 1))
    return judged.select("page_id", "host", "path", rule.alias("rule"),
                         F.when(F.col("j.allowed"), "allow").otherwise("block").alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
