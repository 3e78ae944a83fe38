"""Joins of many rows per key onto one row per key, safe for hot keys.

Several operators join a records table (many rows per subject) to a table with
at most one row per subject: the merge (J1), per-subject values spread back to
rows (W3, P5), conversation summaries (X6), marker/bar checks (J5), reference
audits (X5).  A subject owning a third of all records must not be joined in
one task.

Spark's adaptive execution splits such a partition by map outputs at run time,
from measured sizes, but only where a shuffle lies directly under both join
inputs.  A one-row side that comes out of an aggregate is already partitioned
on the key and has none.  :func:`join_one_per_key` therefore joins on the key
and its hash: the aggregate's partitioning on the key alone does not serve
that pair (``spark.sql.requireAllClusterKeysForCoPartition``, on by default),
so Spark shuffles the one-row side once more, by (key, hash), and can split.

The plan is the same at every size and lazy: no job runs while it is built,
nothing is counted, collected, hinted or salted.  Rows with a NULL key all
have one hash and are split like any hot key.  The extra cost is one shuffle
of a table with one row per key; below the broadcast threshold there is no
join shuffle at all.  It needs ``spark.sql.adaptive.enabled`` and, where a
later aggregate would reuse the join's partitioning,
``spark.sql.adaptive.forceOptimizeSkewedJoin`` (both in
:data:`tideline.session.ENGINE_CONF`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join_one_per_key(
    many: DataFrame,
    one: DataFrame,
    many_key: str,
    one_key: str,
    how: str = "left",
    null_safe: bool = False,
    split_hot: bool = True,
) -> DataFrame:
    """``many JOIN one ON many_key = one_key`` that Spark can split at hot keys.

    ``one`` must hold at most one row per key (the caller de-duplicates).
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``; with
    ``null_safe`` NULL keys match each other.  Output columns: those of
    ``many`` then those of ``one`` (for inner/left), exactly as a plain join.
    ``split_hot=False`` joins on the key alone, for a ``many`` side that holds
    one row per key too, so that both keep their partitioning.  A streaming
    ``many`` side is joined plainly: each micro-batch is bounded by the trigger.
    """
    left, right = many[many_key], one[one_key]
    same = left.eqNullSafe(right) if null_safe else left == right
    if split_hot and not many.isStreaming:
        hashes = _hashes(many, many_key, one, one_key)
        same = same & (hashes[0] == hashes[1]) if hashes else same
    return many.join(one, same, how)


def _hashes(many: DataFrame, many_key: str, one: DataFrame, one_key: str) -> tuple[Column, Column] | None:
    """Hashes that are equal wherever the keys are; None for keys of unlike types.

    Numbers of two types are hashed as doubles, since equal ones are equal as
    doubles.
    """
    keys = many[many_key], one[one_key]
    types = many.schema[many_key].dataType, one.schema[one_key].dataType
    if types[0] != types[1]:
        if not all(isinstance(t, T.NumericType) for t in types):
            return None
        keys = tuple(k.cast("double") for k in keys)
    return F.xxhash64(keys[0]), F.xxhash64(keys[1])


#: Numbers of one row that one step writes.
RANGE_CHUNK = 4096


def explode_range(df: DataFrame, first: Column, last: Column, name: str, chunk: int = RANGE_CHUNK) -> DataFrame:
    """Each row once for every whole number from ``first`` to ``last``, as column ``name``; none where ``last < first``.

    A long range is first cut into chunks, which are dealt out by size, so no
    array holds all of it and no task writes it alone.
    """
    ends = df.withColumns({"_first": first.cast("long"), "_last": last.cast("long")}).filter(F.col("_last") >= F.col("_first"))
    chunks = F.floor((F.col("_last") - F.col("_first")) / chunk).cast("long")
    cut = ends.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks))).hint("rebalance")
    start = F.col("_first") + F.col("_chunk") * chunk
    return cut.withColumn(name, F.explode(F.sequence(start, F.least("_last", start + (chunk - 1))))).drop("_first", "_last", "_chunk")


def repeat_rows(df: DataFrame, times: str, chunk: int = RANGE_CHUNK) -> DataFrame:
    """Each row as often as its column ``times`` says (not at all for 0 or NULL); ``times`` is dropped."""
    return explode_range(df, F.lit(1), F.col(times), "_copy", chunk).drop("_copy", times)
