"""Connected components of a link table, iterated on Spark with cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import delete, save
from tideline.operators.skew import join_one_per_key


def _to_least(links: DataFrame, low: DataFrame) -> DataFrame:
    """Every link with the least neighbour of its ``u``; a hub's links are split over tasks by their measured size."""
    return join_one_per_key(links, low.withColumnRenamed("u", "hub"), "u", "hub", "inner").select("u", "v", "m")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)``: the smallest node reachable, for every linked node but the roots.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join back; no node's neighbours are ever gathered in one place.  Every
    round's links are written to the shared folder; the round count grows with
    the logarithm of a component's size.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = save(edges, "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _to_least(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _to_least(large, low)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = save(small.where("u <> v").distinct(), "links")
        delete(edges)
        edges = new
        # Stars only: every node points at its root and no root points anywhere.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError("the components did not settle")
