"""Layer edits (U1, U2): what changed between two versions of a figure.

Layers are rows ``(plot_id, layer)``; a version is a table of them.  The diff
is a full outer join on both columns after de-duplication, and the contract
check one grouped aggregate per plot, so any number of plots is checked in
one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer_changes(before: DataFrame, after: DataFrame,
                  plot: str = "plot_id", layer: str = "layer") -> DataFrame:
    """Each layer of either version with status ``added``/``removed``/``kept``."""
    b = before.select(plot, layer).distinct().withColumn("_in_before", F.lit(True))
    a = after.select(plot, layer).distinct().withColumn("_in_after", F.lit(True))
    both = b.join(a, [plot, layer], "full_outer")
    status = (
        F.when(F.col("_in_before").isNull(), "added")
        .when(F.col("_in_after").isNull(), "removed")
        .otherwise("kept")
    )
    return both.select(plot, layer, status.alias("status"))


def check_edit_contract(
    changes: DataFrame, mode: str | None = None, plot: str = "plot_id", layer: str = "layer",
    requests: DataFrame | None = None, category: str = "category",
    protected: Sequence[str] = (),
) -> DataFrame:
    """Per plot, the counts and sorted names of added and removed layers and
    whether the edit is a valid *add* (exactly one added, none removed) or
    *remove* (exactly one removed, none added).

    ``requests`` holds one row per plot ``(plot, category)``: ``ok`` is then the
    verdict for each plot's own category; ``mode`` is one category for all.
    Categories other than ``add_overlay`` and ``remove_overlay`` may change
    layers freely.  No edit may remove a ``protected`` layer (the bars):
    ``lost_protected`` tells, and ``ok`` and ``remove_ok`` are then false.  The
    name lists are bounded by a plot's number of layers.
    """
    def names(status: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col(layer))))

    lost = F.col(layer).isin(*protected) if protected else F.lit(False)
    out = changes.groupBy(plot).agg(
        F.count_if(F.col("status") == "added").alias("n_added"),
        F.count_if(F.col("status") == "removed").alias("n_removed"),
        names("added").alias("added"),
        names("removed").alias("removed"),
        F.coalesce(F.bool_or((F.col("status") == "removed") & lost), F.lit(False)).alias("lost_protected"),
    )
    kept = ~F.col("lost_protected")
    out = out.withColumns({
        "add_ok": (F.col("n_added") == 1) & (F.col("n_removed") == 0),
        "remove_ok": (F.col("n_removed") == 1) & (F.col("n_added") == 0) & kept,
    })
    if requests is not None:
        out = out.join(requests.select(plot, category), plot, "left")
    elif mode is not None:
        out = out.withColumn(category, F.lit(mode))
    else:
        return out
    ok = (
        F.when(F.col(category) == "add_overlay", F.col("add_ok"))
        .when(F.col(category) == "remove_overlay", F.col("remove_ok"))
        .otherwise(F.lit(True))
    )
    return out.withColumn("ok", ok & kept)
