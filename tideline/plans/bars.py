"""The flagship plan: one bar per subject straight from records and subjects.

Generic route (what a user composes):  merge (J1) -> derive the day (P4) ->
``subject_bars`` (G1).  That joins every record to its subject first and then
aggregates; with the join and the aggregate on the same key Spark puts no
partial aggregation between them, so one subject with a third of all records
lands in one join task and then one aggregate task.

This route aggregates first.  The bar is ``floor(time - reference) + 1`` and
the reference is constant per subject, so the smallest bar is the bar of the
smallest time: ``min`` moves below the join.  Records fold to one row per
subject with partial aggregation before the exchange (a hot subject costs one
row per map task), and the merge becomes a 1:1 join of two tables keyed and
partitioned on the subject: two exchanges in total, none carrying more than
one row per subject per map task.  ``tests/test_bars.py`` checks both routes
give the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.dates import day_diff
from tideline.operators.merge import OrderItem, first_per_key, merge_subjects
from tideline.operators.skew import join_one_per_key


def record_bars(
    records: DataFrame,
    subjects: DataFrame,
    key: tuple[str, str],
    reference: str,
    time: str,
    attrs: Sequence[str] = (),
    bar: str = "bar_days",
    inclusive: bool = True,
    order: Sequence[OrderItem] | None = None,
) -> DataFrame:
    """Per records subject: bar length in days, subject attributes, record count.

    Equal to ``subject_bars(merge_subjects(records, subjects, key), ...)`` with
    the bar ``day_diff(reference, time, inclusive)`` and ``attrs`` carried, for
    attributes that come from the subject table.
    """
    rkey, skey = key
    per_subject = records.groupBy(rkey).agg(
        F.min(time).alias("_first_time"), F.count(F.lit(1)).alias("n_records")
    )
    subj = first_per_key(subjects.select(skey, reference, *attrs), skey, order)
    merged = merge_subjects(per_subject, subj, (rkey, skey), dedup=False, split_hot=False)
    return merged.select(
        F.col(rkey),
        day_diff(F.col(reference), F.col("_first_time"), inclusive=inclusive).alias(bar),
        *[F.col(a) for a in attrs],
        F.col("n_records"),
    )


def record_conflicts(
    records: DataFrame,
    subjects: DataFrame,
    key: tuple[str, str],
    reference: str,
    time: str,
    inclusive: bool = True,
    order: Sequence[OrderItem] | None = None,
) -> DataFrame:
    """G7 below the merge: subjects whose bar is not constant, with ``min_bar``, ``max_bar`` and ``n_values``.

    Equal to ``bar_conflicts`` on the merged records.  The reference is constant
    per subject, so the earliest and latest time give the smallest and largest
    bar: both fold to one row per subject and task before the merge.  The exact
    number of different bars needs the records again, but only those of
    subjects whose two bars differ.
    """
    rkey, skey = key
    spans = records.groupBy(rkey).agg(F.min(time).alias("_first_time"), F.max(time).alias("_last_time"))
    subj = first_per_key(subjects.select(skey, reference), skey, order)
    merged = merge_subjects(spans, subj, (rkey, skey), dedup=False, split_hot=False)
    ends = merged.select(
        F.col(rkey).alias("_subject"), F.col(reference).alias("_reference"),
        day_diff(F.col(reference), F.col("_first_time"), inclusive=inclusive).alias("min_bar"),
        day_diff(F.col(reference), F.col("_last_time"), inclusive=inclusive).alias("max_bar"))
    differing = ends.filter(F.col("min_bar") != F.col("max_bar"))
    own = join_one_per_key(records.select(rkey, time), differing, rkey, "_subject", "inner")
    days = day_diff(F.col("_reference"), F.col(time), inclusive=inclusive).alias("_bar")
    return own.select(rkey, "min_bar", "max_bar", days).groupBy(rkey, "min_bar", "max_bar").agg(
        F.count_distinct("_bar").alias("n_values"))
