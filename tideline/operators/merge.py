"""De-duplication and the subject merge.

Plan shape.  :func:`first_per_key` is an aggregate (``min`` of a struct), so
Spark runs it as partial + final aggregation (sort-based when the struct
carries strings, spilling like any sort): every map task folds its
rows to one per key before the exchange, and a key that owns a third of the
table costs one row per task, not a third of the table in one task.  The merge
is a left equi-join of the records onto that one-row-per-key table, through
:func:`tideline.operators.skew.join_one_per_key`, whose plan lets adaptive
execution split a subject with very many records over several tasks.  The join strategy is otherwise
left to Spark: the subject side is broadcast only when its size is known to be
under ``spark.sql.autoBroadcastJoinThreshold`` (from statistics, or at run
time from AQE's measured shuffle size); above it a sort-merge join runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.skew import join_one_per_key

OrderItem = str | tuple[str, str]


def _order_parts(order: Sequence[OrderItem] | None) -> list[tuple[str, bool]]:
    parts = []
    for item in order or ():
        if isinstance(item, str):
            parts.append((item, True))
        else:
            name, direction = item
            parts.append((name, direction.lower().startswith("asc")))
    return parts


def _has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.StructType):
        return any(_has_map(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _has_map(dt.elementType)
    return False


def first_per_key(
    df: DataFrame,
    key: str | Sequence[str],
    order: Sequence[OrderItem] | None = None,
    method: str = "auto",
) -> DataFrame:
    """One row per key, the first in ``order`` (ascending, NULLs last).

    ``order`` items are column names (ascending) or ``(name, 'desc')``.  Ties
    on ``order`` are broken by the remaining column values, so the result does
    not depend on input order or partitioning.  Rows with a NULL key form one
    group, as in pandas ``drop_duplicates``.

    ``method='aggregate'`` (default for ascending orders) runs
    ``min(struct(order IS NULL, order, rest))`` per key: partial aggregation
    before the exchange.  ``method='window'`` uses
    ``row_number() = 1``; it is chosen automatically for descending orders and
    for columns of map type, which have no ordering.
    """
    keys = [key] if isinstance(key, str) else list(key)
    parts = _order_parts(order)
    rest = [c for c in df.columns if c not in keys]
    needs_window = any(not asc for _, asc in parts) or any(
        _has_map(df.schema[c].dataType) for c in rest
    )
    if method == "auto":
        method = "window" if needs_window else "aggregate"
    if method == "window":
        order_cols = [
            (F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last())
            for c, asc in parts
        ]
        tiebreak = [
            F.col(c).asc_nulls_last()
            for c in rest
            if c not in {p for p, _ in parts} and not _has_map(df.schema[c].dataType)
        ]
        w = Window.partitionBy(*keys).orderBy(*(order_cols + tiebreak))
        return (
            df.withColumn("_w1_rn", F.row_number().over(w))
            .filter(F.col("_w1_rn") == 1)
            .drop("_w1_rn")
        )
    if needs_window:
        raise ValueError("aggregate de-duplication needs ascending order and no map columns")
    fields: list[Column] = []
    for i, (c, _) in enumerate(parts):
        fields.append(F.col(c).isNull().alias(f"_o{i}_null"))
        fields.append(F.col(c).alias(f"_o{i}"))
    fields.extend(F.col(c).alias(f"_c{j}") for j, c in enumerate(rest))
    best = F.min(F.struct(*fields)).alias("_w1")
    out = df.groupBy(*keys).agg(best)
    return out.select(
        *[F.col(k) for k in keys],
        *[F.col(f"_w1._c{j}").alias(c) for j, c in enumerate(rest)],
    ).select(*df.columns)


def _keys(key: str | tuple[str, str]) -> tuple[str, str]:
    return (key, key) if isinstance(key, str) else key


def clash_renames(
    records_cols: Sequence[str], subject_cols: Sequence[str], subject_key: str,
    suffix: str = "_subj",
) -> dict[str, str]:
    """New names for subject columns that also exist in the records."""
    taken = set(records_cols)
    renames = {}
    for c in subject_cols:
        if c == subject_key or c not in taken:
            continue
        new = c + suffix
        while new in taken or new in subject_cols:
            new += suffix
        renames[c] = new
        taken.add(new)
    return renames


def merge_subjects(
    records: DataFrame,
    subjects: DataFrame,
    key: str | tuple[str, str] = "USUBJID",
    cols: Sequence[str] | None = None,
    order: Sequence[OrderItem] | None = None,
    null_keys: str = "no_match",
    suffix: str = "_subj",
    dedup: bool = True,
    split_hot: bool = True,
) -> DataFrame:
    """J1 (+J4): left-join one row per subject onto every record.

    ``key`` is one name present on both sides or ``(records_key, subjects_key)``;
    the result keeps the records' key column only.  ``cols`` limits the subject
    columns brought over (all by default).  Name the columns you need: the
    de-duplication breaks ties on every carried column, so Catalyst cannot
    prune carried columns from the subject scan even when nothing uses them.
    The subject table is first reduced to one row per key (W1, by ``order``),
    so the merge never multiplies records.  Subject columns whose names clash
    with record columns get ``suffix``.  ``null_keys='match'`` pairs NULL keys
    with each other, as pandas does; the default leaves them unmatched.
    ``split_hot=False`` is for records that already hold one row per subject
    (:func:`tideline.operators.skew.join_one_per_key`).
    """
    rkey, skey = _keys(key)
    wanted = list(cols) if cols is not None else [c for c in subjects.columns if c != skey]
    subj = subjects.select(skey, *[c for c in wanted if c != skey])
    if dedup:
        subj = first_per_key(subj, skey, order)
    renames = clash_renames(records.columns, subj.columns, skey, suffix)
    renames[skey] = "_merge_key"
    subj = subj.withColumnsRenamed(renames)
    out = join_one_per_key(records, subj, rkey, "_merge_key", "left",
                           null_safe=null_keys == "match", split_hot=split_hot)
    return out.drop("_merge_key")


def merge_with_counts(
    records: DataFrame, subjects: DataFrame, key: str | tuple[str, str] = "USUBJID", **kw
) -> tuple[DataFrame, Observation, Observation]:
    """Merge while observing the row counts before and after.

    Both counts are collected by the same job that computes the merge, the
    first time an action runs on the returned DataFrame; no second pass.
    """
    before, after = Observation(), Observation()  # unnamed: two merges may meet in one plan
    observed = records.observe(before, F.count(F.lit(1)).alias("rows"))
    merged = merge_subjects(observed, subjects, key, **kw).observe(
        after, F.count(F.lit(1)).alias("rows")
    )
    return merged, before, after


def merge_contract(
    records: DataFrame, subjects: DataFrame, key: str | tuple[str, str] = "USUBJID",
    by: str | None = None, cols: Sequence[str] = (), **kw,
) -> DataFrame:
    """J2 inside the plan: the records, the merge's own output, and where they differ, per group.

    One row per value of ``by`` (a records column, e.g. the arm; one row in all
    without it): ``rows_before``, ``rows_after``, ``n_matched`` (merged rows that
    found a subject), ``n_subjects``, and ``n_changed``, the subjects whose
    records the merge multiplied or lost, with ``kept`` true where there are none.  Both sides are counted per subject with
    partial aggregation, so a hot subject sends one row a task, and compared in
    the job that computes the merge.  NULL keys are one subject; a NULL group is
    a group.  No records give no rows (without ``by``: one row of zeros).
    """
    rkey, _ = _keys(key)
    # The mark makes the merge itself part of the plan: without a subject column in use, Catalyst drops the join.
    marked = subjects.withColumn("_matched", F.lit(1).cast("long"))
    merged, _, _ = merge_with_counts(records, marked, key, cols=[*cols, "_matched"], **kw)
    group = F.col(by) if by else F.lit(None).cast("string")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def counted(df: DataFrame, before: Column, after: Column, matched: Column) -> DataFrame:
        return df.select(F.col(rkey).alias("_key"), group.alias("_group"), before.alias("_before"), after.alias("_after"),
                         matched.alias("_matched"))

    both = counted(records, one, none, none).unionAll(counted(merged, none, one, F.coalesce("_matched", none)))
    per_key = both.groupBy("_group", "_key").agg(*[F.sum(c).alias(c) for c in ("_before", "_after", "_matched")])
    changed = F.count_if(F.col("_before") != F.col("_after"))
    per_group = (per_key.groupBy("_group") if by else per_key).agg(
        F.coalesce(F.sum("_before"), F.lit(0)).cast("long").alias("rows_before"),
        F.coalesce(F.sum("_after"), F.lit(0)).cast("long").alias("rows_after"),
        F.coalesce(F.sum("_matched"), F.lit(0)).cast("long").alias("n_matched"),
        F.count(F.lit(1)).alias("n_subjects"), changed.alias("n_changed"))
    named = [F.col("_group").alias(by)] if by else []
    return per_group.select(*named, "rows_before", "rows_after", "n_matched", "n_subjects", "n_changed", (F.col("n_changed") == 0).alias("kept"))


class RowCountChanged(AssertionError):
    pass


def check_row_count(before: Observation, after: Observation) -> int:
    """Raise when a merge changed the number of records (after an action)."""
    n_before, n_after = before.get["rows"], after.get["rows"]
    if n_before != n_after:
        raise RowCountChanged(f"merge changed rows: {n_before} -> {n_after}")
    return n_after


class MissingColumns(KeyError):
    pass


def resolve_columns(
    names: Sequence[str], records: DataFrame, subjects: DataFrame | None = None,
    strict: bool = True,
) -> list[tuple[str, str | None]]:
    """Where each wanted column lives: ``records``, else ``subjects``.

    Metadata only (no job).  Missing names raise :class:`MissingColumns` when
    ``strict``; otherwise they are returned with location ``None``.
    """
    rec, sub = set(records.columns), set(subjects.columns) if subjects is not None else set()
    found = [
        (n, "records" if n in rec else "subjects" if n in sub else None) for n in names
    ]
    missing = [n for n, where in found if where is None]
    if missing and strict:
        raise MissingColumns(f"columns not found in either table: {missing}")
    return found


def orphan_markers(markers: DataFrame, bars: DataFrame, key: str | tuple[str, str]) -> DataFrame:
    """Markers whose subject has no bar (must be empty for a sound timeline)."""
    mkey, bkey = _keys(key)
    bar_keys = bars.select(F.col(bkey).alias("_bar_key"))
    return join_one_per_key(markers, bar_keys, mkey, "_bar_key", "left_anti")
