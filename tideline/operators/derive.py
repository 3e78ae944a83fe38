"""Projections, derivations and filters.

Column bookkeeping (which columns to keep, which are derived) is metadata on
the driver and never runs a job; row work is built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.dates import day_diff
from tideline.operators.skew import join_one_per_key
from tideline.roles import SUBJECT_ID_COLUMNS, Roles


def derived_columns(df: DataFrame, base_cols: Sequence[str]) -> list[str]:
    """Columns of ``df`` that are not in the original records table."""
    base = set(base_cols)
    return [c for c in df.columns if c not in base]


def plot_columns(
    df: DataFrame, roles: Roles, base_cols: Sequence[str],
    include_merged: bool = True, merged_cols: Sequence[str] = (),
) -> list[str]:
    """Column order of the plot table: subject, x, bar, keep, then derived.

    Repeats are dropped keeping the first position.  Merged subject columns
    count as derived because they are not in the records table; with
    ``include_merged=False`` the ``merged_cols`` are left out unless kept.
    """
    chosen = list(dict.fromkeys([roles.subject, roles.x, roles.bar, *roles.keep]))
    chosen = [c for c in chosen if c]
    skip = set(chosen) | (set() if include_merged else set(merged_cols))
    extra = [c for c in derived_columns(df, base_cols) if c not in skip]
    return chosen + extra


def select_plot_columns(
    df: DataFrame, roles: Roles, base_cols: Sequence[str],
    include_merged: bool = True, merged_cols: Sequence[str] = (),
) -> DataFrame:
    """Project to :func:`plot_columns`; rows are never dropped."""
    return df.select(*plot_columns(df, roles, base_cols, include_merged, merged_cols))


def addable_columns(df: DataFrame, roles: Roles) -> list[str]:
    """Columns that may still become overlays."""
    blocked = {roles.x, roles.subject, roles.bar, *SUBJECT_ID_COLUMNS}
    return [c for c in df.columns if c not in blocked]


def derive(
    df: DataFrame, formulas: Mapping[str, str | Column], request: str = ""
) -> tuple[DataFrame, dict]:
    """Add computed columns; return the frame and its lineage record.

    ``formulas`` maps new names to SQL expressions (or Columns).  Everything is
    added in one projection; the lineage keeps names in order and the formula
    text for each.
    """
    cols = {n: (F.expr(e) if isinstance(e, str) else e) for n, e in formulas.items()}
    lineage = {
        "request": request,
        "derived": list(formulas),
        "formulas": {n: (e if isinstance(e, str) else str(e)) for n, e in formulas.items()},
    }
    return df.withColumns(cols), lineage


LINEAGE_SCHEMA = (
    "request string, derived array<string>, formulas map<string,string>, "
    "rows_before bigint, rows_after bigint"
)


def lineage_frame(spark, lineage: Mapping, rows_before: int | None = None,
                  rows_after: int | None = None) -> DataFrame:
    """A lineage record as a one-row typed DataFrame (for a lineage table)."""
    row = (lineage.get("request", ""), list(lineage.get("derived", [])),
           dict(lineage.get("formulas", {})), rows_before, rows_after)
    return spark.createDataFrame([row], LINEAGE_SCHEMA)


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULLs per column."""
    return df.na.fill(dict(values))


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in any of ``cols`` (all columns by default)."""
    return df.na.drop(how="any", subset=list(cols) if cols else None)


def filter_rows(df: DataFrame, predicate: str | Column) -> DataFrame:
    """keep rows matching a SQL predicate or Column (pushed to the scan)."""
    return df.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)


def not_null(df: DataFrame, col: str) -> DataFrame:
    """rows where ``col`` has a value (for float columns also not NaN, in
    case the table was not loaded through :func:`tideline.sources.read_table`)."""
    cond = F.col(col).isNotNull()
    if df.schema[col].dataType.typeName() in ("double", "float"):
        cond = cond & ~F.isnan(F.col(col))
    return df.filter(cond)


def _subject_keys(subjects: DataFrame | Sequence, key: str, spark_df: DataFrame) -> DataFrame:
    if isinstance(subjects, DataFrame):
        return subjects
    spark = spark_df.sparkSession
    field = spark_df.schema[key]
    return spark.createDataFrame([(v,) for v in subjects], f"{key} {field.dataType.simpleString()}")


def keep_subjects(
    df: DataFrame, subjects: DataFrame | Sequence, key: str, subjects_key: str | None = None
) -> DataFrame:
    """rows whose subject is in ``subjects`` (a table or a list): semi join.

    The subject list is de-duplicated first (partial aggregation), so a
    subject listed many times is one build row; hot subjects on ``df`` can be
    split (:mod:`tideline.operators.skew`).
    """
    s = _subject_keys(subjects, key, df)
    keys = s.select(F.col(subjects_key or key).alias("_keep_key")).distinct()
    return join_one_per_key(df, keys, key, "_keep_key", "left_semi")


def exclude_subjects(
    df: DataFrame, subjects: DataFrame | Sequence, key: str, subjects_key: str | None = None
) -> DataFrame:
    """rows whose subject is not in ``subjects``: anti join.

    A NULL subject is never excluded (it equals no listed subject).
    """
    s = _subject_keys(subjects, key, df)
    keys = s.select(F.col(subjects_key or key).alias("_drop_key")).distinct()
    return join_one_per_key(df, keys, key, "_drop_key", "left_anti")


class InvalidSubjectRole(ValueError):
    pass


def require_subject_id(roles: Roles, allowed: Sequence[str] = SUBJECT_ID_COLUMNS) -> None:
    """the subject role must be one of the recognised identifier columns."""
    if roles.subject not in allowed:
        raise InvalidSubjectRole(
            f"Y-axis must be one of {list(allowed)}; '{roles.subject}' is not a subject identifier"
        )


def per_subject(
    df: DataFrame, key: str, aggs: Mapping[str, Column]
) -> DataFrame:
    """Per-subject aggregates spread back onto every row.

    Aggregates first (partial aggregation, so a hot subject is folded before
    the exchange) and joins the one-row-per-subject result back null-safely.
    """
    per_key = df.groupBy(key).agg(*[a.alias(n) for n, a in aggs.items()])
    per_key = per_key.withColumnRenamed(key, "_ps_key")
    out = join_one_per_key(df, per_key, key, "_ps_key", "left", null_safe=True)
    return out.drop("_ps_key")


def days_since_min(
    df: DataFrame, col: str, by: str | None = None, inclusive: bool = False,
    name: str = "days_since_min",
) -> DataFrame:
    """P5: whole days from the smallest ``col`` (overall, or per ``by``) to each row.

    Overall, the minimum is a scalar subquery: Spark computes it in its own
    small aggregate job and folds the value into the projection, so no row is
    joined or broadcast.  Per subject it is :func:`per_subject`.
    """
    if by is None:
        first = df.agg(F.min(col)).scalar()
        return df.withColumn(name, day_diff(first, F.col(col), inclusive=inclusive))
    tmp = f"_min_{col}"
    out = per_subject(df, by, {tmp: F.min(col)})
    return out.withColumn(name, day_diff(F.col(tmp), F.col(col), inclusive=inclusive)).drop(tmp)


def bar_to_days(
    df: DataFrame, bar: str, reference: str | Column, inclusive: bool = False,
    name: str | None = None,
) -> DataFrame:
    """Turn a datetime bar into whole days from ``reference``.

    ``reference`` is a column (e.g. the subject's start date) or a Column such
    as ``F.lit(date)``; the result replaces ``bar`` unless ``name`` is given.
    """
    ref = F.col(reference) if isinstance(reference, str) else reference
    return df.withColumn(name or bar, day_diff(ref, F.col(bar), inclusive=inclusive))
