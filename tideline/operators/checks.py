"""Data checks (V1-V9, U3) as one aggregate job per table.

The role checks that need only the schema (roles given, columns present)
never start a job.  The type probes of every role column, and the emptiness
test, are fused into a single ``agg`` over the whole column, where the
reference looked at five values; the result is a small DataFrame of
``(check, passed, severity, detail, message)`` rows.  Collecting that result
(:func:`summarize`, :func:`require_valid`) moves at most a handful of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.dates import to_timestamp_lenient
from tideline.functions.numbers import to_number
from tideline.operators.textjobs import DATA_TERMS, screen_expr
from tideline.roles import Roles

DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NUMBER_TYPES = (T.NumericType, T.BooleanType)

LINEAR_AXIS = ("datetime", "numeric", "date_string", "numeric_string")
CONVERTED_AXIS = ("date_string", "numeric_string")
NUMERIC_BAR = ("datetime", "numeric")

# Display names of the per-check list.
CHECK_LABELS = {
    "roles_specified": "All required variables selected",
    "x_axis_linear": "X-axis is numeric/linear",
    "bar_numeric": "HBAR is numeric",
}

REPORT_SCHEMA = "check string, passed boolean, severity string, detail string, message string"


def missing_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Required names that are not columns of ``df`` (no job)."""
    have = set(df.columns)
    return [n for n in names if n not in have]


def roles_specified(roles: Roles) -> tuple[bool, list[str]]:
    """V1: every role given; else the labels of the missing ones."""
    missing = roles.missing_labels()
    return not missing, missing


def roles_in_data(df: DataFrame | None, roles: Roles) -> tuple[bool, list[str]]:
    """V2 (schema part): the role columns exist; emptiness is probed in the job."""
    if df is None:
        return False, ["No data"]
    named = [("X-axis", roles.x), ("Y-axis", roles.subject), ("HBAR", roles.bar)]
    missing = [f"{label} ('{c}')" for label, c in named if c not in df.columns]
    return not missing, missing


def _probe_aggs(df: DataFrame, c: str, tag: str) -> list[Column]:
    dt = df.schema[c].dataType
    if isinstance(dt, T.StringType):
        return [
            F.count(F.col(c)).alias(f"{tag}_n"),
            F.count(to_timestamp_lenient(F.col(c))).alias(f"{tag}_date"),
            F.count(to_number(F.col(c))).alias(f"{tag}_num"),
        ]
    return []


def _axis_type(df: DataFrame, c: str, tag: str) -> Column:
    """V3 over the probe row: datetime, numeric, then (full column) date text
    before number text, else non-linear; an all-NULL text column has no values."""
    dt = df.schema[c].dataType
    if isinstance(dt, DATETIME_TYPES):
        return F.lit("datetime")
    if isinstance(dt, NUMBER_TYPES):
        return F.lit("numeric")
    if not isinstance(dt, T.StringType):
        return F.lit("non_linear")
    n, n_date, n_num = F.col(f"{tag}_n"), F.col(f"{tag}_date"), F.col(f"{tag}_num")
    return (
        F.when(n == 0, F.lit("no_values"))
        .when(n_date == n, F.lit("date_string"))
        .when(n_num == n, F.lit("numeric_string"))
        .otherwise(F.lit("non_linear"))
    )


def _bar_type(df: DataFrame, c: str, tag: str) -> Column:
    """V4 over the probe row: datetime, or every non-NULL value a number."""
    dt = df.schema[c].dataType
    if isinstance(dt, DATETIME_TYPES):
        return F.lit("datetime")
    if isinstance(dt, NUMBER_TYPES):
        return F.lit("numeric")
    if not isinstance(dt, T.StringType):
        return F.lit("non_numeric")
    return F.when(F.col(f"{tag}_num") == F.col(f"{tag}_n"), "numeric").otherwise("non_numeric")


def column_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """V3 + V4 for many columns in one job: ``(column_name, axis_type, bar_type)``."""
    cols = list(cols or df.columns)
    aggs = [a for i, c in enumerate(cols) for a in _probe_aggs(df, c, f"p{i}")]
    row = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            _axis_type(df, c, f"p{i}").alias("axis_type"),
            _bar_type(df, c, f"p{i}").alias("bar_type"),
        )
        for i, c in enumerate(cols)
    ])
    return row.select(F.inline(entries))


def axis_type(df: DataFrame, x: str) -> DataFrame:
    """V3 for one column: one row ``(column_name, axis_type)``."""
    return column_types(df, [x]).select("column_name", "axis_type")


def bar_type(df: DataFrame, bar: str) -> DataFrame:
    """V4 for one column: one row ``(column_name, bar_type)``."""
    return column_types(df, [bar]).select("column_name", "bar_type")


def _rows(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REPORT_SCHEMA)


def validate_all(
    df: DataFrame | None, roles: Roles, graph_request: str | None = None,
    spark=None,
) -> DataFrame:
    """V5: the combined validation as report rows.

    Missing roles or columns short-circuit without a job.  Otherwise one
    aggregate computes the row count and the type probes of X and bar; an
    empty table yields only the "No data" error.  Conversions of text axes and
    datetime bars are warnings; a non-linear X or non-numeric bar, and a plot
    request containing data-step terms, are errors.
    """
    spark = spark or (df.sparkSession if df is not None else None)
    ok, missing = roles_specified(roles)
    if not ok:
        msg = f"Roles without a column: {', '.join(missing)}"
        return _rows(spark, [("roles_specified", False, "error", ", ".join(missing), msg)])
    ok, missing = roles_in_data(df, roles)
    if not ok:
        msg = (
            "No data" if missing == ["No data"]
            else f"Role columns that the table lacks: {', '.join(missing)}"
        )
        return _rows(spark, [("roles_in_data", False, "error", ", ".join(missing), msg)])

    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += _probe_aggs(df, roles.x, "x") + _probe_aggs(df, roles.bar, "b")
    probe = df.agg(*aggs)
    x_type, b_type = _axis_type(df, roles.x, "x"), _bar_type(df, roles.bar, "b")
    x_ok = x_type.isin(*LINEAR_AXIS)
    b_ok = b_type.isin(*NUMERIC_BAR)
    x_sev = F.when(~x_ok, "error").when(x_type.isin(*CONVERTED_AXIS), "warning").otherwise("ok")
    b_sev = F.when(~b_ok, "error").when(b_type == "datetime", "warning").otherwise("ok")
    x_msg = (
        F.when(~x_ok, F.lit(f"{roles.x}: the time axis holds values that are neither numbers nor dates"))
        .when(x_type.isin(*CONVERTED_AXIS),
              F.concat(F.lit(f"{roles.x}: the time axis is read from text as "), x_type)))
    b_msg = (
        F.when(~b_ok, F.lit(f"{roles.bar}: bar lengths need numbers"))
        .when(b_type == "datetime", F.lit(f"{roles.bar}: bar ends are times and become days")))
    entries = [
        F.struct(F.lit("roles_specified").alias("check"), F.lit(True).alias("passed"),
                 F.lit("ok").alias("severity"), F.lit(None).cast("string").alias("detail"),
                 F.lit(None).cast("string").alias("message")),
        F.struct(F.lit("roles_in_data").alias("check"), F.lit(True).alias("passed"),
                 F.lit("ok").alias("severity"), F.lit(None).cast("string").alias("detail"),
                 F.lit(None).cast("string").alias("message")),
        F.struct(F.lit("x_axis_linear").alias("check"), x_ok.alias("passed"),
                 x_sev.alias("severity"), x_type.alias("detail"), x_msg.alias("message")),
        F.struct(F.lit("bar_numeric").alias("check"), b_ok.alias("passed"),
                 b_sev.alias("severity"), b_type.alias("detail"), b_msg.alias("message")),
    ]
    if graph_request:
        issues = screen_expr(F.lit(graph_request), DATA_TERMS)
        has = F.size(issues) > 0
        entries.append(F.struct(
            F.lit("graph_request_screen").alias("check"), (~has).alias("passed"),
            F.when(has, "error").otherwise("ok").alias("severity"),
            F.array_join(issues, ", ").alias("detail"),
            F.when(has, F.concat(F.lit("The plot request asks for data work: "),
                                 F.array_join(issues, ", "))).alias("message"),
        ))
    empty = F.struct(F.lit("roles_in_data").alias("check"), F.lit(False).alias("passed"),
                     F.lit("error").alias("severity"), F.lit("No data").alias("detail"),
                     F.lit("No data").alias("message"))
    chosen = F.when(F.col("n_rows") == 0, F.array(empty)).otherwise(F.array(*entries))
    return probe.select(F.inline(chosen))


def check_list(report: DataFrame) -> DataFrame:
    """V6: the per-check view (label, passed, detail) of a :func:`validate_all` report."""
    label = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in CHECK_LABELS.items() for x in kv]),
                     F.col("check")),
        F.col("check"),
    )
    return report.filter(F.col("check").isin(*CHECK_LABELS)).select(
        label.alias("label"), "passed",
        F.when(F.col("passed") & F.col("check").isin("x_axis_linear", "bar_numeric"),
               F.concat(F.lit("Type: "), F.col("detail"))).alias("detail"),
    )


def summarize(report: DataFrame) -> dict:
    """``{valid, errors, warnings}`` from a report (collects its few rows)."""
    rows = report.collect()
    errors = [r["message"] for r in rows if r["severity"] == "error"]
    warnings = [r["message"] for r in rows if r["severity"] == "warning"]
    return {"valid": not errors, "errors": errors, "warnings": warnings}


class ValidationFailed(ValueError):
    pass


def require_valid(report: DataFrame) -> dict:
    """V7: raise on any error row; warnings pass."""
    result = summarize(report)
    if not result["valid"]:
        raise ValidationFailed("; ".join(result["errors"]))
    return result


def require_columns(after: DataFrame, roles: Roles, strict: bool = False) -> list[str]:
    """V8: role columns missing after a transform (raises when ``strict``)."""
    missing = missing_columns(after, roles.required())
    if missing and strict:
        raise ValidationFailed(f"Required columns missing after processing: {missing}")
    return missing


def validation_report(
    df: DataFrame,
    roles: Roles,
    lineage: Mapping | None = None,
    original: DataFrame | None = None,
    order: Sequence[str] | None = None,
    n_preview: int = 5,
) -> DataFrame:
    """V9: one row describing the plot table.

    Shapes before/after (scalar-subquery counts), the request, derived names
    and formulas, the first ``n_preview`` rows in an explicit order as JSON
    text, columns, Spark types and the roles.
    """
    n_after = df.agg(F.count(F.lit(1))).scalar()
    base = original if original is not None else df
    n_before = base.agg(F.count(F.lit(1))).scalar()
    first_rows = _first_rows(df, roles, order, n_preview).agg(F.collect_list("j")).scalar()
    return _report_row(df, base, roles, lineage, n_before, n_after, first_rows)


def transform_report(
    original: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    roles: Roles,
    lineage: Mapping | None = None,
    order: Sequence[str] | None = None,
    n_preview: int = 5,
) -> DataFrame:
    """V9 in one job: the report of ``fn(original)``, whatever ``original`` costs to compute.

    The first rows are a bounded top-k; the rows before and after the transform
    are counted on the way by the same job, so merges and scans run once.
    ``fn`` uses its input once.  The report, one row, is computed at once.
    """
    before, after = Observation(), Observation()
    one = F.count(F.lit(1)).alias("rows")
    out = fn(original.observe(before, one))
    first = [r["j"] for r in _first_rows(out.observe(after, one), roles, order, n_preview).collect()]
    rows = F.array(*[F.lit(j) for j in first]).cast("array<string>")
    return _report_row(out, original, roles, lineage, F.lit(_observed(before, original)), F.lit(_observed(after, out)), rows)


def _observed(rows: Observation, df: DataFrame) -> int:
    """The observed count; counted anew where Catalyst saw that no row can come out and dropped the observation."""
    try:
        return rows.get["rows"]
    except (KeyError, Py4JError):
        return df.count()


def _first_rows(df: DataFrame, roles: Roles, order: Sequence[str] | None, n: int) -> DataFrame:
    order = list(order or [c for c in roles.required() if c in df.columns] or df.columns[:1])
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n).select(
        F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("j"))


def _report_row(df: DataFrame, base: DataFrame, roles: Roles, lineage: Mapping | None, n_before: Column, n_after: Column,
                first_rows: Column) -> DataFrame:
    spark, lineage = df.sparkSession, dict(lineage or {})
    formulas = lineage.get("formulas", {}) or {}
    fmap = (
        F.create_map(*[F.lit(x) for kv in formulas.items() for x in kv])
        if formulas else F.create_map().cast("map<string,string>")
    )
    derived = lineage.get("derived", []) or []
    return spark.range(1).select(
        F.struct(n_before.alias("rows"), F.lit(len(base.columns)).alias("cols")).alias("original_shape"),
        F.struct(n_after.alias("rows"), F.lit(len(df.columns)).alias("cols")).alias("processed_shape"),
        F.lit(lineage.get("request", "")).alias("request"),
        F.array(*[F.lit(d) for d in derived]).cast("array<string>").alias("derived"),
        fmap.alias("formulas"),
        first_rows.alias("first_rows"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.create_map(*[F.lit(x) for f in df.schema.fields
                       for x in (f.name, f.dataType.simpleString())]).alias("dtypes"),
        F.struct(F.lit(roles.subject).alias("subject"), F.lit(roles.x).alias("x"),
                 F.lit(roles.bar).alias("bar")).alias("roles"),
    )
