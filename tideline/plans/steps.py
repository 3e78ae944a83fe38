"""Declarative data steps.

A step list replaces run-time generated table code: merge the subject table,
derive columns, filter, fill, drop missing, keep or exclude subjects, or call
a user function.  The list compiles to one lazy plan; analysis errors (an
unknown column, a bad expression) surface while it is built, so a failed step
is reported before any job runs.  Row-level contracts (the merge keeps every
record) are observed by the first action instead of a second pass.

A value that cannot be cast or a failing expression shows only when rows are
computed.  :func:`staged_transform` therefore computes the result into the
shared folder first, checks its contract there, and only then lets it replace
the original.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tideline.operators import derive as D
from tideline.operators.checks import require_columns
from tideline.operators.merge import merge_subjects
from tideline.operators.textjobs import PLOT_TERMS
from tideline.roles import Roles
from tideline.sources.staging import StagedTable, stage_table


@dataclass
class StepResult:
    df: DataFrame
    status: str
    message: str = ""
    lineage: dict = field(default_factory=dict)
    observations: dict[str, Observation] = field(default_factory=dict)
    staged: StagedTable | None = None

    @property
    def ok(self) -> bool:
        return self.status in ("applied", "committed")

    def row_counts(self) -> dict[str, int]:
        """Observed row counts (available after the first action on ``df``)."""
        return {k: o.get.get("rows", 0) for k, o in self.observations.items()}


class StepFailed(RuntimeError):
    pass


def screen_request(text: str | None, terms: Sequence[str] = PLOT_TERMS) -> list[str]:
    """The request-level screen for one text on the driver (see ``screen_terms``)."""
    if not text or not text.strip():
        return []
    lowered = text.lower()
    return [t for t in terms if t in lowered]


def guarded_transform(
    df: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    roles: Roles | None = None,
    strict: bool = False,
    observe_rows: bool = False,
) -> StepResult:
    """Apply a user function; keep the original when it fails.

    Failure means the function raised (analysis errors included), returned
    something that is not a DataFrame, or dropped a role column (V8).  With
    ``strict`` the failure raises instead.  ``observe_rows`` attaches row-count
    observations to input and output, filled by the first action.
    """
    observations: dict[str, Observation] = {}
    src = df
    if observe_rows:
        observations["before"] = Observation("before")
        src = df.observe(observations["before"], F.count(F.lit(1)).alias("rows"))

    def fail(status: str, message: str) -> StepResult:
        if strict:
            raise StepFailed(f"{status}: {message}")
        return StepResult(df, status, message)

    try:
        out = fn(src)
    except Exception as err:
        return fail("error", f"{type(err).__name__}: {err}")
    if not isinstance(out, DataFrame):
        return fail("no_output", "transform did not return a DataFrame")
    if roles is not None:
        missing = require_columns(out, roles)
        if missing:
            return fail("missing_columns", f"Required columns missing after processing: {missing}")
    if observe_rows:
        observations["after"] = Observation("after")
        out = out.observe(observations["after"], F.count(F.lit(1)).alias("rows"))
    return StepResult(out, "applied", observations=observations)


#: What a staged result may do to the number of rows.
ROW_RULES = ("any", "same", "no_more")


def staged_transform(
    df: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    roles: Roles | None = None,
    rows: str = "any",
    types: Mapping[str, str] | None = None,
    filled: Sequence[str] = (),
    strict: bool = False,
    name: str = "transform",
) -> StepResult:
    """E1, stage and commit: the result replaces the original only after it was computed and checked.

    The function's result is written to the shared folder.  The original stays,
    with a status that says why, when

    * the plan cannot be built (``error``, ``no_output``, ``missing_columns`` as
      for :func:`guarded_transform`);
    * a row fails while it is computed (``run_error``, with the error's condition);
    * the written table breaks its contract (``contract``): ``rows`` is ``same``
      or ``no_more`` and the counts say otherwise, a column of ``types`` has
      another Spark type, or a column of ``filled`` holds no value at all.

    Otherwise the status is ``committed`` and ``df`` reads the written table:
    later actions never compute the function again.  Nothing half-written is
    left behind.  An empty table is committed like any other, unless ``filled``
    names a column.
    """
    if rows not in ROW_RULES:
        raise ValueError(f"rows must be one of {ROW_RULES}")

    def fail(status: str, message: str) -> StepResult:
        if strict:
            raise StepFailed(f"{status}: {message}")
        return StepResult(df, status, message)

    built = guarded_transform(df, fn, roles, strict=strict)
    if not built.ok:
        return built
    actual = {f.name: f.dataType.simpleString() for f in built.df.schema.fields}
    wrong = {c: actual.get(c) for c, t in (types or {}).items() if actual.get(c) != t}
    if wrong:
        return fail("contract", f"column types differ: {wrong}")
    try:
        staged = stage_table(built.df, name)
    except Exception as err:
        condition = err.getCondition() if isinstance(err, PySparkException) else None
        return fail("run_error", condition or f"{type(err).__name__}: {err}"[:500])
    broken = _broken_rows(df, staged.df, rows, filled)
    if broken:
        staged.drop()
        return fail("contract", broken)
    return StepResult(staged.df, "committed", staged=staged)


def _broken_rows(before: DataFrame, after: DataFrame, rows: str, filled: Sequence[str]) -> str:
    """How the written table breaks its row contract; empty when it does not."""
    counts = after.agg(F.count(F.lit(1)), *[F.count(F.col(c)) for c in filled]).first()
    bare = [c for c, n in zip(filled, counts[1:], strict=True) if n == 0]
    if bare:
        return f"columns without a value: {bare}"
    if rows == "any":
        return ""
    n = before.count()
    if (rows == "same" and counts[0] != n) or (rows == "no_more" and counts[0] > n):
        return f"rows: {n} before, {counts[0]} after"
    return ""


def _step_kind(step: Mapping) -> str:
    return str(step.get("kind", "")).lower()


def apply_steps(
    records: DataFrame,
    steps: Sequence[Mapping],
    subjects: DataFrame | None = None,
    roles: Roles | None = None,
    request: str = "",
    strict: bool = False,
    stage: bool = False,
    rows: str = "any",
) -> StepResult:
    """Merge, derive and filter as one lazy plan, with lineage.

    With ``stage`` the result is computed, checked (``rows`` as for
    :func:`staged_transform`) and read from the shared folder.

    Step kinds: ``merge`` (key, cols, order, null_keys), ``derive`` (name,
    expr), ``filter`` (predicate), ``fill`` (values), ``drop_missing``
    (cols), ``keep_subjects`` / ``exclude_subjects`` (key, subjects),
    ``transform`` (fn).  A request text containing plot-styling terms is
    refused before anything is built.  All columns are kept; choosing the plot
    columns is a later step (P1).
    """
    issues = screen_request(request)
    if issues:
        if strict:
            raise StepFailed(f"request contains plot elements: {issues}")
        return StepResult(records, "refused", f"request contains plot elements: {issues}")
    lineage = {"request": request, "derived": [], "formulas": {}}

    def build(df: DataFrame) -> DataFrame:
        for step in steps:
            kind = _step_kind(step)
            if kind == "merge":
                if subjects is None:
                    raise ValueError("merge step needs a subject table")
                df = merge_subjects(
                    df, subjects, step.get("key", "USUBJID"), cols=step.get("cols"),
                    order=step.get("order"), null_keys=step.get("null_keys", "no_match"),
                )
            elif kind == "derive":
                df, lin = D.derive(df, {step["name"]: step["expr"]})
                lineage["derived"].extend(lin["derived"])
                lineage["formulas"].update(lin["formulas"])
            elif kind == "filter":
                df = D.filter_rows(df, step["predicate"])
            elif kind == "fill":
                df = D.fill_missing(df, step["values"])
            elif kind == "drop_missing":
                df = D.drop_missing(df, step.get("cols"))
            elif kind == "keep_subjects":
                df = D.keep_subjects(df, step["subjects"], step["key"], step.get("subjects_key"))
            elif kind == "exclude_subjects":
                df = D.exclude_subjects(df, step["subjects"], step["key"], step.get("subjects_key"))
            elif kind == "transform":
                df = step["fn"](df)
            else:
                raise ValueError(f"unknown step kind {kind!r}")
        return df

    if stage:
        result = staged_transform(records, build, roles, rows=rows, strict=strict, name="steps")
    else:
        result = guarded_transform(records, build, roles=roles, strict=strict, observe_rows=True)
    result.lineage = lineage
    return result
