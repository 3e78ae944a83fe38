"""S1, typed CSV: types from the whole file, identifiers kept as text, bad rows kept aside.

Spark's own inference turns ``007`` into 7 and, row by row, drops or nulls what
does not fit.  Here the file is read as text; one aggregate over all of it
decides each column's type (the probe that V3 uses); and rows that do not fit,
by their number of fields or by a declared type, go to a second table instead of
disappearing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.dates import to_timestamp_lenient
from tideline.functions.numbers import to_number
from tideline.sources.datasets import CLINICAL_DATASETS, DatasetError, DatasetSpec
from tideline.sources.staging import StagedTable, stage_table

RAW = "_raw_row"
#: Whole numbers that a long holds, whatever their digits.
WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
#: A number written with zeros in front: an identifier, not a quantity.
PADDED = r"^\s*[+-]?0\d"


@dataclass
class TypedTable:
    df: DataFrame                # rows that fit, typed
    rejects: DataFrame           # raw_row, column_name, value, reason of those that do not
    types: dict[str, str]
    staged: StagedTable          # the text rows both are read from; drop it when neither is needed any more


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a CSV file or folder, by Spark's own reader."""
    return spark.read.option("header", True).option("sep", sep).option("enforceSchema", False).csv(path).columns


def read_typed_csv(
    spark: SparkSession, path: str, types: Mapping[str, str] | None = None, text: Sequence[str] = (),
    sep: str = ",", null_values: str | None = None, multi_line: bool = False,
) -> TypedTable:
    """Read a CSV with a header; every row ends up in ``df`` or in ``rejects``.

    ``types`` declares Spark types for some columns; the others get the
    narrowest of ``bigint``, ``double``, ``timestamp`` and ``string`` that every
    value of the whole column fits.  Columns in ``text``, columns holding a
    number padded with zeros, and columns without a value stay ``string``.

    A row with more or fewer fields than the header is rejected whole
    (``column_name`` NULL, reason ``fields``).  A value that does not fit its
    declared type rejects its row, one reject row per such value (reason: the
    type).  Empty fields are NULL, blank lines no rows.  An empty file gives no rows
    and all strings.  ``multi_line`` allows line breaks inside quoted values; a
    file is then read by one task.
    """
    types = {c: t.lower() for c, t in (types or {}).items()}
    names = header_of(spark, path, sep)
    if unknown := [c for c in (*types, *text) if c not in names]:
        raise DatasetError(f"no such columns in {path}: {unknown}")
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField(RAW, T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", "UTF-8")
    reader = reader.option("multiLine", multi_line)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
    if null_values is not None:
        reader = reader.option("nullValue", null_values)
    # All fields are parsed, so that a wrong number of them shows whatever columns are read later.
    staged = stage_table(reader.option("columnPruning", False).csv(path), "csv")
    raw = staged.df
    sound = raw.filter(F.col(RAW).isNull())

    found = _inferred(sound, [c for c in names if c not in types and c not in text])
    kinds = {c: types.get(c, found.get(c, "string")) for c in names}
    typed = {c: _typed(F.col(f"`{c}`"), kinds[c]) for c in names}
    wrong = {c: F.col(f"`{c}`").isNotNull() & typed[c].isNull() for c in types}
    misfit = F.lit(False)
    for w in wrong.values():
        misfit = misfit | w
    df = sound.filter(~misfit).select(*[typed[c].alias(c) for c in names])

    none = F.lit(None).cast("string")
    whole = raw.filter(F.col(RAW).isNotNull()).select(*[F.col(f"`{c}`") for c in names], F.col(RAW)).select(
        F.col(RAW).alias("raw_row"), none.alias("column_name"), none.alias("value"), F.lit("fields").alias("reason"))
    rejects = whole
    if types:
        line = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names])
        values = F.filter(F.array(*[F.when(w, F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value"), F.lit(types[c]).alias("reason")))
                                    for c, w in wrong.items()]), lambda x: x.isNotNull())
        rejects = whole.unionAll(sound.filter(misfit).select(line.alias("raw_row"), F.inline(values)))
    return TypedTable(df, rejects, kinds, staged)


def load_typed_dataset(
    spark: SparkSession, name: str, base: str, datasets: Mapping[str, DatasetSpec] = CLINICAL_DATASETS, **how,
) -> TypedTable:
    """A named dataset from ``base`` through :func:`read_typed_csv`; unknown names and unreadable files raise."""
    spec = datasets.get(name)
    if spec is None:
        raise DatasetError(f"Unknown dataset '{name}'. Available: {list(datasets)}")
    path = f"{base.rstrip('/')}/{spec.file}"
    try:
        return read_typed_csv(spark, path, **how)
    except AnalysisException as err:
        raise DatasetError(f"Cannot read dataset '{name}' at {path}: {err}") from err


def _typed(c: Column, kind: str) -> Column:
    """A text column as ``kind``; NULL where it does not fit."""
    if kind == "string":
        return c
    if kind == "timestamp":
        return to_timestamp_lenient(c)
    if kind == "date":
        return to_timestamp_lenient(c).cast("date")
    if kind == "double":
        return to_number(c)
    return F.trim(c).try_cast(kind)


def _inferred(rows: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """The type of each text column, from counts over all its values in one job."""
    if not cols:
        return {}
    aggs = []
    for i, name in enumerate(cols):
        c = F.col(f"`{name}`")
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.rlike(WHOLE)).alias(f"w{i}"), F.count_if(c.rlike(PADDED)).alias(f"p{i}"),
                 F.count(to_number(c)).alias(f"d{i}"), F.count(to_timestamp_lenient(c)).alias(f"t{i}")]
    seen = rows.agg(*aggs).first()
    out = {}
    for i, name in enumerate(cols):
        n, whole, padded, number, time = (seen[f"{k}{i}"] for k in "nwpdt")
        if n == 0:
            out[name] = "string"
        elif time == n and whole < n:
            out[name] = "timestamp"
        elif padded:
            out[name] = "string"
        else:
            out[name] = "bigint" if whole == n else "double" if number == n else "string"
    return out
