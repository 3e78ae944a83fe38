"""Scans and sinks.

Tables are read lazily; nothing here triggers a job except
:func:`require_nonempty` (one ``isEmpty`` probe, which stops at the first row)
and :func:`shape` (one count).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DatasetSpec:
    file: str
    description: str


# The named clinical datasets, their file names and descriptions.
CLINICAL_DATASETS: dict[str, DatasetSpec] = {
    "ADSL": DatasetSpec("ADSL.csv", "Subject-level data (baseline characteristics)"),
    "ADRS": DatasetSpec("ADRS_ONCO.csv", "Response data (tumor assessments over time)"),
    "ADTTE": DatasetSpec("ADTTE_ONCO.csv", "Time-to-event data (survival, progression)"),
    "ADTR": DatasetSpec("ADTR_ONCO.csv", "Tumor response data (target lesions)"),
}


class DatasetError(ValueError):
    """Unknown dataset name, missing file or empty table."""


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    lowered = path.lower().rstrip("/")
    for ext in ("csv", "parquet", "json", "orc"):
        if lowered.endswith("." + ext):
            return ext
    return "parquet"


def normalize_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float/double column (one projection, no job).

    pandas treats NaN and missing as one value; Spark keeps both, and ``max``
    would return NaN.  Normalising once at load keeps every later min/max,
    filter and null test on one meaning.
    """
    floats = {
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if not floats:
        return df
    return df.withColumns(
        {c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType)) for c in floats}
    )


TEXT_FORMATS = ("csv", "json")


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    null_values: str | None = None,
    normalize: bool | None = None,
) -> DataFrame:
    """Read one table lazily; CSV with a header.

    ``normalize`` turns NaN into NULL (:func:`normalize_nan`); by default it
    is applied to text formats, where a missing number arrives as ``NaN``
    text, and not to Parquet/ORC.  On typed columnar data a projection over
    every double column would hide the columns from filter pushdown (a
    filter on ``nanvl(x, NULL)`` is not pushed to the scan); call
    :func:`normalize_nan` explicitly when such data does hold NaN.

    Declare ``schema`` for CSV in production, or read it through
    :func:`tideline.sources.typed_csv.read_typed_csv`: Spark's inference loses
    leading zeros in identifiers.
    """
    kind = _format_of(path, fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True).option("encoding", "UTF-8")
        if schema is None:
            reader = reader.option("inferSchema", True)
        if null_values is not None:
            reader = reader.option("nullValue", null_values)
    df = reader.format(kind).load(path)
    if normalize is None:
        normalize = kind in TEXT_FORMATS
    return normalize_nan(df) if normalize else df


def load_dataset(
    spark: SparkSession,
    name: str,
    base: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    datasets: Mapping[str, DatasetSpec] = CLINICAL_DATASETS,
    null_values: str | None = None,
    normalize: bool | None = None,
) -> DataFrame:
    """Load a named dataset from ``base``; unknown names raise."""
    spec = datasets.get(name)
    if spec is None:
        raise DatasetError(f"Unknown dataset '{name}'. Available: {list(datasets)}")
    path = f"{base.rstrip('/')}/{spec.file}"
    try:
        return read_table(spark, path, fmt=fmt, schema=schema, null_values=null_values,
                          normalize=normalize)
    except AnalysisException as err:
        raise DatasetError(f"Cannot read dataset '{name}' at {path}: {err}") from err


def load_table(spark: SparkSession, base: str, name: str, normalize: bool = False) -> DataFrame:
    """Read ``{base}/{name}.parquet`` (the layout of the driver tables)."""
    return read_table(spark, f"{base.rstrip('/')}/{name}.parquet", fmt="parquet",
                      normalize=normalize)


def register_datasets(
    spark: SparkSession, base: str, names: list[str] | None = None,
    datasets: Mapping[str, DatasetSpec] = CLINICAL_DATASETS, **read_kw,
) -> dict[str, DataFrame]:
    """Load named datasets and register each as a temp view of the same name."""
    out = {}
    for name in names or list(datasets):
        df = load_dataset(spark, name, base, datasets=datasets, **read_kw)
        df.createOrReplaceTempView(name)
        out[name] = df
    return out


def list_datasets(
    spark: SparkSession, datasets: Mapping[str, DatasetSpec] = CLINICAL_DATASETS
) -> DataFrame:
    """Catalogue of name, description and file as a DataFrame."""
    rows = [(n, s.description, s.file) for n, s in datasets.items()]
    return spark.createDataFrame(rows, "name string, description string, file string")


def require_nonempty(df: DataFrame | None, name: str) -> DataFrame:
    """S3: raise when a table is missing or has no rows (stops at the first row)."""
    if df is None:
        raise DatasetError(f"{name} could not be loaded")
    if df.isEmpty():
        raise DatasetError(f"{name} is empty")
    return df


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns).  One counting job; columns come from the schema."""
    return df.count(), len(df.columns)


def observe_shape(df: DataFrame, name: str = "shape") -> tuple[DataFrame, Observation, int]:
    """S4 without an extra job: the row count rides on the next action.

    Returns the observed DataFrame, the Observation (``obs.get["rows"]`` after
    an action) and the column count.
    """
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs, len(df.columns)


def write_result(df: DataFrame, path: str, mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """Persist a processed table as Parquet for the next step."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


RUN_COLUMN = "run_id"


def append_run(df: DataFrame, path: str, run_id: str, fmt: str = "parquet") -> None:
    """Append one run's rows to a store, as often as it is retried.

    The store is partitioned by ``run_id``; writing a run replaces that run's
    partition and leaves all others alone, so a retry after a lost driver never
    doubles rows.  The partition appears when the write commits.  A run without
    rows leaves the store as it was.
    """
    if not run_id:
        raise ValueError("a run needs an id")
    (df.withColumn(RUN_COLUMN, F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(RUN_COLUMN).format(fmt).save(path))


def read_runs(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A store written by :func:`append_run`: ``schema`` (the rows' own) and ``run_id`` as text."""
    full = T.StructType([f for f in schema.fields if f.name != RUN_COLUMN] + [T.StructField(RUN_COLUMN, T.StringType())])
    return spark.read.schema(full).format(fmt).load(path)


def write_report(report: DataFrame, path: str, fmt: str = "json", run_id: str | None = None) -> None:
    """Append a validation report (one row per run) to a report store.

    With ``run_id`` the append is idempotent (:func:`append_run`); without one
    every call adds its rows.
    """
    if run_id is not None:
        append_run(report, path, run_id, fmt)
    else:
        report.write.mode("append").format(fmt).save(path)
