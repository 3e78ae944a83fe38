from tideline.sources.datasets import (
    CLINICAL_DATASETS,
    DatasetError,
    DatasetSpec,
    append_run,
    list_datasets,
    load_dataset,
    load_table,
    normalize_nan,
    observe_shape,
    read_runs,
    read_table,
    register_datasets,
    require_nonempty,
    shape,
    write_report,
    write_result,
)

__all__ = [
    "CLINICAL_DATASETS",
    "DatasetError",
    "DatasetSpec",
    "list_datasets",
    "load_dataset",
    "load_table",
    "append_run",
    "normalize_nan",
    "observe_shape",
    "read_runs",
    "read_table",
    "register_datasets",
    "require_nonempty",
    "shape",
    "write_report",
    "write_result",
]
