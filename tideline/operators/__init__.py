"""DataFrame -> DataFrame operators; see each module for the plan they produce.

``derive`` and ``profile`` are both module and function names; the functions
are imported from their modules (``from tideline.operators.derive import derive``).
"""

from tideline.operators.checks import (
    axis_type,
    bar_type,
    check_list,
    column_types,
    missing_columns,
    require_columns,
    require_valid,
    roles_in_data,
    roles_specified,
    summarize,
    validate_all,
    validation_report,
)
from tideline.operators.derive import (
    addable_columns,
    bar_to_days,
    days_since_min,
    derived_columns,
    drop_missing,
    exclude_subjects,
    fill_missing,
    filter_rows,
    keep_subjects,
    lineage_frame,
    not_null,
    per_subject,
    plot_columns,
    require_subject_id,
    select_plot_columns,
)
from tideline.operators.layers import check_edit_contract, layer_changes
from tideline.operators.merge import (
    check_row_count,
    first_per_key,
    merge_subjects,
    merge_with_counts,
    orphan_markers,
    resolve_columns,
)
from tideline.operators.profile import (
    column_min,
    count_subjects,
    distinct_values,
    group_agg,
    preview,
    reconcile,
    rows_per_subject,
    sample_values,
    subject_counts,
)
from tideline.operators.skew import join_one_per_key
from tideline.operators.textjobs import (
    audit_references,
    classify_intent,
    conversation_log,
    extract_block,
    extract_fenced,
    extract_formulas,
    parse_status,
    references,
    screen_terms,
)
from tideline.operators.timeline import (
    assemble_layers,
    bar_conflicts,
    bar_groups,
    category_markers,
    check_timeline,
    lane_order,
    marker_legend,
    sort_by_bar,
    subject_bars,
    timepoint_markers,
)

__all__ = [name for name in dir() if not name.startswith("_") and name not in {
    "checks", "derive", "layers", "merge", "profile", "skew", "textjobs", "timeline"}]
