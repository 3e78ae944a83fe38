"""Timeline tables (G1-G7, W2, L1, U4): bars, markers, lanes, layers.

All per-subject work is keyed on the subject column, so a plan that merges,
derives and builds bars keeps one hash partitioning throughout.  Aggregates
are partial before their exchange, so a subject holding a third of all rows is
folded to one row per map task before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numbers import bar_label
from tideline.operators.merge import orphan_markers
from tideline.operators.skew import repeat_rows
from tideline.roles import Roles

BAR_LAYER = "bar"


def subject_bars(
    df: DataFrame,
    subject: str,
    bar: str,
    carry: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    count_records: bool = False,
) -> DataFrame:
    """G1 (+G5): one bar per subject, its length the smallest non-NULL ``bar``.

    This is what "sort by bar ascending, keep the first row per subject"
    computes.  ``carry`` columns (e.g. the arm for G5) come from the row holding
    that smallest bar, ties broken by ``tiebreak`` then by the carried values;
    the NULL flag leads the struct so a NULL bar never wins over a value.
    A subject whose bars are all NULL gets a NULL bar.  ``count_records`` adds
    ``n_records``, the subject's number of input rows.
    """
    fields = [F.col(bar).isNull().alias("_null"), F.col(bar).alias("_bar")]
    fields += [F.col(c).alias(f"_t{i}") for i, c in enumerate(tiebreak)]
    fields += [F.col(c).alias(f"_a{i}") for i, c in enumerate(carry)]
    aggs: list[Column] = [F.min(F.struct(*fields)).alias("_g1")]
    if count_records:
        aggs.append(F.count(F.lit(1)).alias("n_records"))
    out = df.groupBy(subject).agg(*aggs)
    cols = [F.col(subject), F.col("_g1._bar").alias(bar)]
    cols += [F.col(f"_g1._a{i}").alias(c) for i, c in enumerate(carry)]
    if count_records:
        cols.append(F.col("n_records"))
    return out.select(*cols)


def bar_groups(df: DataFrame, roles: Roles, attr: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Bars carrying a subject attribute (e.g. planned arm) for colouring."""
    return subject_bars(df, roles.subject, roles.bar, carry=[attr], tiebreak=tiebreak)


def sort_by_bar(df: DataFrame, bar: str, subject: str) -> DataFrame:
    """L1: ascending bar, NULL bars last, ties by subject (a total order)."""
    return df.orderBy(F.col(bar).asc_nulls_last(), F.col(subject).asc_nulls_last())


#: Most ranges that lane_order cuts the bars (and the subjects of one bar length) into.
LANE_RANGES = 1024


def lane_order(
    bars: DataFrame, subject: str, bar: str, name: str = "lane",
    num_partitions: int | None = None,
) -> DataFrame:
    """1-based lane of each subject: ascending bar (NULLs last), then subject (NULLs last).

    A global ``row_number()`` would pull every subject into one task.  Instead
    split points of the bars, and of the subjects, come from quantile sketches
    (one scalar subquery) and number each row's range in the lane order: the
    bars between two split points, or one split point's own bar length, which
    many subjects may share and which the subjects' split points therefore
    divide again.  A lane is the rows in all earlier ranges plus the rank inside
    the range.  Split points only balance the ranges; the order is exact
    whatever they are.  The running count goes over one row per range, at most
    about ``2 n + n ** 2`` whatever the table, with ``n`` split points:
    ``num_partitions``, or the session's shuffle partitions.  The plan is lazy and leaves no
    files; bars are computed once a branch unless Spark reuses their exchange.
    """
    n = num_partitions or int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / (n + 1) for i in range(1, min(n, LANE_RANGES) + 1)]
    keyed = bars.select("*", F.col(bar).cast("double").alias("_bar"),
                        _order_number(bars.schema[subject].dataType, F.col(subject)).alias("_subject"))
    splits = keyed.agg(F.struct(
        _split_points("_bar", shares).alias("bars"), _split_points("_subject", shares).alias("subjects"))).scalar()
    keyed = keyed.select("*", splits.alias("_splits"))  # a column first: no subquery may stand inside a lambda function
    # A range: how many split points lie below, and whether the value is one itself.
    below, own = _position(F.col("_splits.bars"), F.col("_bar"))
    last = F.lit(2 * len(shares) + 2)
    ranged = keyed.withColumn("_range", F.when(F.col("_bar").isNull(), last).otherwise(2 * below + own.cast("int")))
    part, _ = _position(F.col("_splits.subjects"), F.col("_subject"))
    shared = F.col("_bar").isNull() | (F.col("_range") % 2 == 1)
    ranged = ranged.withColumn("_part", F.when(shared, F.when(F.col("_subject").isNull(), F.lit(len(shares) + 1)).otherwise(part)).otherwise(F.lit(0)))

    counts = ranged.groupBy("_range", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_r"), F.col("_part").alias("_p"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", "_part").orderBy(F.col(bar).asc_nulls_last(), F.col(subject).asc_nulls_last())
    ranked = ranged.withColumn("_rank", F.row_number().over(inside))
    placed = ranked.join(offsets, (F.col("_range") == F.col("_r")) & (F.col("_part") == F.col("_p")))
    return placed.select(*[F.col(f"`{c}`") for c in bars.columns], (F.col("_before") + F.col("_rank")).alias(name))


def _order_number(kind: T.DataType, c: Column) -> Column:
    """A double that never falls as ``c`` rises; 0 for types without such a number."""
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return F.when(c.isNotNull(), F.lit(0.0))


def _split_points(col: str, shares: list[float]) -> Column:
    """Distinct split points of a column in chunks, each an array; empty without values."""
    points = F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx(col, shares, 20 * LANE_RANGES), F.array().cast("array<double>"))))
    size = max(1, math.isqrt(len(shares)))
    firsts = F.sequence(F.lit(0), F.greatest(F.size(points) - 1, F.lit(0)), F.lit(size))
    return F.transform(firsts, lambda i: F.slice(points, i + 1, F.lit(size)))


def _position(chunks: Column, value: Column) -> tuple[Column, Column]:
    """Split points below a value, and whether it is one; only one chunk is searched."""
    whole = F.filter(chunks, lambda c: F.coalesce(F.array_max(c) < value, F.lit(False)))
    chunk = F.coalesce(F.get(chunks, F.size(whole)), F.array().cast("array<double>"))
    below = F.aggregate(whole, F.lit(0), lambda a, c: a + F.size(c)) + F.size(F.filter(chunk, lambda x: x < value))
    return below, F.array_contains(chunk, value)


def timepoint_markers(df: DataFrame, subject: str, var: str, layer: str | None = None) -> DataFrame:
    """The variable is itself a day: one marker per non-NULL value at x=var."""
    return df.filter(F.col(var).isNotNull()).select(
        F.col(subject),
        F.col(var).cast("double").alias("x"),
        F.lit(layer or var).alias("layer"),
    )


def category_markers(
    df: DataFrame, subject: str, x: str, var: str, layer: str | None = None
) -> DataFrame:
    """Markers at the time column ``x``, grouped by the category ``var``."""
    return df.filter(F.col(var).isNotNull()).select(
        F.col(subject),
        F.col(x).cast("double").alias("x"),
        F.col(var).cast("string").alias("category"),
        F.lit(layer or var).alias("layer"),
    )


def marker_legend(markers: DataFrame) -> DataFrame:
    """One legend entry per (layer, category) with its marker count."""
    cat = F.col("category") if "category" in markers.columns else F.lit(None).cast("string")
    return (
        markers.withColumn("category", cat)
        .groupBy("layer", "category")
        .agg(F.count(F.lit(1)).alias("n_markers"))
    )


def bar_conflicts(df: DataFrame, subject: str, bar: str) -> DataFrame:
    """Subjects whose bar value is not constant (G1 silently keeps the smallest)."""
    return (
        df.groupBy(subject)
        .agg(
            F.min(bar).alias("min_bar"),
            F.max(bar).alias("max_bar"),
            F.count_distinct(bar).alias("n_values"),
        )
        .filter(F.col("min_bar") != F.col("max_bar"))
    )


def assemble_layers(
    bars: DataFrame, subject: str, bar: str, *markers: DataFrame,
    plot_id: str | None = None, version: int | None = None,
) -> DataFrame:
    """U4: the figure as data: the bar layer, then each marker layer.

    Columns: ``[plot_id, version,] layer, subject, x, category, label``; the
    subject is cast to string so layers with different key types line up.
    """
    bar_rows = bars.select(
        F.lit(BAR_LAYER).alias("layer"),
        F.col(subject).cast("string").alias("subject"),
        F.col(bar).cast("double").alias("x"),
        F.lit(None).cast("string").alias("category"),
        bar_label(F.col(bar)).alias("label"),
    )
    out = bar_rows
    for m in markers:
        cat = F.col("category") if "category" in m.columns else F.lit(None).cast("string")
        out = out.unionByName(
            m.select(
                F.col("layer"),
                F.col(m.columns[0]).cast("string").alias("subject"),
                F.col("x").cast("double"),
                cat.alias("category"),
                F.lit(None).cast("string").alias("label"),
            )
        )
    if version is not None:
        out = out.select(F.lit(version).alias("version"), "*")
    if plot_id is not None:
        out = out.select(F.lit(plot_id).alias("plot_id"), "*")
    return out


def record_layers(
    df: DataFrame, subject: str, x: str, category: str, layer: str | None = None,
) -> DataFrame:
    """U4 from one pass over the records: the bar layer and one category marker layer.

    Equal to ``assemble_layers(subject_bars(df, subject, x), subject, x,
    category_markers(df, subject, x, category, layer))``, but the records are
    read, merged and shuffled once: equal markers fold to one counted row per
    (subject, x, category) in each map task, the subject's first row in bar
    order also carries its bar, and the counted rows are written out at the end
    (:func:`tideline.operators.skew.repeat_rows`).  A hot subject holds one row
    per distinct (x, category), not one per record.
    """
    folded = df.groupBy(F.col(subject).cast("string").alias("subject"), F.col(x).alias("_x"),
                        F.col(category).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("subject").orderBy(F.col("_x").asc_nulls_last(), F.col("category").asc_nulls_last())
    placed = folded.withColumn("_first", F.row_number().over(order) == 1)
    none = F.lit(None).cast("string")
    position = F.col("_x").cast("double").alias("x")
    bar = F.struct(F.lit(BAR_LAYER).alias("layer"), "subject", position, none.alias("category"), bar_label(F.col("_x")).alias("label"),
                   F.col("_first").cast("long").alias("_times"))
    marker = F.struct(F.lit(layer or category).alias("layer"), "subject", position, "category", none.alias("label"),
                      F.when(F.col("category").isNotNull(), F.col("_n")).otherwise(0).alias("_times"))
    return repeat_rows(placed.select(F.inline(F.array(bar, marker))), "_times")


def check_timeline(
    bars: DataFrame, markers: DataFrame | None, subject: str, x_type: str | None = None,
    marker_subject: str | None = None,
) -> DataFrame:
    """Soundness of a timeline as rows ``(check, passed, detail)``.

    One bar per subject, bars present, every marker on a subject that has a
    bar, and (when given) an X type that is linear.  The counts come from two
    scalar subqueries, one aggregate over the bars (a struct, referenced once,
    so the bars are aggregated once) and one anti join for the markers; Spark
    runs them concurrently and folds them into one small result row, no
    collects.
    """
    spark = bars.sparkSession
    per_subject = bars.groupBy(subject).agg(F.count(F.lit(1)).alias("_n"))
    bar_stats = per_subject.agg(
        F.struct(
            F.count_if(F.col("_n") > 1).alias("dup"),
            F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_bars"),
        )
    ).scalar()
    if markers is not None:
        orphans = orphan_markers(markers, bars, (marker_subject or subject, subject))
        n_orphans = orphans.agg(F.count(F.lit(1))).scalar()
    else:
        n_orphans = F.lit(0).cast("long")
    row = spark.range(1).select(bar_stats.alias("_st"), n_orphans.alias("orphans")).select(
        F.col("_st.dup").alias("dup"), F.col("_st.n_bars").alias("n_bars"), "orphans"
    )
    checks = [
        ("one bar per subject", F.col("dup") == 0,
         F.concat(F.col("dup").cast("string"), F.lit(" subjects with several bars"))),
        ("bars present", F.col("n_bars") > 0,
         F.concat(F.col("n_bars").cast("string"), F.lit(" bars"))),
        ("markers reference bar subjects", F.col("orphans") == 0,
         F.concat(F.col("orphans").cast("string"), F.lit(" orphan markers"))),
    ]
    if x_type is not None:
        linear = x_type in ("datetime", "numeric", "date_string", "numeric_string")
        checks.append(("x axis is linear", F.lit(linear), F.lit(f"type: {x_type}")))
    rows = F.array(*[
        F.struct(F.lit(n).alias("check"), ok.alias("passed"), d.alias("detail"))
        for n, ok, d in checks
    ])
    return row.select(F.inline(rows))
