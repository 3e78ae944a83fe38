"""Registered queries over the driver tables and their DuckDB oracle SQL.

Each query maps the timeline roles onto the TPC-H-like tables:

* subjects = ``orders`` (key ``o_orderkey``, reference date ``o_orderdate``,
  arm ``o_orderpriority``); records = ``lineitem`` (``l_orderkey``, time
  ``l_shipdate``, category ``l_returnflag``); day = floor(ship - order) + 1;
* second pairing: records ``orders`` onto subjects ``customer``;
* sub-day times: ``events`` by ``user_id``.

Every query reads whole tables; nothing is sampled or capped except where a
limit is the feature (top-k previews).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import (
    bar_label,
    day_diff,
    elapsed_days,
    interval_days,
    shift_days,
    to_number,
    to_timestamp_lenient,
)
from tideline.operators import checks as V
from tideline.operators import derive as D
from tideline.operators import layers as U
from tideline.operators import merge as M
from tideline.operators import profile as P
from tideline.operators import textjobs as X
from tideline.operators import timeline as G
from tideline.plans.bars import record_bars, record_conflicts
from tideline.plans.steps import apply_steps, staged_transform
from tideline.roles import Roles
from tideline.sources import DatasetSpec, load_table, read_runs, shape, write_report
from tideline.sources.staging import shared_dir, stage_table
from tideline.sources.typed_csv import load_typed_dataset

Query = Callable[[SparkSession, str], DataFrame]

ITEM_KEY = ("l_orderkey", "o_orderkey")
CUST_KEY = ("o_custkey", "c_custkey")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return load_table(spark, d, name)


# Subject columns the lineitem/orders queries use.  Naming them keeps the
# orders scan to these columns: the de-dup reads every column it carries.
ITEM_SUBJECT_COLS = ["o_orderdate", "o_orderpriority"]


def merged_items(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with its order merged on, plus the study day of shipment."""
    m = M.merge_subjects(_t(spark, d, "lineitem"), _t(spark, d, "orders"), ITEM_KEY,
                         cols=ITEM_SUBJECT_COLS)
    return m.withColumn("ship_day", day_diff("o_orderdate", "l_shipdate", inclusive=True))


def item_bars(spark: SparkSession, d: str) -> DataFrame:
    return record_bars(
        _t(spark, d, "lineitem"), _t(spark, d, "orders"), ITEM_KEY,
        reference="o_orderdate", time="l_shipdate", attrs=["o_orderpriority"],
    )


# ---------------------------------------------------------------- timeline core

def q_subject_bars(spark, d):
    return item_bars(spark, d)


def q_merge_subjects(spark, d):
    return M.merge_subjects(_t(spark, d, "orders"), _t(spark, d, "customer"), CUST_KEY)


def q_merge_row_count(spark, d):
    orders = _t(spark, d, "orders")
    merged = M.merge_subjects(orders, _t(spark, d, "customer"), CUST_KEY)
    return P.reconcile(orders, merged)


def q_first_per_key(spark, d):
    return M.first_per_key(_t(spark, d, "events"), "user_id", order=["ts", "event_id"])


def q_day_diff_floor(spark, d):
    m = M.merge_subjects(_t(spark, d, "lineitem"), _t(spark, d, "orders"), ITEM_KEY,
                         cols=["o_orderdate"])
    return m.select(
        "l_orderkey", "l_linenumber",
        day_diff("o_orderdate", "l_shipdate").alias("day_floor"),
        day_diff("o_orderdate", "l_shipdate", inclusive=True).alias("day_incl"),
    )


def q_elapsed_days(spark, d):
    m = M.merge_subjects(_t(spark, d, "lineitem"), _t(spark, d, "orders"), ITEM_KEY,
                         cols=["o_orderdate"])
    return m.select(
        "l_orderkey", "l_linenumber",
        elapsed_days("o_orderdate", "l_shipdate").alias("elapsed_days"),
    )


def q_days_since_min(spark, d):
    ev = _t(spark, d, "events")
    return D.days_since_min(ev, "ts").select("event_id", "user_id", "days_since_min")


def q_days_since_first(spark, d):
    ev = _t(spark, d, "events")
    out = D.days_since_min(ev, "ts", by="user_id", inclusive=True, name="days_since_first")
    return out.select("event_id", "user_id", "days_since_first")


def q_shift_days(spark, d):
    o = _t(spark, d, "orders")
    return o.select(
        "o_orderkey",
        shift_days("o_orderdate", 30).alias("plus_30"),
        shift_days("o_orderdate", -7).alias("minus_7"),
    )


def q_to_number(spark, d):
    ev = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return ev.select(
        "event_id",
        k.alias("k_text"),
        to_number(k).alias("k_num"),
        to_number(bar_label(k)).alias("k_label_num"),
        to_number("event_type").alias("type_num"),
    )


def q_fill_drop(spark, d):
    o = _t(spark, d, "orders")
    o, _ = D.derive(o, {
        "open_status": "CASE WHEN o_orderstatus = 'O' THEN o_orderstatus END",
        "big_price": "CASE WHEN o_totalprice > 100000 THEN o_totalprice END",
    })
    o = D.fill_missing(o, {"open_status": "closed"})
    o = D.drop_missing(o, ["big_price"])
    return o.select("o_orderkey", "open_status", "big_price")


def q_bar_label(spark, d):
    m = merged_items(spark, d)
    return m.select("l_orderkey", "l_linenumber", bar_label("ship_day").alias("bar_label"))


def q_select_plot_columns(spark, d):
    orders = _t(spark, d, "orders")
    merged = M.merge_subjects(orders, _t(spark, d, "customer"), CUST_KEY)
    roles = Roles(subject="o_custkey", x="o_orderdate", bar="o_totalprice",
                  keep=("o_orderstatus", "o_custkey"))
    return D.select_plot_columns(merged, roles, orders.columns)


def q_filter_rows(spark, d):
    ev = D.filter_rows(_t(spark, d, "events"), "event_type = 'click' AND value > 10")
    return D.not_null(ev, "value")


def q_keep_subjects(spark, d):
    return D.keep_subjects(_t(spark, d, "orders"), _t(spark, d, "lineitem"),
                           "o_orderkey", "l_orderkey")


def q_exclude_subjects(spark, d):
    return D.exclude_subjects(_t(spark, d, "orders"), _t(spark, d, "lineitem"),
                              "o_orderkey", "l_orderkey")


def q_subject_counts(spark, d):
    return P.subject_counts(_t(spark, d, "events"), "user_id")


def q_group_agg(spark, d):
    """Per arm, from one row per subject: the distinct subjects need no expansion of the rows."""
    per = P.group_agg(merged_items(spark, d), ["l_orderkey", "o_orderpriority"], {
        "n": F.count(F.lit(1)), "lo": F.min("ship_day"), "hi": F.max("ship_day"), "total": F.sum("ship_day"),
    })
    return P.group_agg(per, "o_orderpriority", {
        "n_rows": F.sum("n"),
        "n_subjects": F.count("l_orderkey"),
        "min_day": F.min("lo"),
        "max_day": F.max("hi"),
        "sum_day": F.sum("total"),
    })


def q_lane_order(spark, d):
    return G.lane_order(item_bars(spark, d), "l_orderkey", "bar_days")


def q_timepoint_markers(spark, d):
    return G.timepoint_markers(merged_items(spark, d), "l_orderkey", "ship_day")


def item_category_markers(spark, d):
    return G.category_markers(merged_items(spark, d), "l_orderkey", "ship_day", "l_returnflag")


def q_category_markers(spark, d):
    return item_category_markers(spark, d)


def q_marker_legend(spark, d):
    return G.marker_legend(item_category_markers(spark, d))


def q_layers(spark, d):
    return G.record_layers(merged_items(spark, d), "l_orderkey", "ship_day", "l_returnflag")


def q_orphan_markers(spark, d):
    o = _t(spark, d, "orders").withColumn(
        "order_day", day_diff("o_orderdate", "o_orderdate", inclusive=True))
    markers = G.category_markers(o, "o_orderkey", "order_day", "o_orderstatus")
    return M.orphan_markers(markers, item_bars(spark, d), ("o_orderkey", "l_orderkey"))


def q_bar_conflicts(spark, d):
    return record_conflicts(_t(spark, d, "lineitem"), _t(spark, d, "orders"), ITEM_KEY, "o_orderdate", "l_shipdate")


def q_distinct_values(spark, d):
    return P.distinct_values(_t(spark, d, "part"), "p_brand")


def q_sample_values(spark, d):
    return P.sample_values(_t(spark, d, "customer"))


def q_profile(spark, d):
    return P.profile(_t(spark, d, "customer"), exact=True)


def typed_orders(spark, d):
    """orders with text versions of a date and a price, for the type probes."""
    o = _t(spark, d, "orders")
    return o.select(
        "o_orderkey", "o_orderdate",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date_text"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("order_date_compact"),
        F.col("o_totalprice").cast("string").alias("price_text"),
        "o_orderstatus",
        F.concat(F.col("o_orderkey").cast("string"), F.lit("d")).alias("key_label"),
    )


def q_axis_types(spark, d):
    return V.column_types(typed_orders(spark, d))


def q_validate_timeline(spark, d):
    roles = Roles(subject="o_orderkey", x="order_date_text", bar="price_text")
    return V.validate_all(typed_orders(spark, d), roles,
                          graph_request="Please subset by region and add a title")


def q_check_timeline(spark, d):
    return G.check_timeline(item_bars(spark, d), item_category_markers(spark, d), "l_orderkey")


# Terms present in the driver documents (licence lines, secrets, prose).
DOCUMENT_TERMS = ("license", "token", "without", "password", "secret")


def q_screen_terms(spark, d):
    docs = X.screen_terms(_t(spark, d, "documents"), "text", DOCUMENT_TERMS)
    return docs.select("doc_id", "issues", "valid")


def q_screen_requests(spark, d):
    conv = _t(spark, d, "conversations").filter(F.col("role") == "user")
    out = X.screen_terms(conv, "text", X.PLOT_TERMS)
    return out.select("conv_id", "turn", "issues", "valid")


def q_classify_intent(spark, d):
    docs = X.classify_intent(_t(spark, d, "documents"), "text")
    return docs.select("doc_id", "intent")


def q_extract_block(spark, d):
    pages = X.extract_block(_t(spark, d, "pages"), "html", "<title>", "</title>",
                            fallback_open=None, name="title")
    return pages.select("page_id", "title")


# Alphabetic URL tokens: host labels, path segments and query keys.
URL_TOKEN = r"[/.?&=]([A-Za-z][A-Za-z_-]*)"


def q_audit_references(spark, d):
    langs = _t(spark, d, "documents").select(F.col("lang").alias("name"))
    return X.audit_references(_t(spark, d, "pages"), ["page_id"], "url", langs,
                              pattern=URL_TOKEN)


def q_conversation_log(spark, d):
    return X.conversation_log(_t(spark, d, "conversations"))


def _event_layers(spark, d, first_half):
    """A figure version per user: the event types seen in one half of the month."""
    day = F.dayofmonth("ts")
    ev = _t(spark, d, "events").filter(day <= 15 if first_half else day > 15)
    return ev.select(F.col("user_id").alias("plot_id"), F.col("event_type").alias("layer"))


def layer_diff(spark, d):
    return U.layer_changes(_event_layers(spark, d, True), _event_layers(spark, d, False))


def q_layer_changes(spark, d):
    return layer_diff(spark, d)


def q_edit_contract(spark, d):
    out = U.check_edit_contract(layer_diff(spark, d))
    return out.select("plot_id", "n_added", "n_removed", "add_ok", "remove_ok")


def q_edit_requests(spark, d):
    """Every user's edit judged by its own category; the ``purchase`` layer is protected."""
    users = _t(spark, d, "events").select(F.col("user_id").alias("plot_id")).distinct()
    third = F.pmod("plot_id", F.lit(3))
    requests = users.withColumn("category", F.when(third == 0, "add_overlay").when(third == 1, "remove_overlay")
                                .otherwise("axes"))
    return U.check_edit_contract(layer_diff(spark, d), requests=requests, protected=["purchase"])


def q_hot_merge(spark, d):
    """J1 with one order that the query itself gives a third of all items, and NULL keys beside it."""
    part = F.pmod(F.col("l_partkey"), F.lit(9))
    key = F.when(part < 3, F.lit(0).cast("long")).when(part > 3, F.col("l_orderkey"))
    items = _t(spark, d, "lineitem").withColumn("l_orderkey", key)
    m = M.merge_subjects(items, _t(spark, d, "orders"), ITEM_KEY, cols=ITEM_SUBJECT_COLS)
    return m.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_orderdate", "o_orderpriority")


def q_merge_matches(spark, d):
    """Records before and after the merge and those that found a subject, per order status.

    Only customers in credit are subjects, so some orders find none.
    """
    credit = D.filter_rows(_t(spark, d, "customer"), "c_acctbal > 0")
    merged = M.merge_subjects(_t(spark, d, "orders"), credit, CUST_KEY, cols=["c_mktsegment"])
    return P.group_agg(merged, "o_orderstatus", {
        "n_records": F.count(F.lit(1)),
        "n_matched": F.count("c_mktsegment"),
        "n_unmatched": F.count_if(F.col("c_mktsegment").isNull()),
    })


def q_merge_clash(spark, d):
    """A customer column that bears the name of an orders column."""
    cust = _t(spark, d, "customer").withColumnRenamed("c_mktsegment", "o_orderstatus")
    return M.merge_subjects(_t(spark, d, "orders"), cust, CUST_KEY, cols=["o_orderstatus"])


def q_check_timeline_defects(spark, d):
    """G6 on an unsound timeline: a bar per order and return flag, a marker per order."""
    bars = G.subject_bars(merged_items(spark, d).filter("l_returnflag <> 'N'").withColumn(
        "item", F.struct("l_orderkey", "l_returnflag")), "item", "ship_day")
    bars = bars.select("item.l_orderkey", "ship_day")
    orders = _t(spark, d, "orders")
    markers = G.category_markers(orders.withColumn("day", F.lit(1)), "o_orderkey", "day", "o_orderstatus")
    return G.check_timeline(bars, markers, "l_orderkey", marker_subject="o_orderkey")


def q_sort_by_bar(spark, d):
    return G.sort_by_bar(item_bars(spark, d), "bar_days", "l_orderkey")


def q_sorted_places(spark, d):
    """L1 with its order: each bar's place in the sorted output, numbered from what the sort wrote."""
    ordered = G.sort_by_bar(item_bars(spark, d), "bar_days", "l_orderkey")
    written = stage_table(ordered.select("l_orderkey", "bar_days", F.monotonically_increasing_id().alias("at")), "sorted").df
    return G.lane_order(written, "l_orderkey", "at", name="place").drop("at")


def q_column_min(spark, d):
    return P.column_min(_t(spark, d, "orders"), "o_orderdate")


def q_check_list(spark, d):
    """V6 over the whole-column checks of V5."""
    return V.check_list(q_validate_timeline(spark, d))


def q_validation_report(spark, d):
    """V9: shapes, first rows and roles of the merged items after a filter."""
    def positive(items):
        return items.filter("ship_day > 0").select("l_orderkey", "l_linenumber", "ship_day")

    out = V.transform_report(merged_items(spark, d), positive, Roles(subject="l_orderkey", x="ship_day", bar="ship_day"),
                             order=["ship_day", "l_orderkey", "l_linenumber"])
    return out.select(F.col("original_shape.rows").alias("rows_before"), F.col("processed_shape.rows").alias("rows_after"),
                      F.array_join("first_rows", ";").alias("first_rows"), F.array_join("columns", ",").alias("columns"))


def q_parse_status(spark, d):
    """X3 on a reply built from every event."""
    key = (F.when(F.col("event_type") == "click", "Already_Overlaid").when(F.col("event_type") == "error", "WRONG_CATEGORY")
           .otherwise(F.upper("event_type")))
    reply = F.concat(F.lit("\n # "), key, F.lit(": user "), F.col("user_id").cast("string"), F.lit(" \nmore"))
    ev = _t(spark, d, "events").withColumn("reply", reply)
    return X.parse_status(ev, "reply").select("event_id", "status", "detail")


def q_extract_formulas(spark, d):
    """X7 on captured output built from every event."""
    out = F.concat(F.lit("start\nDERIVED: "), F.col("event_type"), F.lit("_day = floor(x) = "),
                   F.col("user_id").cast("string"), F.lit("\nDERIVED: nothing\n derived: a = b"))
    return X.extract_formulas(_t(spark, d, "events").withColumn("out", out), ["event_id"], "out")


def q_intent_category(spark, d):
    """X2 with a request category per document."""
    docs = _t(spark, d, "documents").withColumn(
        "category", F.when(F.col("doc_id") % 2 == 0, "add_overlay").otherwise("remove_overlay"))
    return X.classify_intent(docs, "text", category="category").select("doc_id", "intent", "wrong_category")


def q_audit_verdicts(spark, d):
    """X5 as a verdict per page; only add requests are audited."""
    pages = _t(spark, d, "pages").withColumn(
        "category", F.when(F.col("page_id") % 2 == 0, "add_overlay").otherwise("axes"))
    langs = _t(spark, d, "documents").select(F.col("lang").alias("name"))
    return X.audit_verdicts(pages, ["page_id"], "url", langs, pattern=URL_TOKEN, category="category")


def q_apply_steps(spark, d):
    steps = [
        {"kind": "merge", "key": ITEM_KEY},
        {"kind": "derive", "name": "ship_day",
         "expr": "(timestampdiff(MICROSECOND, o_orderdate, l_shipdate)"
                 " - pmod(timestampdiff(MICROSECOND, o_orderdate, l_shipdate), 86400000000L)) div 86400000000L + 1"},
        {"kind": "filter", "predicate": "ship_day > 0"},
        {"kind": "drop_missing", "cols": ["o_orderpriority"]},
    ]
    result = apply_steps(_t(spark, d, "lineitem"), steps, subjects=_t(spark, d, "orders"),
                         roles=Roles(subject="l_orderkey", x="ship_day", bar="ship_day"),
                         strict=True)
    return result.df


def q_last_event(spark, d):
    """W1 by the window route: each user's latest event (descending order)."""
    return M.first_per_key(_t(spark, d, "events"), "user_id", order=[("ts", "desc"), "event_id"])


def q_customer_bars(spark, d):
    """Second pairing: orders onto customers; bar = days from a customer's first
    to last order (+1), arm = market segment (G5)."""
    spans = P.group_agg(_t(spark, d, "orders"), "o_custkey", {
        "_first": F.min("o_orderdate"), "_last": F.max("o_orderdate"), "n_records": F.count(F.lit(1))})
    spans = M.merge_subjects(spans, _t(spark, d, "customer"), CUST_KEY, cols=["c_mktsegment"], split_hot=False)
    spans = spans.withColumn("span_days", day_diff("_first", "_last", inclusive=True))
    return G.subject_bars(spans, "o_custkey", "span_days", carry=["c_mktsegment", "n_records"])


def q_top_orders(spark, d):
    """L2: the five largest orders (ties by key)."""
    return P.preview(_t(spark, d, "orders"), 5, [F.col("o_totalprice").desc(), "o_orderkey"])


def q_parse_dates(spark, d):
    """Order dates written in three layouts, parsed back."""
    o = _t(spark, d, "orders")
    texts = o.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_text"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("compact_text"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_text"),
    )
    return texts.select(
        "o_orderkey",
        to_timestamp_lenient("iso_text").cast("timestamp_ntz").alias("from_iso"),
        to_timestamp_lenient("compact_text").cast("timestamp_ntz").alias("from_compact"),
        to_timestamp_lenient("us_text").cast("timestamp_ntz").alias("from_us"),
    )


def q_bar_to_days(spark, d):
    """Order dates as study days from a fixed reference date."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    ref = F.lit("1992-01-01 00:00:00").cast("timestamp_ntz")
    return D.bar_to_days(o, "o_orderdate", ref, inclusive=True, name="order_day")


def q_interval_days(spark, d):
    """Whole days of the interval ship - order, floored."""
    m = M.merge_subjects(_t(spark, d, "lineitem"), _t(spark, d, "orders"), ITEM_KEY,
                         cols=["o_orderdate"])
    return m.select("l_orderkey", "l_linenumber",
                    interval_days(F.col("l_shipdate") - F.col("o_orderdate")).alias("interval_days"))


def q_merge_contract(spark, d):
    """Items merged onto their orders (kept), and customers onto their orders without de-duplication (multiplied)."""
    items = M.merge_contract(_t(spark, d, "lineitem"), _t(spark, d, "orders"), ITEM_KEY, by="l_returnflag", cols=ITEM_SUBJECT_COLS)
    customers = M.merge_contract(_t(spark, d, "customer"), _t(spark, d, "orders"), ("c_custkey", "o_custkey"),
                                 by="c_mktsegment", cols=["o_orderpriority"], dedup=False)
    named = [items.withColumnRenamed("l_returnflag", "arm").withColumn("merge", F.lit("items")),
             customers.withColumnRenamed("c_mktsegment", "arm").withColumn("merge", F.lit("customers"))]
    return named[0].unionByName(named[1])


def q_report_store(spark, d):
    """The shape of two tables, one report written twice under its id, read back from the store."""
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    runs = {"items": _t(spark, d, "lineitem"), "orders": _t(spark, d, "orders")}
    for run in ("items", "orders", "items"):
        report = spark.createDataFrame([shape(runs[run])], "n_rows long, n_columns long")
        write_report(report, path, run_id=run)
    return read_runs(spark, path, report.schema, "json")


def q_sketch_profile(spark, d):
    """A profile of events from one stored sketch a day; exact counts of the keys beside it."""
    ev = _t(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    stored = stage_table(P.column_sketches(ev, by="day"), "sketches").df
    keys = {"event_id", "user_id"}
    exact = {c: ev.agg(F.count_distinct(c)).scalar() for c in sorted(keys)}
    found = P.merged_profile(stored)
    n = F.lit(None).cast("long")
    for c, count in exact.items():
        n = F.when(F.col("column_name") == c, count).otherwise(n)
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.col("n_exact") * P.SKETCH_BOUND
    return found.withColumn("n_exact", n).select("column_name", "n_rows", "non_null", "n_exact", near.alias("within_bound"))


def q_screen_names(spark, d):
    """X1 with a long list: part names and the longer words of the benchmark items, in all documents."""
    words = _t(spark, d, "benchmark").select(F.explode(F.split("text", r"[\x20\x09-\x0D.,]+")).alias("name"))
    names = words.filter(F.length("name") >= 5).unionAll(_t(spark, d, "part").select(F.col("p_name").alias("name")))
    return X.screen_term_table(_t(spark, d, "documents"), ["doc_id"], "text", names, "name")


def q_typed_csv(spark, d):
    """Orders written as CSV with padded keys, and with a field too many or a bad price in some rows, read back typed."""
    o = _t(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 40 == 3, F.lit("unknown")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    odd = F.when(F.col("o_orderkey") % 50 == 7, F.lit(",extra")).otherwise(F.lit(""))
    rows = o.select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("key"), F.col("o_custkey").alias("customer"), price.alias("price"),
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), F.concat("o_orderstatus", odd).alias("status"))
    base, named = f"{shared_dir(spark)}/datasets-{uuid.uuid4().hex}", {"ORDERS": DatasetSpec("orders.csv", "Orders as text")}
    rows.write.option("header", True).option("quote", "\u0001").csv(f"{base}/orders.csv")  # a comma inside a value then splits it for a reader
    read = load_typed_dataset(spark, "ORDERS", base, datasets=named, types={"price": "double"})
    kinds = ",".join(f"{c}:{t}" for c, t in read.types.items())
    kept = read.df.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"), F.min("key").alias("first_key"), F.round(F.sum("price"), 2).alias("price"),
                                         F.max("ordered").cast("date").alias("last_day")).withColumn("kind", F.lit(kinds))
    lost = read.rejects.groupBy(F.col("reason").alias("status")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.substring("raw_row", 1, 9)).alias("first_key"))
    lost = lost.select("*", F.lit(None).cast("double").alias("price"), F.lit(None).cast("date").alias("last_day"), F.lit("rejected").alias("kind"))
    return kept.unionByName(lost)


def q_staged_transforms(spark, d):
    """Transforms that fail on a single row, lose rows against their contract or drop a role column, and one that is committed."""
    items = _t(spark, d, "lineitem")
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    text = F.when(place == items.agg(F.max(place)).scalar(), F.lit("unknown")).otherwise(F.col("l_quantity").cast("string"))
    transforms = {
        "cast": lambda df: df.withColumn("l_quantity", text.cast("double")),
        "filter": lambda df: df.filter("l_returnflag <> 'N'"),
        "drop": lambda df: df.drop("l_shipdate"),
        "double": lambda df: df.withColumn("l_quantity", F.col("l_quantity") * 2),
    }
    parts = []
    for name, fn in transforms.items():
        result = staged_transform(items, fn, Roles(subject="l_orderkey", x="l_shipdate", bar="l_quantity"), rows="same", name=name)
        parts.append(result.df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))
                     .withColumns({"transform": F.lit(name), "status": F.lit(result.status)}))
    return reduce(DataFrame.unionByName, parts)


QUERIES: dict[str, Query] = {
    "subject_bars": q_subject_bars,
    "merge_subjects": q_merge_subjects,
    "merge_row_count": q_merge_row_count,
    "first_per_key": q_first_per_key,
    "day_diff_floor": q_day_diff_floor,
    "elapsed_days": q_elapsed_days,
    "days_since_min": q_days_since_min,
    "days_since_first": q_days_since_first,
    "shift_days": q_shift_days,
    "to_number": q_to_number,
    "fill_drop": q_fill_drop,
    "bar_label": q_bar_label,
    "select_plot_columns": q_select_plot_columns,
    "filter_rows": q_filter_rows,
    "keep_subjects": q_keep_subjects,
    "exclude_subjects": q_exclude_subjects,
    "subject_counts": q_subject_counts,
    "group_agg": q_group_agg,
    "lane_order": q_lane_order,
    "timepoint_markers": q_timepoint_markers,
    "category_markers": q_category_markers,
    "marker_legend": q_marker_legend,
    "layers": q_layers,
    "orphan_markers": q_orphan_markers,
    "bar_conflicts": q_bar_conflicts,
    "distinct_values": q_distinct_values,
    "sample_values": q_sample_values,
    "profile": q_profile,
    "axis_types": q_axis_types,
    "validate_timeline": q_validate_timeline,
    "check_timeline": q_check_timeline,
    "screen_terms": q_screen_terms,
    "screen_requests": q_screen_requests,
    "classify_intent": q_classify_intent,
    "extract_block": q_extract_block,
    "audit_references": q_audit_references,
    "conversation_log": q_conversation_log,
    "layer_changes": q_layer_changes,
    "edit_contract": q_edit_contract,
    "apply_steps": q_apply_steps,
    "last_event": q_last_event,
    "customer_bars": q_customer_bars,
    "top_orders": q_top_orders,
    "parse_dates": q_parse_dates,
    "bar_to_days": q_bar_to_days,
    "interval_days": q_interval_days,
    "edit_requests": q_edit_requests,
    "hot_merge": q_hot_merge,
    "merge_matches": q_merge_matches,
    "merge_clash": q_merge_clash,
    "check_timeline_defects": q_check_timeline_defects,
    "sort_by_bar": q_sort_by_bar,
    "column_min": q_column_min,
    "check_list": q_check_list,
    "validation_report": q_validation_report,
    "parse_status": q_parse_status,
    "extract_formulas": q_extract_formulas,
    "intent_category": q_intent_category,
    "audit_verdicts": q_audit_verdicts,
    "merge_contract": q_merge_contract,
    "report_store": q_report_store,
    "sketch_profile": q_sketch_profile,
    "sorted_places": q_sorted_places,
    "typed_csv": q_typed_csv,
    "screen_names": q_screen_names,
    "staged_transforms": q_staged_transforms,
}
