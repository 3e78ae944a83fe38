"""DuckDB SQL for each registered query (same column names and types).

Day arithmetic is spelled out the same way as in Spark: whole microseconds
between the two times, floored to days in integers.  Sums of integers are cast back to BIGINT (DuckDB widens them).
"""

from __future__ import annotations

from tideline.operators.checks import CHECK_LABELS
from tideline.operators.textjobs import (
    ADD_INTENT,
    NON_COLUMN_WORDS,
    PLOT_TERMS,
    REMOVE_INTENT,
    USE_ADD_MSG,
    USE_REMOVE_MSG,
)


def _days(start: str, end: str) -> str:
    micros = f"CAST(epoch_us({end}) - epoch_us({start}) AS BIGINT)"
    return f"(({micros} - (({micros} % 86400000000) + 86400000000) % 86400000000) // 86400000000)"


def _elapsed(start: str, end: str) -> str:
    return f"(CAST(epoch_us({end}) - epoch_us({start}) AS DOUBLE) / CAST(86400000000 AS DOUBLE))"


NUMBER_RE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[Ii][Nn][Ff]([Ii][Nn][Ii][Tt][Yy])?)\s*$"


def _to_number(expr: str) -> str:
    return (
        f"(CASE WHEN regexp_matches(CAST({expr} AS VARCHAR), '{NUMBER_RE}') "
        f"THEN try_cast(trim(CAST({expr} AS VARCHAR)) AS DOUBLE) END)"
    )


CUSTOMER_DEDUP = (
    "(SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey "
    "ORDER BY c_name, c_nationkey, c_acctbal, c_mktsegment) = 1)"
)

# lineitem with its order and the study day of shipment
MERGED_ITEMS = (
    "(SELECT l.*, o.* EXCLUDE (o_orderkey), "
    f"{_days('o.o_orderdate', 'l.l_shipdate')} + 1 AS ship_day "
    "FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey)"
)

ITEM_BARS = (
    "(SELECT l.l_orderkey, "
    f"min({_days('o.o_orderdate', 'l.l_shipdate')} + 1) AS bar_days, "
    "min(o.o_orderpriority) AS o_orderpriority, count(*) AS n_records "
    "FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey "
    "GROUP BY l.l_orderkey)"
)

ITEM_CATEGORY_MARKERS = (
    f"(SELECT l_orderkey, CAST(ship_day AS DOUBLE) AS x, l_returnflag AS category, "
    f"'l_returnflag' AS layer FROM {MERGED_ITEMS} WHERE l_returnflag IS NOT NULL)"
)

ISO_PREFIX = r"^[0-9]{4}($|[-T ])"


def _to_timestamp(expr: str) -> str:
    t = f"trim(CAST({expr} AS VARCHAR))"
    return (
        f"coalesce(CASE WHEN regexp_matches({t}, '{ISO_PREFIX}') THEN try_cast({t} AS TIMESTAMP) END, "
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{8}}$') THEN try_strptime({t}, '%Y%m%d') END, "
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{2}}[A-Za-z]{{3}}[0-9]{{4}}$') THEN try_strptime({t}, '%d%b%Y') END, "
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') THEN try_strptime({t}, '%m/%d/%Y') END, "
        f"CASE WHEN regexp_matches({t}, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$') THEN try_strptime({t}, '%Y/%m/%d') END)"
    )


TYPED_ORDERS = (
    "(SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS order_date_text, "
    "strftime(o_orderdate, '%Y%m%d') AS order_date_compact, "
    "CAST(o_totalprice AS VARCHAR) AS price_text, o_orderstatus, "
    "CAST(o_orderkey AS VARCHAR) || 'd' AS key_label FROM orders)"
)
TYPED_ORDER_COLUMNS = [
    ("o_orderkey", "numeric"), ("o_orderdate", "datetime"), ("order_date_text", None),
    ("order_date_compact", None), ("price_text", None), ("o_orderstatus", None),
    ("key_label", None),
]


def _probe(c: str, tag: str) -> str:
    return (
        f"count({c}) AS {tag}_n, count({_to_timestamp(c)}) AS {tag}_date, "
        f"count({_to_number(c)}) AS {tag}_num"
    )


def _axis(tag: str) -> str:
    return (
        f"CASE WHEN {tag}_n = 0 THEN 'no_values' WHEN {tag}_date = {tag}_n THEN 'date_string' "
        f"WHEN {tag}_num = {tag}_n THEN 'numeric_string' ELSE 'non_linear' END"
    )


def _bar(tag: str) -> str:
    return f"CASE WHEN {tag}_num = {tag}_n THEN 'numeric' ELSE 'non_numeric' END"


def _axis_types_sql() -> str:
    probes = ", ".join(_probe(c, f"p{i}") for i, (c, fixed) in enumerate(TYPED_ORDER_COLUMNS)
                       if fixed is None)
    parts = []
    for i, (c, fixed) in enumerate(TYPED_ORDER_COLUMNS):
        if fixed:
            parts.append(f"SELECT '{c}' AS column_name, '{fixed}' AS axis_type, '{fixed}' AS bar_type FROM p")
        else:
            parts.append(f"SELECT '{c}', {_axis(f'p{i}')}, {_bar(f'p{i}')} FROM p")
    return f"WITH p AS (SELECT {probes} FROM {TYPED_ORDERS}) " + " UNION ALL ".join(parts)


def _validate_sql() -> str:
    x, b = "order_date_text", "price_text"
    xt, bt = _axis("x"), _bar("b")
    return (
        f"WITH p AS (SELECT count(*) AS n_rows, {_probe(x, 'x')}, {_probe(b, 'b')} "
        f"FROM {TYPED_ORDERS}), q AS (SELECT n_rows, {xt} AS xt, {bt} AS bt FROM p) "
        "SELECT 'roles_specified' AS \"check\", true AS passed, 'ok' AS severity, "
        "CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS VARCHAR) AS message FROM q WHERE n_rows > 0 "
        "UNION ALL SELECT 'roles_in_data', true, 'ok', NULL, NULL FROM q WHERE n_rows > 0 "
        "UNION ALL SELECT 'x_axis_linear', xt IN ('datetime', 'numeric', 'date_string', 'numeric_string'), "
        "CASE WHEN xt NOT IN ('datetime', 'numeric', 'date_string', 'numeric_string') THEN 'error' "
        "WHEN xt IN ('date_string', 'numeric_string') THEN 'warning' ELSE 'ok' END, xt, "
        f"CASE WHEN xt NOT IN ('datetime', 'numeric', 'date_string', 'numeric_string') "
        f"THEN '{x}: the time axis holds values that are neither numbers nor dates' "
        f"WHEN xt IN ('date_string', 'numeric_string') THEN '{x}: the time axis is read from text as ' || xt END "
        "FROM q WHERE n_rows > 0 "
        "UNION ALL SELECT 'bar_numeric', bt IN ('datetime', 'numeric'), "
        "CASE WHEN bt NOT IN ('datetime', 'numeric') THEN 'error' WHEN bt = 'datetime' THEN 'warning' "
        f"ELSE 'ok' END, bt, CASE WHEN bt NOT IN ('datetime', 'numeric') THEN "
        f"'{b}: bar lengths need numbers' WHEN bt = 'datetime' THEN "
        f"'{b}: bar ends are times and become days' END FROM q WHERE n_rows > 0 "
        "UNION ALL SELECT 'graph_request_screen', false, 'error', 'subset by', "
        "'The plot request asks for data work: subset by' FROM q WHERE n_rows > 0 "
        "UNION ALL SELECT 'roles_in_data', false, 'error', 'No data', 'No data' FROM q WHERE n_rows = 0"
    )


DOCUMENT_TERMS = ("license", "token", "without", "password", "secret")
URL_TOKEN = r"[/.?&=]([A-Za-z][A-Za-z_-]*)"


def _screen(text: str, terms) -> str:
    arr = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    return f"list_filter({arr}, lambda t: coalesce(contains(lower({text}), t), false))"


def _layer_set(first_half: bool) -> str:
    cond = "day(ts) <= 15" if first_half else "day(ts) > 15"
    return f"(SELECT DISTINCT user_id AS plot_id, event_type AS layer FROM events WHERE {cond})"


LAYER_CHANGES = (
    "(SELECT coalesce(b.plot_id, a.plot_id) AS plot_id, coalesce(b.layer, a.layer) AS layer, "
    "CASE WHEN b.plot_id IS NULL THEN 'added' WHEN a.plot_id IS NULL THEN 'removed' "
    f"ELSE 'kept' END AS status FROM {_layer_set(True)} b FULL OUTER JOIN {_layer_set(False)} a "
    "ON b.plot_id = a.plot_id AND b.layer = a.layer)"
)

REFERENCE_DAY = "TIMESTAMP '1992-01-01 00:00:00'"

ORACLE_SQL: dict[str, str] = {
    "subject_bars": f"SELECT * FROM {ITEM_BARS}",
    "merge_subjects": (
        "SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment "
        f"FROM orders o LEFT JOIN {CUSTOMER_DEDUP} c ON o.o_custkey = c.c_custkey"
    ),
    "merge_row_count": (
        "SELECT rows_before, CAST(6 AS BIGINT) AS cols_before, rows_after, "
        "CAST(10 AS BIGINT) AS cols_after, rows_before = rows_after AS rows_equal FROM "
        "(SELECT (SELECT count(*) FROM orders) AS rows_before, "
        f"(SELECT count(*) FROM orders o LEFT JOIN {CUSTOMER_DEDUP} c "
        "ON o.o_custkey = c.c_custkey) AS rows_after)"
    ),
    "first_per_key": (
        "SELECT event_id, ts, user_id, event_type, value, props FROM events "
        "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"
    ),
    "day_diff_floor": (
        "SELECT l.l_orderkey, l.l_linenumber, "
        f"{_days('o.o_orderdate', 'l.l_shipdate')} AS day_floor, "
        f"{_days('o.o_orderdate', 'l.l_shipdate')} + 1 AS day_incl "
        "FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey"
    ),
    "elapsed_days": (
        "SELECT l.l_orderkey, l.l_linenumber, "
        f"{_elapsed('o.o_orderdate', 'l.l_shipdate')} AS elapsed_days "
        "FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey"
    ),
    "days_since_min": (
        "SELECT event_id, user_id, "
        f"{_days('(SELECT min(ts) FROM events)', 'ts')} AS days_since_min FROM events"
    ),
    "days_since_first": (
        "SELECT event_id, user_id, "
        f"{_days('min(ts) OVER (PARTITION BY user_id)', 'ts')} + 1 AS days_since_first "
        "FROM events"
    ),
    "shift_days": (
        "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS plus_30, "
        "o_orderdate - INTERVAL 7 DAY AS minus_7 FROM orders"
    ),
    "to_number": (
        "SELECT event_id, k AS k_text, "
        f"{_to_number('k')} AS k_num, {_to_number("(k || 'd')")} AS k_label_num, "
        f"{_to_number('event_type')} AS type_num "
        "FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)"
    ),
    "fill_drop": (
        "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderstatus END, "
        "'closed') AS open_status, o_totalprice AS big_price FROM orders "
        "WHERE o_totalprice > 100000"
    ),
    "bar_label": (
        f"SELECT l_orderkey, l_linenumber, CAST(ship_day AS VARCHAR) || 'd' AS bar_label "
        f"FROM {MERGED_ITEMS}"
    ),
    "select_plot_columns": (
        "SELECT o.o_custkey, o.o_orderdate, o.o_totalprice, o.o_orderstatus, "
        "c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment "
        f"FROM orders o LEFT JOIN {CUSTOMER_DEDUP} c ON o.o_custkey = c.c_custkey"
    ),
    "filter_rows": (
        "SELECT * FROM events WHERE event_type = 'click' AND value > 10 AND value IS NOT NULL"
    ),
    "keep_subjects": (
        "SELECT * FROM orders o WHERE EXISTS "
        "(SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"
    ),
    "exclude_subjects": (
        "SELECT * FROM orders o WHERE NOT EXISTS "
        "(SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"
    ),
    "subject_counts": (
        "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_subjects, "
        "round(count(*) / greatest(count(DISTINCT user_id), 1), 1) AS rows_per_subject "
        "FROM events"
    ),
    "group_agg": (
        "SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_subjects, "
        "min(ship_day) AS min_day, max(ship_day) AS max_day, "
        f"CAST(sum(ship_day) AS BIGINT) AS sum_day FROM {MERGED_ITEMS} GROUP BY o_orderpriority"
    ),
    "lane_order": (
        "SELECT b.*, row_number() OVER (ORDER BY bar_days NULLS LAST, l_orderkey) AS lane "
        f"FROM {ITEM_BARS} b"
    ),
    "timepoint_markers": (
        "SELECT l_orderkey, CAST(ship_day AS DOUBLE) AS x, 'ship_day' AS layer "
        f"FROM {MERGED_ITEMS} WHERE ship_day IS NOT NULL"
    ),
    "category_markers": f"SELECT * FROM {ITEM_CATEGORY_MARKERS}",
    "marker_legend": (
        "SELECT layer, category, count(*) AS n_markers "
        f"FROM {ITEM_CATEGORY_MARKERS} GROUP BY layer, category"
    ),
    "layers": (
        "SELECT 'bar' AS layer, CAST(l_orderkey AS VARCHAR) AS subject, "
        "CAST(bar_days AS DOUBLE) AS x, CAST(NULL AS VARCHAR) AS category, "
        f"CAST(bar_days AS VARCHAR) || 'd' AS label FROM {ITEM_BARS} "
        "UNION ALL SELECT layer, CAST(l_orderkey AS VARCHAR), x, category, CAST(NULL AS VARCHAR) "
        f"FROM {ITEM_CATEGORY_MARKERS}"
    ),
    "orphan_markers": (
        "SELECT o_orderkey, CAST(1 AS DOUBLE) AS x, o_orderstatus AS category, "
        "'o_orderstatus' AS layer FROM orders o WHERE o_orderstatus IS NOT NULL "
        "AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)"
    ),
    "bar_conflicts": (
        "SELECT l_orderkey, min(ship_day) AS min_bar, max(ship_day) AS max_bar, "
        f"count(DISTINCT ship_day) AS n_values FROM {MERGED_ITEMS} GROUP BY l_orderkey "
        "HAVING min(ship_day) <> max(ship_day)"
    ),
    "distinct_values": (
        "SELECT 'p_brand' AS column_name, n AS n_values, "
        "shown || CASE WHEN n > 30 THEN '...' ELSE '' END AS preview FROM "
        "(SELECT (SELECT count(DISTINCT p_brand) FROM part) AS n, "
        "(SELECT coalesce(string_agg(v, ', ' ORDER BY v), '') FROM "
        "(SELECT DISTINCT p_brand AS v FROM part WHERE p_brand IS NOT NULL "
        "ORDER BY v LIMIT 30)) AS shown)"
    ),
    "sample_values": (
        "WITH u AS ("
        "SELECT 'c_custkey' AS column_name, CAST(c_custkey AS DOUBLE) AS num, "
        "CAST(c_custkey AS VARCHAR) AS value FROM customer "
        "UNION ALL SELECT 'c_name', NULL, c_name FROM customer "
        "UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS DOUBLE), "
        "CAST(c_nationkey AS VARCHAR) FROM customer "
        "UNION ALL SELECT 'c_acctbal', c_acctbal, CAST(c_acctbal AS VARCHAR) FROM customer "
        "UNION ALL SELECT 'c_mktsegment', NULL, c_mktsegment FROM customer), "
        "d AS (SELECT DISTINCT column_name, num, value FROM u WHERE value IS NOT NULL) "
        "SELECT column_name, rank, value FROM (SELECT column_name, value, "
        "CAST(row_number() OVER (PARTITION BY column_name ORDER BY num NULLS LAST, value) "
        "AS BIGINT) AS rank FROM d) WHERE rank <= 3"
    ),
    "profile": " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{t}' AS dtype, "
        f"count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct FROM customer"
        for i, (c, t) in enumerate([
            ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string"),
        ])
    ),
    "axis_types": _axis_types_sql(),
    "validate_timeline": _validate_sql(),
    "check_timeline": (
        f"WITH b AS {ITEM_BARS}, m AS {ITEM_CATEGORY_MARKERS}, "
        "c AS (SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM b GROUP BY l_orderkey "
        "HAVING count(*) > 1)) AS dup, (SELECT count(*) FROM b) AS n_bars, "
        "(SELECT count(*) FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = m.l_orderkey)) "
        "AS orphans) "
        "SELECT 'one bar per subject' AS \"check\", dup = 0 AS passed, "
        "CAST(dup AS VARCHAR) || ' subjects with several bars' AS detail FROM c "
        "UNION ALL SELECT 'bars present', n_bars > 0, CAST(n_bars AS VARCHAR) || ' bars' FROM c "
        "UNION ALL SELECT 'markers reference bar subjects', orphans = 0, "
        "CAST(orphans AS VARCHAR) || ' orphan markers' FROM c"
    ),
    "screen_terms": (
        f"SELECT doc_id, {_screen('text', DOCUMENT_TERMS)} AS issues, "
        f"len({_screen('text', DOCUMENT_TERMS)}) = 0 AS valid FROM documents"
    ),
    "screen_requests": (
        f"SELECT conv_id, turn, {_screen('text', PLOT_TERMS)} AS issues, "
        f"len({_screen('text', PLOT_TERMS)}) = 0 AS valid FROM conversations WHERE role = 'user'"
    ),
    "classify_intent": (
        "SELECT doc_id, CASE WHEN r AND a THEN 'both' WHEN r THEN 'remove' WHEN a THEN 'add' "
        "ELSE 'none' END AS intent FROM (SELECT doc_id, "
        f"regexp_matches(coalesce(text, ''), '(?i){REMOVE_INTENT}') AS r, "
        f"regexp_matches(coalesce(text, ''), '(?i){ADD_INTENT}') AS a FROM documents)"
    ),
    "extract_block": (
        "SELECT page_id, regexp_replace(CASE WHEN instr(html, '<title>') > 0 THEN "
        "CASE WHEN instr(substring(html, instr(html, '<title>') + 7), '</title>') > 1 THEN "
        "substring(html, instr(html, '<title>') + 7, "
        "instr(substring(html, instr(html, '<title>') + 7), '</title>') - 1) "
        "ELSE html END ELSE html END, '^\\s+|\\s+$', '', 'g') AS title FROM pages"
    ),
    "audit_references": (
        "WITH r AS (SELECT DISTINCT page_id, ref FROM (SELECT page_id, "
        f"unnest(regexp_extract_all(url, '{URL_TOKEN}', 1)) AS ref FROM pages)) "
        "SELECT page_id, ref FROM r WHERE length(ref) >= 2 AND regexp_matches(ref, '^\\p{L}') "
        f"AND NOT contains(ref, ' ') AND NOT regexp_matches(ref, '(?i){NON_COLUMN_WORDS}') "
        "AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = r.ref)"
    ),
    "conversation_log": (
        "SELECT c.conv_id, c.turn, c.role, c.text, CASE WHEN length(c.text) > 100 "
        "THEN left(c.text, 100) || '...' ELSE c.text END AS snippet, g.n_messages, "
        "g.first_turn, g.last_turn FROM conversations c JOIN (SELECT conv_id, "
        "count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn "
        "FROM conversations GROUP BY conv_id) g ON c.conv_id = g.conv_id"
    ),
    "layer_changes": f"SELECT * FROM {LAYER_CHANGES}",
    "edit_contract": (
        "SELECT plot_id, n_added, n_removed, n_added = 1 AND n_removed = 0 AS add_ok, "
        "n_removed = 1 AND n_added = 0 AS remove_ok FROM (SELECT plot_id, "
        "count(*) FILTER (WHERE status = 'added') AS n_added, "
        f"count(*) FILTER (WHERE status = 'removed') AS n_removed FROM {LAYER_CHANGES} "
        "GROUP BY plot_id)"
    ),
    "apply_steps": (
        f"SELECT * FROM {MERGED_ITEMS} WHERE ship_day > 0 AND o_orderpriority IS NOT NULL"
    ),
    "last_event": (
        "SELECT event_id, ts, user_id, event_type, value, props FROM events "
        "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1"
    ),
    "customer_bars": (
        "SELECT o_custkey, min(span_days) AS span_days, min(c_mktsegment) AS c_mktsegment, "
        "count(*) AS n_records FROM (SELECT o.o_custkey, c.c_mktsegment, "
        f"{_days('min(o.o_orderdate) OVER (PARTITION BY o.o_custkey)', 'max(o.o_orderdate) OVER (PARTITION BY o.o_custkey)')} + 1 AS span_days "
        f"FROM orders o LEFT JOIN {CUSTOMER_DEDUP} c ON o.o_custkey = c.c_custkey) GROUP BY o_custkey"
    ),
    "top_orders": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "parse_dates": (
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS from_iso, "
        "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS from_compact, "
        "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS from_us FROM orders"
    ),
    "bar_to_days": (
        "SELECT o_orderkey, o_orderdate, "
        f"{_days(REFERENCE_DAY, 'o_orderdate')} + 1 AS order_day "
        "FROM orders"
    ),
    "interval_days": (
        "SELECT l.l_orderkey, l.l_linenumber, "
        f"{_days('o.o_orderdate', 'l.l_shipdate')} AS interval_days "
        "FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey"
    ),
    "edit_requests": (
        "SELECT *, coalesce(CASE category WHEN 'add_overlay' THEN add_ok WHEN 'remove_overlay' THEN remove_ok "
        "ELSE true END, true) AND NOT lost_protected AS ok FROM (SELECT plot_id, n_added, n_removed, added, removed, "
        "lost_protected, n_added = 1 AND n_removed = 0 AS add_ok, "
        "n_removed = 1 AND n_added = 0 AND NOT lost_protected AS remove_ok, "
        "CASE plot_id % 3 WHEN 0 THEN 'add_overlay' WHEN 1 THEN 'remove_overlay' ELSE 'axes' END AS category "
        "FROM (SELECT plot_id, count(*) FILTER (WHERE status = 'added') AS n_added, "
        "count(*) FILTER (WHERE status = 'removed') AS n_removed, "
        "coalesce(list(layer ORDER BY layer) FILTER (WHERE status = 'added'), []) AS added, "
        "coalesce(list(layer ORDER BY layer) FILTER (WHERE status = 'removed'), []) AS removed, "
        "bool_or(status = 'removed' AND layer = 'purchase') AS lost_protected "
        f"FROM {LAYER_CHANGES} GROUP BY plot_id))"
    ),
    "hot_merge": (
        "SELECT l.k AS l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderdate, o_orderpriority FROM "
        "(SELECT *, CASE WHEN l_partkey % 9 < 3 THEN 0 WHEN l_partkey % 9 > 3 THEN l_orderkey END AS k FROM lineitem) l "
        "LEFT JOIN orders o ON l.k = o.o_orderkey"
    ),
    "merge_matches": (
        "SELECT o_orderstatus, count(*) AS n_records, count(c_mktsegment) AS n_matched, "
        "count(*) - count(c_mktsegment) AS n_unmatched FROM orders o LEFT JOIN "
        "(SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey GROUP BY o_orderstatus"
    ),
    "merge_clash": (
        "SELECT o.*, c.c_mktsegment AS o_orderstatus_subj "
        f"FROM orders o LEFT JOIN {CUSTOMER_DEDUP} c ON o.o_custkey = c.c_custkey"
    ),
    "check_timeline_defects": (
        f"WITH b AS (SELECT l_orderkey, l_returnflag FROM {MERGED_ITEMS} WHERE l_returnflag <> 'N' "
        "GROUP BY l_orderkey, l_returnflag), c AS (SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM b "
        "GROUP BY l_orderkey HAVING count(*) > 1)) AS dup, (SELECT count(*) FROM b) AS n_bars, "
        "(SELECT count(*) FROM orders o WHERE o_orderstatus IS NOT NULL "
        "AND NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = o.o_orderkey)) AS orphans) "
        "SELECT 'one bar per subject' AS \"check\", dup = 0 AS passed, "
        "CAST(dup AS VARCHAR) || ' subjects with several bars' AS detail FROM c "
        "UNION ALL SELECT 'bars present', n_bars > 0, CAST(n_bars AS VARCHAR) || ' bars' FROM c "
        "UNION ALL SELECT 'markers reference bar subjects', orphans = 0, "
        "CAST(orphans AS VARCHAR) || ' orphan markers' FROM c"
    ),
    "sort_by_bar": f"SELECT * FROM {ITEM_BARS} ORDER BY bar_days, l_orderkey",
    "column_min": "SELECT min(o_orderdate) AS min_o_orderdate FROM orders",
    "check_list": (
        "SELECT CASE \"check\" "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHECK_LABELS.items())
        + " END AS label, passed, CASE WHEN passed AND \"check\" IN ('x_axis_linear', 'bar_numeric') "
        f"THEN 'Type: ' || detail END AS detail FROM ({_validate_sql()}) WHERE \"check\" IN ("
        + ", ".join(f"'{k}'" for k in CHECK_LABELS) + ")"
    ),
    "validation_report": (
        f"WITH m AS {MERGED_ITEMS}, p AS (SELECT l_orderkey, l_linenumber, ship_day FROM m WHERE ship_day > 0) "
        "SELECT (SELECT count(*) FROM m) AS rows_before, (SELECT count(*) FROM p) AS rows_after, "
        "(SELECT string_agg('{\"l_orderkey\":' || l_orderkey || ',\"l_linenumber\":' || l_linenumber || "
        "',\"ship_day\":' || ship_day || '}', ';' ORDER BY ship_day, l_orderkey, l_linenumber) "
        "FROM (SELECT * FROM p ORDER BY ship_day, l_orderkey, l_linenumber LIMIT 5)) AS first_rows, "
        "'l_orderkey,l_linenumber,ship_day' AS columns"
    ),
    "parse_status": (
        "SELECT event_id, CASE event_type WHEN 'click' THEN 'already_overlaid' WHEN 'error' THEN 'wrong_category' END "
        "AS status, CASE WHEN event_type IN ('click', 'error') THEN 'user ' || user_id END AS detail FROM events"
    ),
    "extract_formulas": (
        "SELECT event_id, CAST(2 AS BIGINT) AS line_no, event_type || '_day' AS name, "
        "'floor(x) = ' || user_id AS formula FROM events"
    ),
    "intent_category": (
        "SELECT doc_id, intent, CASE WHEN doc_id % 2 = 0 AND intent = 'remove' THEN "
        f"'{USE_REMOVE_MSG}' WHEN doc_id % 2 <> 0 AND intent = 'add' THEN '{USE_ADD_MSG}' END AS wrong_category "
        "FROM (SELECT doc_id, CASE WHEN r AND a THEN 'both' WHEN r THEN 'remove' WHEN a THEN 'add' "
        "ELSE 'none' END AS intent FROM (SELECT doc_id, "
        f"regexp_matches(coalesce(text, ''), '(?i){REMOVE_INTENT}') AS r, "
        f"regexp_matches(coalesce(text, ''), '(?i){ADD_INTENT}') AS a FROM documents))"
    ),
    "audit_verdicts": (
        "SELECT page_id, coalesce(unknown, []) AS unknown, unknown IS NULL AS ok FROM pages LEFT JOIN "
        "(SELECT page_id, list(DISTINCT ref ORDER BY ref) AS unknown FROM (SELECT page_id, "
        f"unnest(regexp_extract_all(url, '{URL_TOKEN}', 1)) AS ref FROM pages WHERE page_id % 2 = 0) r "
        "WHERE length(ref) >= 2 AND regexp_matches(ref, '^\\p{L}') "
        f"AND NOT contains(ref, ' ') AND NOT regexp_matches(ref, '(?i){NON_COLUMN_WORDS}') "
        "AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = r.ref) GROUP BY page_id) USING (page_id)"
    ),
    "merge_contract": (
        "WITH m AS (SELECT 'items' AS merge, l_returnflag AS arm, l_orderkey AS k, count(*) AS b, count(*) AS a, count(o_orderkey) AS f "
        "FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL UNION ALL "
        "SELECT 'customers', c_mktsegment, c_custkey, 1, greatest(1, count(o_custkey)), count(o_custkey) FROM customer LEFT JOIN orders "
        "ON c_custkey = o_custkey GROUP BY ALL) "
        "SELECT merge, arm, CAST(sum(b) AS BIGINT) AS rows_before, CAST(sum(a) AS BIGINT) AS rows_after, CAST(sum(f) AS BIGINT) AS n_matched, "
        "count(*) AS n_subjects, count(*) FILTER (a <> b) AS n_changed, count(*) FILTER (a <> b) = 0 AS kept FROM m GROUP BY merge, arm"
    ),
    "staged_transforms": (
        "SELECT transform, status, l_returnflag, count(*) AS n_rows, sum(l_quantity) * times AS quantity FROM lineitem, "
        "(VALUES ('cast', 'run_error', 1), ('filter', 'contract', 1), ('drop', 'missing_columns', 1), ('double', 'committed', 2)) t(transform, status, times) "
        "GROUP BY transform, status, l_returnflag, times"
    ),
    "report_store": (
        "SELECT 'items' AS run_id, count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem "
        "UNION ALL SELECT 'orders', count(*), 6 FROM orders"
    ),
    "sketch_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS non_null, "
        + (f"count(DISTINCT {c}) AS n_exact, true AS within_bound" if c in ("event_id", "user_id")
           else "CAST(NULL AS BIGINT) AS n_exact, CAST(NULL AS BOOLEAN) AS within_bound") + " FROM events"
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
    "screen_names": (
        "WITH t AS (SELECT DISTINCT lower(name) AS term FROM (SELECT w AS name FROM "
        "(SELECT unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D.,]+')) AS w FROM benchmark) WHERE length(w) >= 5 "
        "UNION ALL SELECT p_name FROM part) WHERE name <> ''), "
        "h AS (SELECT doc_id, list(term ORDER BY term) AS issues FROM documents JOIN t ON contains(lower(text), term) GROUP BY doc_id) "
        "SELECT doc_id, coalesce(issues, []) AS issues, issues IS NULL AS valid FROM documents LEFT JOIN h USING (doc_id)"
    ),
    "typed_csv": (
        "WITH o AS (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS key, o_orderkey % 50 = 7 AS odd, o_orderkey % 40 = 3 AS bad FROM orders) "
        "SELECT o_orderstatus AS status, count(*) AS n_rows, min(key) AS first_key, round(sum(o_totalprice), 2) AS price, "
        "CAST(max(o_orderdate) AS DATE) AS last_day, 'key:string,customer:bigint,price:double,ordered:timestamp,status:string' AS kind "
        "FROM o WHERE NOT odd AND NOT bad GROUP BY o_orderstatus "
        "UNION ALL SELECT 'fields', count(*), min(key), NULL, NULL, 'rejected' FROM o WHERE odd HAVING count(*) > 0 "
        "UNION ALL SELECT 'double', count(*), min(key), NULL, NULL, 'rejected' FROM o WHERE bad AND NOT odd HAVING count(*) > 0"
    ),
    "sorted_places": (
        "SELECT l_orderkey, bar_days, row_number() OVER (ORDER BY bar_days NULLS LAST, l_orderkey) AS place "
        f"FROM {ITEM_BARS}"
    ),
}
