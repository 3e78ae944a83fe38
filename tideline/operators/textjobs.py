"""Text-table jobs (X1-X7): screen, route and audit whole tables of text.

Every job is a projection of built-in string/regex/array expressions over
each row's whole text (no prefixes), so it runs inside whole-stage codegen and
scales with the number of rows; the only exchanges are the reference audit's
de-duplication and anti join and the conversation summary's aggregate.
Regexes are Java regexes; ``\\w`` and ``\\b`` are ASCII, as in the patterns'
original use on English requests.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.common import ColumnOrName, col_of
from tideline.operators.skew import join_one_per_key

# Terms that mark a plot request as containing data-step work.
DATA_TERMS: tuple[str, ...] = (
    "filter subjects", "exclude subjects", "remove subjects",
    "calculate new", "derive new", "create new column",
    "group by treatment", "subset by", "select only",
)

# Terms that mark a data request as containing plot styling.
PLOT_TERMS: tuple[str, ...] = (
    "plotly title", "chart title", "plot title", "figure title",
    "axis label font", "legend font", "text font",
    "plot background", "chart background", "figure background",
    "plot layout", "chart layout", "figure layout",
    "hover tooltip", "plot annotation",
)

# Verb families of overlay edit requests (case-insensitive).
REMOVE_INTENT = (
    r"\b(remov\w*|delet\w*|dropp?\w*|get\s+rid\s+of|took?\s+off|hidd?\w*|exclud\w*|without)\b"
)
ADD_INTENT = r"\b(add\w*|overlay\w*|includ\w*|show\w*|plott?\w*|putt?\w*|introduc\w*|display\w*)\b"

# Status keys of special one-line replies, in the order tried.
STATUS_KEYS: tuple[str, ...] = (
    "ALREADY_OVERLAID", "PROTECTED_TRACE", "WRONG_CATEGORY", "CLARIFICATION_NEEDED",
)

# Category-mismatch messages of the add/remove overlay gate.
USE_REMOVE_MSG = "Use the Remove Overlay category to remove a trace."
USE_ADD_MSG = "Use the Add Overlay category to add a new overlay."

# Bracket column references (name["col"] / name['col']) and the
# string literals that are styling words, not column names.
BRACKET_REF = r"""\w+\[["']([^"']+)["']\]"""
NON_COLUMN_WORDS = (
    r"^(markers?|lines?|rgba?|rgb|#[0-9a-fA-F]+|circle|square|diamond|"
    r"triangle.*|star|cross|outside|inside|auto|top|bottom|left|right|"
    r"linear|category|date|log|h|v|overlay|group|stack|text|none|"
    r"solid|dash|dot|longdash|dashdot|longdashdot)$"
)

DERIVED_PREFIX = "DERIVED:"
SNIPPET_CHARS = 100


def _strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ------------------------------------------------------------------- X1 screen

def screen_expr(text: ColumnOrName, terms: Sequence[str]) -> Column:
    """Terms (in list order) found case-insensitively in ``text``; [] for NULL/blank.

    Written without a lambda so that codegen's common-subexpression
    elimination lower-cases each text once, not once per term.
    """
    lowered = F.lower(col_of(text))
    hits = [F.when(F.contains(lowered, F.lit(t.lower())), F.lit(t.lower())) for t in terms]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def screen_terms(
    df: DataFrame, text: str, terms: Sequence[str] = DATA_TERMS,
    issues: str = "issues", valid: str = "valid",
) -> DataFrame:
    """Add the matched terms and a validity flag (no match = valid)."""
    found = screen_expr(text, terms)
    return df.withColumn(issues, found).withColumn(valid, F.size(F.col(issues)) == 0)


#: Terms up to this many bytes are looked up whole, longer ones by a piece of this length.
WHOLE_BYTES = 16
#: Byte lengths of the beginnings by which a whole term's place is tested first, longest first.
HEAD_BYTES = (8, 4, 2, 1)
#: Longs in a bit table of pieces: 4 M bits, whatever the list.
_TABLE_LONGS = 1 << 16


def screen_term_table(
    df: DataFrame, ids: Sequence[str], text: str, terms: DataFrame, term: str,
    issues: str = "issues", valid: str = "valid",
) -> DataFrame:
    """X1 for a list of any length: the listed terms that occur in each text.

    ``terms`` is a table, its column ``term`` the list.  One row per distinct
    ``ids``: the terms found (lower case, sorted, each once) and whether there
    are none.  As in :func:`screen_terms` a term occurs wherever its letters
    do, also inside words and overlapping other terms; NULL and empty terms are
    ignored, a NULL text has none.

    Cost does not grow with texts times terms.  A position of a text goes on
    only if a bit table of fixed size knows the hash of the 8 bytes (4, 2 or 1
    for short terms) that start there as the beginning of a term, and then, for
    each length of such terms, only if a second table knows the hash of that
    many bytes as a whole term.  What goes on is nearly always a term, so each
    text sends each of its terms once to the equi-join with the list that
    decides: what is shuffled is in proportion to what is found.

    Terms over ``WHOLE_BYTES`` bytes are anchored on one of their own pieces of
    that length, the one fewest such terms contain; places of the pieces meet
    the anchors with as much of the text around them as the longest term needs
    and are compared in full.  Matching is on UTF-8 bytes, where a whole term
    can only match whole characters.  Building asks the list for the lengths it
    needs (at most ``WHOLE_BYTES`` + 1 rows); all else is lazy.
    """
    listed = terms.select(F.lower(F.col(term).cast("string")).alias("_term")).filter(F.col("_term") != "").distinct()
    listed = listed.select("_term", F.col("_term").cast("binary").alias("_bytes"), F.octet_length("_term").alias("_len"))
    sizes = {r[0] for r in listed.select(F.least("_len", F.lit(WHOLE_BYTES + 1))).distinct().collect()}

    # A plain name for each id: the union below lines them up by position.
    keys = [F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)]
    texts = df.select(*keys, F.lower(F.col(text).cast("string")).cast("binary").alias("_text"))
    empty = texts.select(*[f"_id{i}" for i in range(len(ids))], F.lit(None).cast("string").alias("_term"))
    found = empty
    whole = sorted(n for n in sizes if n <= WHOLE_BYTES)
    if whole:
        found = found.unionAll(_whole_terms(texts, listed.filter(F.col("_len") <= WHOLE_BYTES), whole).select(*empty.columns))
    if WHOLE_BYTES + 1 in sizes:
        found = found.unionAll(_long_terms(texts, listed.filter(F.col("_len") > WHOLE_BYTES)).select(*empty.columns))
    out = found.groupBy(*empty.columns[:-1]).agg(F.array_sort(F.collect_set("_term")).alias(issues))
    return out.select(*[F.col(f"_id{i}").alias(c) for i, c in enumerate(ids)], issues, (F.size(issues) == 0).alias(valid))


def _places(texts: DataFrame, size: int) -> DataFrame:
    """Each position ``_at`` (from 1) of each text at which ``size`` bytes start, with these as ``_gram``."""
    at = F.explode(F.sequence(F.lit(1), F.octet_length("_text") - (size - 1)))
    places = texts.filter(F.octet_length("_text") >= size).select("*", at.alias("_at"))
    return places.withColumn("_gram", F.substring("_text", F.col("_at"), F.lit(size)))


def _whole_terms(texts: DataFrame, listed: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """The ids and ``_term`` of every listed term, of one of ``lengths``, in a text: each pair once."""
    head = F.lit(HEAD_BYTES[-1])
    for g in reversed(HEAD_BYTES[:-1]):
        head = F.when(F.col("_len") >= g, g).otherwise(head)
    heads = _bit_table(listed.select(F.substring("_bytes", F.lit(1), head).alias("_gram")))
    wholes = _bit_table(listed.select(F.col("_bytes").alias("_gram")))
    ids = [c for c in texts.columns if c != "_text"]
    parts = []
    for g, above in zip(HEAD_BYTES, (WHOLE_BYTES + 1, *HEAD_BYTES), strict=False):
        own = [n for n in lengths if g <= n < above]
        if own:
            places = _places(texts, g).filter(_known(heads, "_gram")).withColumn("_size", F.explode(F.array(*map(F.lit, own))))
            places = places.filter(F.col("_at") + F.col("_size") <= F.octet_length("_text") + 1)
            places = places.withColumn("_piece", F.substring("_text", F.col("_at"), F.col("_size")))
            parts.append(places.filter(_known(wholes, "_piece")).select(*ids, "_piece").distinct())  # of one length each, so all pairs differ
    return join_one_per_key(reduce(DataFrame.unionAll, parts), listed.select("_term", "_bytes"), "_piece", "_bytes", "inner")


def _long_terms(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """The ids and ``_term`` of every listed term over ``WHOLE_BYTES`` bytes in a text."""
    anchors = _anchors(listed.withColumn("_size", F.lit(WHOLE_BYTES)))
    reach = anchors.agg(F.struct(F.max("_offset").alias("before"), F.max("_len").alias("after"))).scalar()
    places = _places(texts, WHOLE_BYTES).filter(_known(_bit_table(anchors), "_gram"))
    places = places.withColumn("_start", F.greatest(F.col("_at") - reach["before"], F.lit(1)))
    around = F.substring("_text", F.col("_start"), reach["before"] + reach["after"]).alias("_around")
    met = places.select(*[c for c in texts.columns if c != "_text"], "_at", "_gram", "_start", around).join(anchors, "_gram")
    begin = F.col("_at") - F.col("_offset")
    same = (begin >= 1) & (F.substring("_around", begin - F.col("_start") + 1, F.col("_len")) == F.col("_bytes"))
    return met.filter(same)


def _anchors(listed: DataFrame) -> DataFrame:
    """One piece of each term, the one fewest terms contain (then the first): ``_gram`` and its ``_offset`` in the term."""
    pieces = listed.select("*", F.explode(F.sequence(F.lit(0), F.col("_len") - F.col("_size"))).alias("_offset"))
    pieces = pieces.withColumn("_gram", F.substring("_bytes", F.col("_offset") + 1, F.col("_size")))
    uses = pieces.groupBy("_gram").agg(F.count(F.lit(1)).alias("_uses")).withColumnRenamed("_gram", "_piece")
    rated = join_one_per_key(pieces, uses, "_gram", "_piece", "inner")
    best = rated.groupBy("_term").agg(F.min(F.struct("_uses", "_offset", "_gram", "_bytes", "_len", "_size")).alias("_best"))
    return best.select("_term", *[f"_best.{c}" for c in ("_gram", "_offset", "_bytes", "_len", "_size")])


def _slots(piece: str) -> list[Column]:
    """The two bits of a bit table that a piece's hash stands for."""
    bits = 64 * _TABLE_LONGS
    h = F.xxhash64(piece)
    return [x.bitwiseAND(F.lit(bits - 1).cast("long")) for x in (h, F.shiftright(h, bits.bit_length()))]


def _bit_table(pieces: DataFrame) -> Column:
    """Scalar: array of ``_TABLE_LONGS`` longs with the bits of each ``_gram`` set."""
    own = pieces.select(F.explode(F.array(*_slots("_gram"))).alias("_slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_slot").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    own = own.select(F.shiftright("_slot", 6).alias("_word"), bit.alias("_bits"))
    every = pieces.sparkSession.range(_TABLE_LONGS).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = own.unionAll(every).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    dense = words.agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_w"))
    return dense.select(F.col("_w._bits")).scalar()


def _known(table: Column, piece: str) -> Column:
    """Whether a bit table holds both bits of a piece: true for all it was built on."""
    one, both = F.lit(1).cast("long"), F.lit(True)
    for slot in _slots(piece):
        word = F.get(table, F.shiftright(slot, 6).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, slot.bitwiseAND(F.lit(63).cast("long")).cast("int"))
        both = both & (bit.bitwiseAND(one) == 1)
    return both


# ------------------------------------------------------------------- X2 intent

def intent_expr(
    text: ColumnOrName, remove_pattern: str = REMOVE_INTENT, add_pattern: str = ADD_INTENT
) -> Column:
    """``remove`` / ``add`` when only one verb family occurs, ``both``, or ``none``."""
    return _intent(_has_verb(text, remove_pattern), _has_verb(text, add_pattern))


def _has_verb(text: ColumnOrName, pattern: str) -> Column:
    return F.coalesce(col_of(text), F.lit("")).rlike("(?i)" + pattern)


def _intent(has_remove: Column, has_add: Column) -> Column:
    return (
        F.when(has_remove & has_add, "both")
        .when(has_remove, "remove")
        .when(has_add, "add")
        .otherwise("none")
    )


def classify_intent(
    df: DataFrame, text: str, category: str | None = None,
    remove_pattern: str = REMOVE_INTENT, add_pattern: str = ADD_INTENT,
    name: str = "intent",
) -> DataFrame:
    """Verb intent per row; with ``category``, the mismatch message.

    An ``add_overlay`` request with only removal verbs, or a ``remove_overlay``
    request with only adding verbs, gets ``wrong_category``; requests with both
    families are deferred (no message).
    """
    # The flags get a projection of their own, so each pattern runs once a row.
    flags = df.withColumns({"_ci_remove": _has_verb(text, remove_pattern), "_ci_add": _has_verb(text, add_pattern)})
    out = flags.withColumn(name, _intent(F.col("_ci_remove"), F.col("_ci_add"))).drop("_ci_remove", "_ci_add")
    if category is None:
        return out
    cat, intent = F.col(category), F.col(name)
    msg = (
        F.when((cat == "add_overlay") & (intent == "remove"), F.lit(USE_REMOVE_MSG))
        .when((cat == "remove_overlay") & (intent == "add"), F.lit(USE_ADD_MSG))
    )
    return out.withColumn("wrong_category", msg)


# ------------------------------------------------------------------- X3 status

def parse_status(
    df: DataFrame, text: str, keys: Sequence[str] = STATUS_KEYS,
    status: str = "status", detail: str = "detail",
) -> DataFrame:
    """Read a special one-line reply.

    The first non-blank line, leading ``#`` removed, is matched
    case-insensitively against each key as a prefix; the status is the key in
    lower case and the detail the rest of that line after ``:``/blanks, or the
    next non-blank line (``#`` removed) when that rest is empty.  Two anchored
    patterns read the two lines; the second runs only where it is needed, and
    the rest of the reply is never split.
    """
    def line(pattern: str) -> Column:
        return _strip(F.regexp_replace(_strip(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), pattern, 1)), r"^#+", ""))

    first = line(r"^\s*([^\n]*)")
    matched = F.lit(None).cast("string")
    for key in reversed(list(keys)):
        matched = F.when(F.upper(F.col("_ps_first")).startswith(key), F.lit(key)).otherwise(matched)
    rest = _strip(F.regexp_replace(F.expr("substring(_ps_first, length(_ps_key) + 1)"), r"^[: ]+", ""))
    out = df.withColumn("_ps_first", first).withColumn("_ps_key", matched)
    out = out.withColumn("_ps_rest", F.when(F.col("_ps_key").isNotNull(), rest))
    chosen = F.when(F.col("_ps_rest") == "", line(r"^\s*[^\n]*\n\s*([^\n]*)")).otherwise(F.col("_ps_rest"))
    return out.withColumn(status, F.lower(F.col("_ps_key"))).withColumn(detail, chosen).drop("_ps_first", "_ps_key", "_ps_rest")


# ------------------------------------------------------------------- X4 blocks

def block_expr(
    text: ColumnOrName, open_tag: str = "```python", close_tag: str = "```",
    fallback_open: str | None = "```",
) -> Column:
    """Text inside the first block opened by ``open_tag`` (else ``fallback_open``).

    The block ends at the next ``close_tag``; an empty or unclosed block gives
    the whole text, and so does text without an opening tag.  The result is
    stripped of surrounding whitespace.
    """
    t = col_of(text)

    def inside(tag: str) -> Column:
        start = F.instr(t, tag) + F.lit(len(tag))
        end = F.call_function("locate", F.lit(close_tag), t, start)
        return F.when(end > start, t.substr(start, end - start)).otherwise(t)

    out = F.when(F.instr(t, open_tag) > 0, inside(open_tag))
    if fallback_open:
        out = out.when(F.instr(t, fallback_open) > 0, inside(fallback_open))
    return _strip(out.otherwise(t))


def extract_block(
    df: DataFrame, text: str, open_tag: str = "```python", close_tag: str = "```",
    fallback_open: str | None = "```", name: str = "block",
) -> DataFrame:
    """Add the first block's content (code fences by default)."""
    return df.withColumn(name, block_expr(text, open_tag, close_tag, fallback_open))


def extract_fenced(df: DataFrame, text: str, lang: str = "python", name: str = "block") -> DataFrame:
    """X4 for code fences: the first block tagged ``lang``, else the first untagged one."""
    return extract_block(df, text, "```" + lang, "```", "```", name=name)


# ------------------------------------------------------------------- X5 audit

def references(
    df: DataFrame, id_cols: Sequence[str], text: str, pattern: str = BRACKET_REF,
    ignore: str | None = NON_COLUMN_WORDS,
) -> DataFrame:
    """Distinct plausible column references per row: ``(ids..., ref)``.

    A reference is group 1 of ``pattern``; kept when at least two characters,
    starting with a letter, without blanks, and not a styling word.
    """
    refs = df.select(*id_cols, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("ref"))
    keep = (F.length("ref") >= 2) & F.col("ref").rlike(r"^\p{L}") & ~F.col("ref").contains(" ")
    if ignore:
        keep = keep & ~F.col("ref").rlike("(?i)" + ignore)
    return refs.filter(keep).distinct()


def audit_references(
    df: DataFrame, id_cols: Sequence[str], text: str, catalog: DataFrame,
    catalog_col: str = "name", pattern: str = BRACKET_REF,
    ignore: str | None = NON_COLUMN_WORDS, category: str | None = None,
) -> DataFrame:
    """References that are not in the catalogue of known names.

    With ``category`` (a column of ``df``) only ``add_overlay`` rows are
    audited, as no other edit may bring in a column.  An empty catalogue
    reports nothing.  The catalogue is de-duplicated first (partial
    aggregation), so a name repeated across a large table is one build row of
    the anti join; a reference that very many rows make can be split.
    """
    if category is not None:
        df = df.filter(F.col(category) == "add_overlay")
    refs = references(df, id_cols, text, pattern, ignore)
    known = catalog.select(F.col(catalog_col).alias("_known")).filter("_known IS NOT NULL").distinct()
    any_known = catalog.limit(1).agg(F.count(F.lit(1))).scalar() > 0
    return join_one_per_key(refs.filter(any_known), known, "ref", "_known", "left_anti")


def audit_verdicts(
    df: DataFrame, id_cols: Sequence[str], text: str, catalog: DataFrame, **kw
) -> DataFrame:
    """X5 per row of ``df``: ``(ids..., unknown, ok)``.

    ``unknown`` lists a row's own unknown references sorted (bounded by the
    length of its text); ``ok`` is true when there are none.  ``id_cols`` must
    identify a row.
    """
    bad = audit_references(df, id_cols, text, catalog, **kw)
    bad = bad.groupBy(*id_cols).agg(F.array_sort(F.collect_set("ref")).alias("unknown"))
    out = df.select(*id_cols).join(bad, list(id_cols), "left")
    unknown = F.coalesce("unknown", F.array().cast("array<string>"))
    return out.select(*id_cols, unknown.alias("unknown"), (F.size(unknown) == 0).alias("ok"))


# ------------------------------------------------------------------- X6 log

def snippet(c: ColumnOrName, n: int = SNIPPET_CHARS) -> Column:
    """First ``n`` characters, with ``...`` when the text was longer."""
    t = col_of(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def conversation_log(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", keep_text: bool = True,
) -> DataFrame:
    """Each message with its snippet and its conversation's message count.

    The whole text stands beside the snippet unless ``keep_text`` is false.

    The count is a per-conversation aggregate joined back (partial
    aggregation first), so a conversation of any length is never gathered
    into one array or one task; the order of messages is the ``turn`` column.
    """
    counts = df.groupBy(conv).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min(turn).alias("first_turn"),
        F.max(turn).alias("last_turn"),
    )
    kept = [text] if keep_text else []
    msgs = df.select(conv, turn, role, snippet(text).alias("snippet"), *kept)
    counts = counts.withColumnRenamed(conv, "_conv_key")
    out = join_one_per_key(msgs, counts, conv, "_conv_key", "left", null_safe=True)
    return out.drop("_conv_key")


# ------------------------------------------------------------------- X7 lineage

def extract_formulas(df: DataFrame, id_cols: Sequence[str], text: str) -> DataFrame:
    """``DERIVED: name = formula`` lines of captured output.

    Lines must start with the prefix (case-sensitive); the name is what
    precedes the first ``=``, the formula everything after it, both stripped.
    Returns ``(ids..., line_no, name, formula)``.
    """
    lines = df.select(
        *id_cols, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line")
    ).filter(F.col("line").startswith(DERIVED_PREFIX))
    rest = _strip(F.replace(F.col("line"), F.lit(DERIVED_PREFIX), F.lit("")))
    lines = lines.withColumn("_rest", rest).filter(F.col("_rest").contains("="))
    return lines.select(
        *id_cols,
        (F.col("line_no") + 1).cast("long").alias("line_no"),
        _strip(F.substring_index("_rest", "=", 1)).alias("name"),
        _strip(F.expr("substring(_rest, instr(_rest, '=') + 1)")).alias("formula"),
    )
