"""Operator 2: near-duplicate lines by an exact set-similarity join.

A line is the set of its words.  A line goes when an earlier line (smaller
doc_id, or same document and smaller line number) has the same set or a set of
Jaccard similarity ``NUM / DEN`` or more; lines are judged on the input.  Only
DataFrame functions are used:

* words are ordered by rarity: the corpus counts of ``BUCKETS`` hash buckets of
  words (a fixed-size table) give a rarity class, ties go by hash, so the order
  is the same everywhere;
* equal sets are joined by a signature, and only the first line of each set
  goes on;
* two similar sets share a word in their prefixes (the rarest words; of the
  smaller set a shorter prefix does); they meet at that word within a class of
  sizes, and pairs that meet must pass the length filter and a parity bitmap
  (differing bits cannot outnumber differing words), and the positional filter
  bounds their overlap by the shared prefix words and what lies behind them;
* what passes is verified on the words themselves, for each line first with its
  likeliest partner and then, if that fails, with all others.

One match is enough for a line to go.  So where more than ``CROWD`` sets of a size
class share a word of their short prefixes, each is first joined only with the
earliest of them, and what passes is verified; only lines that still stand then
meet all earlier sets at their prefix words, the words in parts (``PARTS``), so
that less is shuffled at once.  A large group of similar lines thus gives pairs
with its first line, not pairs of all with all.  The first step only saves work:
the second is complete for all it left standing, and alone where few sets meet.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import delete, ids_are_unique, save, table

NUM, DEN = 4, 5      # similarity 0.8
BUCKETS = 1 << 16    # hash buckets of words whose corpus counts give rarity
CROWD = 128          # sets at a word from which they first meet the earliest of them only
PARTS = 2            # parts of the words in the second step
CLASS = 1.5          # ratio of the sizes that make a size class
MOST_LONGS = 1 << 20  # longs of the table that tells which lines' texts are needed: 8 MB
SMALL = 96           # words of a set up to which 64 parity bits tell enough
_NO_ID = -(1 << 63)
_ORDER = ["doc", "version", "line"]
_RARE_SPACES = ("\t", "\v", "\f", "\r")


def _version(unique: bool) -> Column:
    """Tells rows apart that share an id: the hash of their texts, or 0 when ids are unique."""
    return F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def line_rows(docs: DataFrame, unique: bool) -> DataFrame:
    """doc, version, line (from 0) and its text, for every line."""
    return docs.select(_doc().alias("doc"), _version(unique).alias("version"),
                       F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line", "words"))


def _words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order."""
    return F.array_remove(_split(text), "")


def _split(text: Column) -> Column:
    """Words and empty strings; the regular expression only where plain spaces won't do."""
    odd = F.lit(False)
    for c in _RARE_SPACES:
        odd = odd | F.contains(text, F.lit(c))
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1)
    return F.when(odd, F.split(text, r"[\x20\x09-\x0D]+", -1)).otherwise(plain)


def _literal(values: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), "array<int>")


def _bucket(key: Column) -> Column:
    return key.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _bucket_counts(keys: DataFrame) -> list[int]:
    """Rows per hash bucket of the column ``key``: always ``BUCKETS`` numbers."""
    out = [0] * BUCKETS
    for bucket, count in keys.groupBy(_bucket(F.col("key"))).count().collect():
        out[bucket] = count
    return out


def rarity_classes(docs: DataFrame) -> Column:
    """Array literal: rarity class (0: rarest) of each hash bucket of words, from counts over all texts."""
    words = docs.select(F.explode(_split(F.col("text").cast("string"))).alias("word")).where("word <> ''")
    counts = _bucket_counts(words.select(F.xxhash64("word").alias("key")))
    return _literal([1 + min(126, round(3 * math.log2(c))) if c else 0 for c in counts])


def word_keys(text: Column, classes: Column) -> Column:
    """Sorted distinct keys of a line's words: rarity class on top, hash bits below.

    Nothing in the arrays can be null, so that Spark sorts and walks plain longs.
    """
    def key(word: Column) -> Column:
        h = F.xxhash64(word)
        rarity = F.coalesce(F.get(classes, _bucket(h)), F.lit(0)).cast("long")
        return F.shiftleft(rarity, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.array_remove(F.array_distinct(F.sort_array(F.transform(_split(text), key))), key(F.lit("")))


def _before(y: str, x: str) -> Column:
    a, b = ([F.col(f"{t}.{c}") for c in _ORDER] for t in (y, x))
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _parity(half: int, mask: int) -> Column:
    """Bit b: parity of the keys whose low bits (``mask``) are ``half`` and b."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def add(acc: Column, k: Column) -> Column:
        bit = F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int"))
        return acc.bitwiseXOR(bit if mask == 63 else F.when(k.bitwiseAND(F.lit(mask - 63)) == half, bit).otherwise(zero))

    return F.aggregate("keys", zero, add)


_BITS = ("bits", "half", "low", "high")


def _bitmaps(n: Column) -> list[Column]:
    """Parity bitmaps of 64, 128 (sets over SMALL) and 256 bits (over 2 SMALL), each the fold of the next.

    ``half`` is the lower half of the 128 bits; ``low`` and ``high`` are the
    quarters of the 256 that fold into its two halves.  What is left out is a
    difference of what is there, and zero for smaller sets.
    """
    zero = F.lit(0).cast("long")
    return [_parity(0, 63).alias("bits"), F.when(n > SMALL, _parity(0, 127)).otherwise(zero).alias("half"),
            F.when(n > 2 * SMALL, _parity(0, 255)).otherwise(zero).alias("low"),
            F.when(n > 2 * SMALL, _parity(64, 255)).otherwise(zero).alias("high")]


def _tag(n: Column, at: Column, lost: Column) -> Column:
    """Size of a set, place of a word in its prefix and whether it is lost, in one long."""
    return F.shiftleft(n.cast("long"), 32).bitwiseOR(F.shiftleft(at.cast("long"), 1)).bitwiseOR(lost.cast("long"))


def _n(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.tag"), 32)


def _at(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.tag").bitwiseAND(F.lit((1 << 32) - 1)), 1)


def _lost(side: str) -> Column:
    return F.col(f"{side}.tag").bitwiseAND(F.lit(1).cast("long")) == 1


def _word_rows(sets: DataFrame, words: Column, classes: Column | None = None, lost: Column | None = None) -> DataFrame:
    """word (hashed with a size class), place of the line, tag and bitmaps, for the first ``words`` of each prefix.

    For every class of ``classes`` (own class if None); ``words`` may use the column ``class``.  The wider
    bitmaps are null for small sets, so that most rows stay narrow when they are shuffled.
    """
    n = F.col("n")
    wide = F.when(n > SMALL, F.struct("half", "low", "high")).alias("wide")
    lost = F.lit(False) if lost is None else lost
    own = _size_class(n) if classes is None else F.explode(classes)
    rows = sets.select(*_ORDER, "n", lost.alias("lost"), "bits", wide, "prefix", own.alias("class"))
    rows = rows.select(*_ORDER, "n", "lost", "bits", "wide", "class", F.posexplode(F.slice("prefix", F.lit(1), words)).alias("at", "word"))
    return rows.select(F.xxhash64("word", "class").alias("word"), *_ORDER, _tag(n, F.col("at"), F.col("lost")).alias("tag"), "bits", "wide")


def _differ() -> Column:
    """Differing bits of x and y in the widest bitmap that both sets have."""
    bits, half, low, high = (F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")) for c in ("bits", *(f"wide.{b}" for b in _BITS[1:])))
    other = bits.bitwiseXOR(half)
    wide = F.bit_count(half) + F.bit_count(other)
    widest = F.bit_count(low) + F.bit_count(half.bitwiseXOR(low)) + F.bit_count(high) + F.bit_count(other.bitwiseXOR(high))
    n = F.least(_n("x"), _n("y"))
    return F.when(n > 2 * SMALL, widest).when(n > SMALL, wide).otherwise(F.bit_count(bits))


def _least_own(n: Column) -> Column:
    """Words of a set of n that any similar set shares with it."""
    return F.ceil(n * NUM / DEN)


_X, _Y = [f"x_{c}" for c in _ORDER], [f"y_{c}" for c in _ORDER]


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS)).cast("int")


def _near(x: str, y: str) -> Column:
    """Filters for a pair that may be similar, the cheapest and strictest first.

    With s words in both sets together, similarity NUM / DEN means at least
    NUM s / (NUM + DEN) shared and at most (DEN - NUM) s / (NUM + DEN) differing
    words, and sizes whose ratio is NUM / DEN or more.
    """
    nx, ny = _n(x), _n(y)
    most = (nx + ny) * (DEN - NUM)
    folded = F.bit_count(F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits"))) * (NUM + DEN) <= most
    return folded & (nx * DEN >= ny * NUM) & (ny * DEN >= nx * NUM) & (_differ() * (NUM + DEN) <= most)


def _early_enough() -> Column:
    """Positional filter: with a common word at places i and j (from 0), enough words can be shared.

    The first word that similar sets share has all others they share behind it,
    in both sets.  At any common word, what they share before it is within the
    shorter part before, and what behind within the shorter part behind.
    """
    i, j, nx, ny = _at("x"), _at("y"), _n("x"), _n("y")
    enough = (nx + ny) * NUM
    behind = F.least(nx - i, ny - j)  # the word itself included
    return (behind * (NUM + DEN) >= enough) & ((F.least(i, j) + behind) * (NUM + DEN) >= enough)


def _pairs(joined: DataFrame, later: Column) -> DataFrame:
    """Places of the later line x and the earlier line y of each pair, once, and their differing bits.

    ``later``: whether the x of the join is the later one.
    """
    ends = [F.when(later, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(f"{a}_{c}")
            for a, b in (("x", "y"), ("y", "x")) for c in _ORDER]
    return joined.select(*ends, _differ().alias("differ")).groupBy(*_X, *_Y).agg(F.max("differ").alias("differ"))


def _meet(marked: DataFrame, part: int) -> DataFrame:
    """Pairs of similar size that meet at a prefix word (of one of ``PARTS`` parts) and pass the filters, the later line not lost.

    The smaller set, y here, shares NUM 2 / (NUM + DEN) of its words or more, so
    a shorter prefix does; of equal sizes, y is the earlier one.  A set meets
    others of its size class; as the smaller one it is sent to each class in
    which a similar larger set can be, to a higher one with the still shorter
    prefix that the least size there asks for.
    """
    def words(most: Column, classes: Column | None) -> DataFrame:
        return _word_rows(marked, most, classes, F.col("lost")).where(F.pmod("word", F.lit(PARTS)) == part)

    n = F.col("n")
    large = words(F.size("prefix"), None)
    small = words(_short_prefix(F.greatest(n, _least_of_class(F.col("class")))), F.sequence(_size_class(n), _size_class(F.floor(n * DEN / NUM))))
    later = _before("y", "x")
    wanted = _near("x", "y") & _early_enough() & ~F.when(later, _lost("x")).otherwise(_lost("y"))
    once = (_n("x") > _n("y")) | ((_n("x") == _n("y")) & later)
    return _pairs(large.alias("x").join(small.alias("y"), (F.col("x.word") == F.col("y.word")) & wanted & once), later)


def _least_of_class(c: Column) -> Column:
    """No set of size class ``c`` is smaller (rounding cannot make it larger than the least)."""
    return F.floor(F.pow(F.lit(CLASS), c) * (1 - 1e-9))


def _short_prefix(least: Column | None = None) -> Column:
    """Words of a set of n that hold the first word it shares with any similar set of ``least`` words (n if None) or more, n at least."""
    n = F.col("n")
    return (n - F.ceil((n + (n if least is None else least)) * NUM / (NUM + DEN)) + 1).cast("int")


def _once(parts: list[DataFrame]) -> DataFrame:
    """Pairs of all parts, each once."""
    return reduce(DataFrame.union, parts).groupBy(*_X, *_Y).agg(F.max("differ").alias("differ"))


def _places(pairs: DataFrame, side: list[str]) -> DataFrame:
    return pairs.select(*[F.col(c).alias(c[2:]) for c in side])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Places of the x lines of ``pairs`` whose word sets are similar."""
    def side(cols: list[str]) -> DataFrame:
        return texts.select(*[F.col(c[2:]).alias(c) for c in cols], F.col("words").alias(cols[0][0]))

    both = pairs.join(side(_X), _X).join(side(_Y), _Y)
    both = both.select(*_X, *[F.array_distinct(_words(F.col(t))).alias(t) for t in ("x", "y")])
    both = both.select(*_X, F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("both"))
    return _places(both.where(F.col("shared") * (NUM + DEN) >= F.col("both") * NUM), _X).distinct()


def _with_leads(sets: DataFrame) -> DataFrame:
    """Pairs of a set and the earliest set of its size class at a word of its short prefix that more than ``CROWD`` sets share there.

    What this misses, the second step finds.
    """
    words = _word_rows(sets, _short_prefix())
    crowds = save(words.groupBy("word").count().where(F.col("count") > CROWD).select("word"), "line-crowds")
    words = save(words.join(crowds, "word", "left_semi"), "line-crowds")
    leads = words.groupBy("word").agg(F.min(F.struct(*_ORDER, "tag", "bits", "wide")).alias("lead")).select("word", "lead.*")
    met = words.alias("x").join(leads.alias("y"), (F.col("x.word") == F.col("y.word")) & _near("x", "y") & _before("y", "x"))
    met = save(_pairs(met, F.lit(True)), "line-leads")
    for done in (crowds, words):
        delete(done)
    return met


def _maybe_among(places: DataFrame, rows: int) -> Column:
    """Whether a line may be one of ``places`` (``rows`` of them, about): true for each of them and for few others.

    Two hash bits of each place in a table of 8 to 16 bits a place, at most ``MOST_LONGS`` longs.
    """
    longs = min(MOST_LONGS, 1 << max(10, (rows // 8).bit_length()))
    one, h = F.lit(1).cast("long"), F.xxhash64(*_ORDER)
    slots = [x.bitwiseAND(F.lit(64 * longs - 1).cast("long")) for x in (h, F.shiftright(h, 32))]

    def bit(slot: Column) -> Column:
        return slot.bitwiseAND(F.lit(63).cast("long")).cast("int")

    own = places.select(F.explode(F.array(*slots)).alias("slot"))
    own = own.select(F.shiftright("slot", 6).alias("word"), F.call_function("shiftleft", one, bit(F.col("slot"))).alias("bits"))
    every = places.sparkSession.range(longs).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = own.unionAll(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.col("w.bits")).scalar()
    known = [F.call_function("shiftrightunsigned", F.get(table, F.shiftright(x, 6).cast("int")), bit(x)) for x in slots]
    return reduce(Column.__and__, [k.bitwiseAND(one) == 1 for k in known])


def _gone(pairs: DataFrame, once: DataFrame) -> DataFrame:
    """Places of the x lines of ``pairs`` that are similar to one of their y lines; ``once`` holds each line's text.

    A line is compared with its likeliest partner first and, if that fails, with the others.
    Few lines are in any pair, so the texts of most others are held back before they are shuffled.
    """
    pairs = save(pairs.select(*_X, *_Y, "differ"), "line-pairs")
    places = save(_places(pairs, _X).union(_places(pairs, _Y)).distinct(), "line-places")
    texts = save(once.where(_maybe_among(places, places.count())).join(places, _ORDER), "line-texts")
    delete(places)
    likeliest = pairs.groupBy(*_X).agg(F.min(F.struct("differ", *_Y)).alias("y")).select(*_X, "y.*")
    at_once = save(_verified(likeliest, texts), "lines-gone")
    standing = pairs.join(at_once.select(*[F.col(c).alias(f"x_{c}") for c in _ORDER]), _X, "left_anti")
    gone = save(at_once.union(_verified(standing, texts)), "lines-gone")
    for done in (pairs, texts, at_once):
        delete(done)
    return gone


def removed_lines(docs: DataFrame, unique: bool) -> DataFrame:
    """doc, version and line of every line that goes."""
    lines = line_rows(docs, unique)
    classes = rarity_classes(docs)
    n = F.size("keys")
    prefix = n - _least_own(n).cast("int") + 1
    keyed = lines.select(*_ORDER, word_keys(F.col("words"), classes).alias("keys"))
    keyed = save(keyed.select(*_ORDER, n.alias("n"), F.xxhash64("keys").alias("sig"), F.xxhash64(F.lit(1), "keys").alias("sig2"),
                              *_bitmaps(n), F.slice("keys", F.lit(1), prefix).alias("prefix")), "lines")

    first = F.min(F.struct(*_ORDER)).alias("at")
    sets = keyed.where("n > 0").groupBy("sig", "sig2").agg(first, F.first("n").alias("n"), *[F.first(c).alias(c) for c in (*_BITS, "prefix")])
    sets = save(sets.select("sig", "sig2", "at.*", "n", *_BITS, "prefix"), "line-sets")
    signed = save(keyed.where("n > 0").select(*_ORDER, "sig", "sig2"), "line-signatures")
    delete(keyed)

    once = lines if unique else lines.dropDuplicates(_ORDER)
    # Sets of up to three words are similar to equal sets only.
    several = F.col("n") * DEN >= (F.col("n") + 1) * NUM
    # One earlier partner is enough for a line to go: where many sets share a prefix word, they first meet only
    # the earliest of them, and what still stands then meets all others there.
    first_met = _with_leads(sets.where(several))
    gone = _gone(first_met, once)
    delete(first_met)
    lost = F.col("lost").isNotNull().alias("lost")
    marked = save(sets.join(gone.withColumn("lost", F.lit(True)), _ORDER, "left").select("sig", "sig2", *_ORDER, "n", *_BITS, lost, "prefix"), "line-sets")
    delete(sets)
    met = [save(_meet(marked.where(several), part), "line-met") for part in range(PARTS)]
    late = _gone(_once(met), once)
    for done in met:
        delete(done)

    firsts = marked.select("sig", "sig2", F.col("lost").alias("early"), *_ORDER).join(late.distinct().withColumn("late", F.lit(True)), _ORDER, "left")
    firsts = firsts.select("sig", "sig2", F.struct(*_ORDER).alias("first"), (F.col("early") | F.col("late").isNotNull()).alias("lost"))
    judged = signed.join(firsts, ["sig", "sig2"])
    return judged.where(F.col("lost") | (F.struct(*_ORDER) != F.col("first"))).select(*_ORDER).distinct()


def line_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (sorted line numbers from 0, comma-joined) of every row of ``docs``.

    ``n_lines`` counts all lines split at ``\\n`` (null text: 0); lines without a
    word stay.  A null id comes before all others.  Rows that share an id but
    not the text are documents of their own, ordered by their texts' hashes;
    rows that share both are one document.  Other columns are ignored.
    """
    unique = ids_are_unique(docs)
    gone = removed_lines(docs, unique).groupBy("doc", "version").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    text = F.col("text").cast("string")
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = F.when(text.isNull(), F.lit(0)).otherwise(ends + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc().alias("doc"), _version(unique).alias("version"),
                       lines.alias("n_lines"))
    out = rows.join(gone, ["doc", "version"], "left")
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; null texts stay null, other columns unchanged."""
    unique = ids_are_unique(docs)
    gone = removed_lines(docs, unique).groupBy("doc", "version").agg(F.collect_list("line").alias("removed"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _doc().alias("doc"), _version(unique).alias("version"))
    out = rows.join(gone, ["doc", "version"], "left")
    text = F.col("row.text").cast("string")
    last = F.size(F.split(text, "\n", -1)) - 1
    stay = F.array_except(F.sequence(F.lit(0), last), F.col("removed"))  # hashed, so linear in the lines
    lines = F.array(F.split(text, "\n", -1))  # bound once as a lambda's variable, not split again for each line
    kept = F.transform(lines, lambda own: F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n"))
    text = F.when(F.col("removed").isNull(), text).otherwise(F.get(kept, F.lit(0)))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_decisions(table(spark, sf_dir, "documents"))
