"""Operator 12: mixing sources to target weights by systematic sampling.

A source's target is its weight's part of ``share`` times all words, but at most
``cap`` times its own words; what a capped source leaves goes to the others by
weight.  Every document of a source is expected ``target / source size`` times.
These expectations are summed along the source's documents, one random offset is
added, and a document is emitted once for each integer that the running sum
crosses in it: never more than ``cap`` times, rounded up.

Only DataFrame functions are used.  The documents of a source stand in order of
size class, so the words taken miss the target by about one long document at
most, however sizes are spread.  Running sums come in three steps, so no task
ever sees a source's documents together: over the size classes of a source, over
the hash slices (of about ``slice_rows`` documents) of a class, and over the
documents of a slice.  Equal rows are one counted row until the end.  The only
table in one task is the list of sources, one row each, which the targets need
in order.

The running sum is exact: rates are multiples of 2^-32 and sums are decimals, so
reruns agree on any cluster.  Null texts have no words; a null source stands
after all others; null and repeated ids are allowed, and rows that share source,
id and text are interchangeable.  Other columns are ignored.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import save, table, word_count
from tideline.operators.skew import join_one_per_key

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)       # 150 % of all words
CAP = 2
SEED = 12
SLICE_ROWS = 1 << 15
CHUNK = 1 << 12      # equal rows written out by one step
UNIT = 1 << 32
CLASSES = 64         # size classes in each doubling of the size
_KEY = ("source", "doc_id", "size", "digest")


def size_class(size: Column) -> Column:
    """Grows with the size: small sizes alone, then CLASSES to a doubling."""
    bits = F.length(F.bin(size))
    part = F.call_function("shiftright", size, bits - F.lit(CLASSES.bit_length())).bitwiseAND(F.lit(CLASSES - 1).cast("long"))
    return F.when(size < CLASSES, size).otherwise(bits * CLASSES + part).cast("long")


def _hashed(text: Column) -> Column:
    """32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """place, weight, target and rate (in 2^-32) of each row of ``sources`` (source, source_size)."""
    over, under = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight.cast("long"))
    rows = rows.withColumn("most", F.col("source_size") * cap)
    # Sources reach their cap in the order of cap to weight; with those before a source capped, this is a unit weight's part.
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = F.coalesce(F.sum("most").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rest = F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("part", (whole * over - before * under).cast("double") / (rest * under).cast("double"))
    fits = F.when(F.col("part") * F.col("weight") <= F.col("most"), F.col("part"))
    # The first that fits holds for all from there on; it is the smallest one.
    level = F.first(fits, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("target", F.least(F.col("most").cast("double"), level * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)))).otherwise(F.lit(0))
    return rows.select("source", "source_size", "place", "target", rate.cast("long").alias("rate"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP,
             seed: int = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for equal rows (source, doc_id, size, digest of the text): how many there are (``times``) and ``copies`` of them all.

    ``source_size`` and ``target`` are those of the source.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
                       word_count(text).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"))
    groups = save(rows.groupBy(*_KEY).agg(F.count("*").alias("times")), "mix-groups")

    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    sources = save(source_targets(sizes, weights, share, cap), "mix-sources").withColumnRenamed("source", "name")
    placed = join_one_per_key(groups, sources, "source", "name", "left", null_safe=True).drop("name")
    placed = placed.withColumn("class", size_class(F.col("size")))
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("digest"))
    placed = placed.withColumn("spread", _hashed(ident))

    classes = placed.groupBy("place", "class").agg(F.sum("times").alias("n"))
    w = Window.partitionBy("place").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(F.col("place").alias("c_place"), F.col("class").alias("c_class"),
                             F.greatest(F.lit(1), F.ceil(F.col("n") / slice_rows)).alias("slices"),
                             F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")).alias("class_start"))
    sliced = placed.join(classes, (F.col("place") == F.col("c_place")) & (F.col("class") == F.col("c_class"))).drop("c_place", "c_class")
    sliced = sliced.withColumn("slice", F.col("spread") % F.col("slices")).drop("spread", "slices")

    slices = sliced.groupBy("place", "class", "slice").agg(F.sum("times").alias("n"))
    w = Window.partitionBy("place", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("place", "class", "slice", F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")).alias("slice_start"))
    w = Window.partitionBy("place", "class", "slice").orderBy("size", F.col("doc_id").asc_nulls_last(), "digest")
    last = F.sum("times").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = sliced.join(slices, ["place", "class", "slice"]).withColumn("last", F.col("class_start") + F.col("slice_start") + last)

    offset = _hashed(F.concat(F.lit(f"{seed}/"), F.col("place").cast("string")))
    ranked = ranked.withColumn("offset", offset)

    def crossed(rank: str) -> Column:
        return F.expr(f"(cast({rank} as decimal(20,0)) * cast(rate as decimal(18,0)) + cast(offset as decimal(18,0))) div cast({UNIT} as decimal(18,0))")

    return ranked.select(*_KEY, "source_size", "target", "times", (crossed("last") - crossed("last - times")).alias("copies"))


def _written_out(rows: DataFrame, count: str, at: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0 as ``at``; many repeats of one row go to many tasks."""
    chunks = rows.where(F.col(count) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / CHUNK))))
    chunks = chunks.hint("rebalance")
    end = F.least(F.col(count), (F.col("chunk") + 1) * CHUNK) - 1
    return chunks.withColumn(at, F.explode(F.sequence(F.col("chunk") * CHUNK, end))).drop("chunk")


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of every row of ``docs``; ``how`` as for mix_plan."""
    plan = mix_plan(docs, **how)
    low = F.expr("copies div times")
    rows = _written_out(plan.withColumn("low", low).withColumn("high", F.col("copies") - F.col("low") * F.col("times")), "times", "at")
    rows = rows.withColumn("copies", F.col("low") + (F.col("at") < F.col("high")).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: ``doc_id``, ``source`` and ``text``, as often as the plan takes each."""
    plan = mix_plan(docs, **how).where("copies > 0").select(*[F.col(c).alias(f"p_{c}") for c in ("source", "doc_id", "digest")], "copies")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       text.isNull().alias("none"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"))
    rows = rows.groupBy("source", "doc_id", "digest").agg(F.min("text").alias("text"))
    same = F.lit(True)
    for c in ("source", "doc_id", "digest"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return _written_out(rows.join(plan, same), "copies", "copy").select("doc_id", "source", "text")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
