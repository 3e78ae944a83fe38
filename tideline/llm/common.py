"""Shared helpers: tables, hold-out split, bounded training samples, cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch for operators that see whole texts: bounds a Python
#: worker's memory by this many texts.
TEXT_BATCH_ROWS = 1000
_HASH_STEPS = 1 << 20
_RARE_SPACES = ("\t", "\v", "\f", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def is_held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5 (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def hash_share(doc_id: Column, share: Column | float, salt: int = 7) -> Column:
    """True for a fixed pseudo-random ``share`` of ids."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return F.pmod(F.xxhash64(F.lit(salt), doc_id), F.lit(_HASH_STEPS)) < share * F.lit(float(_HASH_STEPS))


def sample_share(rows: int, wanted: int) -> float:
    """Share of ids that gives about ``wanted`` of ``rows`` rows."""
    return 1.0 if rows <= wanted else wanted / rows


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a whole text; null: 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    odd = F.lit(False)
    for c in _RARE_SPACES:
        odd = odd | F.contains(text, F.lit(c))
    plain = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1)
    parts = F.when(odd, F.split(text, r"[\x20\x09-\x0D]+", -1)).otherwise(plain)
    return F.size(F.array_remove(parts, "")).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``.

    A private temporary folder is used only where the setting is absent and
    the master is local (tests); elsewhere its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tideline-llm-")
    return shared_dir.own


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    The files outlive lost executors.  They stay until the shared folder is
    cleaned, since the returned frame is lazy and may be read at any later time.
    """
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    _release(df.sparkSession)
    df.write.option("parquet.enable.dictionary", "false").parquet(path)
    _release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now: their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def ids_are_unique(docs: DataFrame) -> bool:
    """No null and no repeated doc_id."""
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return n == ids


def delete(df: DataFrame) -> None:
    """Remove the files of a saved frame that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
