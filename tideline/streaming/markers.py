"""The stateless timeline operators over a stream of records.

Records arriving as a stream are merged with the (static) subject table and
turned into marker rows as they come; the bar per subject is an aggregate and
stays a batch job over what the stream has written.  The merge is a
stream-static left join, which Structured Streaming supports without state;
the marker sink writes Parquet with a checkpoint location in the shared
checkpoint folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tideline.functions.dates import day_diff
from tideline.operators.merge import OrderItem, merge_subjects
from tideline.operators.timeline import category_markers


def stream_markers(
    records: DataFrame,
    subjects: DataFrame,
    key: str | tuple[str, str],
    reference: str,
    time: str,
    category: str,
    subject: str | None = None,
    order: Sequence[OrderItem] | None = None,
) -> DataFrame:
    """Merge a record stream with the subject table and emit category markers.

    ``x`` is the study day ``floor(time - reference) + 1``.  Works on a
    streaming or a batch ``records`` DataFrame alike.
    """
    merged = merge_subjects(records, subjects, key, order=order)
    subject = subject or (key if isinstance(key, str) else key[0])
    merged = merged.withColumn("_day", day_diff(reference, time, inclusive=True))
    return category_markers(merged, subject, "_day", category)


def start_marker_sink(
    markers: DataFrame, path: str, checkpoint: str | None = None,
    trigger_once: bool = False, query_name: str | None = None,
) -> StreamingQuery:
    """Append markers to Parquet at ``path``.

    The checkpoint must be the same folder after a restart, or the source's
    position is lost.  So it is either given, or named by ``query_name`` under
    the shared folder set as ``spark.checkpoint.dir``.
    """
    if checkpoint is None:
        base = markers.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base or not query_name:
            raise ValueError("give a checkpoint, or a query_name and spark.checkpoint.dir")
        checkpoint = f"{base.rstrip('/')}/stream-{query_name}"
    writer = (
        markers.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if query_name:
        writer = writer.queryName(query_name)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
