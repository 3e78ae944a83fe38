import tempfile

from conftest import SMOKE_DIR, rows
from tideline.sources import load_table
from tideline.streaming import start_marker_sink, stream_markers


def test_stream_markers_equal_batch(spark):
    li = load_table(spark, SMOKE_DIR, "lineitem")
    orders = load_table(spark, SMOKE_DIR, "orders")
    src = tempfile.mkdtemp(prefix="tideline-stream-src-")
    li.repartition(3).write.mode("overwrite").parquet(f"{src}/in")
    stream = spark.readStream.schema(li.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{src}/in")
    markers = stream_markers(stream, orders, ("l_orderkey", "o_orderkey"), "o_orderdate",
                             "l_shipdate", "l_returnflag")
    out = tempfile.mkdtemp(prefix="tideline-stream-")
    q = start_marker_sink(markers, f"{out}/markers", checkpoint=f"{out}/ckpt",
                          trigger_once=True, query_name="markers_test")
    q.awaitTermination(120)
    got = spark.read.parquet(f"{out}/markers")
    batch = stream_markers(li, orders, ("l_orderkey", "o_orderkey"), "o_orderdate",
                           "l_shipdate", "l_returnflag")
    assert rows(got) == rows(batch.select(*got.columns))
