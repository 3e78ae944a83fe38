"""Hot-subject check on data derived from the driver tables.

Usage: python scripts/skew_check.py [sf_dir] > SKEW.md

Records: ``lineitem`` with one order key owning a third of all rows (every
row kept: the key of each row with return flag ``R``, a third of the table, is
replaced by the hot key).  The generic merge onto ``orders`` runs with broadcast joins off, as
for a subject table too large to broadcast, once plainly and once with
the split join.  Reported per run: wall time and the largest share of
joined rows that one task of the join stage produced.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tideline.operators.merge import merge_subjects  # noqa: E402
from tideline.session import build_session  # noqa: E402
from tideline.sources import load_table  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    # proportions of a cluster run: many shuffle partitions, none of them
    # merged again (at 100 TB every partition is far above the coalescing
    # target; at sf0.1 AQE would fold all 64 back into a few tasks)
    spark = build_session(shuffle_partitions=64, extra_conf={
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        # the split's sizes, scaled down with the data
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512k",
    })
    li = load_table(spark, sf_dir, "lineitem")
    orders = load_table(spark, sf_dir, "orders")
    hot_key = li.agg(F.min("l_orderkey")).first()[0]
    records = li.withColumn(
        "l_orderkey", F.when(F.col("l_returnflag") == "R", F.lit(hot_key)).otherwise(F.col("l_orderkey")))
    # many files, as a large table has: a hot key is split by map tasks
    files = tempfile.mkdtemp(prefix="tideline-skew-") + "/items"
    records.repartition(32).write.parquet(files)
    records = spark.read.parquet(files)
    n = records.count()
    n_hot = records.filter(F.col("l_orderkey") == hot_key).count()
    print(f"# Hot-subject merge ({os.path.basename(sf_dir)})\n")
    print(f"Records: {n:,} rows; the hot subject owns {n_hot:,} ({n_hot / n:.0%}). "
          "They lie in 32 files. Generic merge onto `orders` (subject columns `o_orderdate`, `o_orderpriority`), "
          "broadcast joins off, `local[8]`, `spark.sql.shuffle.partitions=64`, AQE on but "
          "partition coalescing off (at 100 TB no partition is small enough to be coalesced; "
          "at sf0.1 AQE would fold the 64 partitions into a few tasks and hide the split). "
          "Advisory partition size 256 KB, skew threshold 512 KB.\n")
    print("| route | wall time (s, median of 3) | largest task share of joined rows | tasks holding the hot subject |")
    print("|---|---|---|---|")
    for label, split in (("plain join", False), ("split join", True)):
        times = []
        for _ in range(3):
            t0 = time.perf_counter()
            m = merge_subjects(records, orders, ("l_orderkey", "o_orderkey"),
                               cols=["o_orderdate", "o_orderpriority"], split_hot=split)
            m.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        tagged = m.withColumn("_p", F.spark_partition_id())
        per_task = tagged.groupBy("_p").agg(
            F.count(F.lit(1)).alias("rows"),
            F.bit_xor(F.xxhash64(*records.columns)).alias("all_columns"),  # whole rows move, as in the timed run
            F.count_if((F.col("l_orderkey") == hot_key) & F.col("o_orderdate").isNotNull()).alias("hot"),
        ).collect()
        largest = max(r["rows"] for r in per_task) / n
        hot_tasks = sum(1 for r in per_task if r["hot"] > 0)
        print(f"| {label} | {sorted(times)[1]:.2f} | {largest:.0%} | {hot_tasks} |")
    spark.stop()


if __name__ == "__main__":
    main()
