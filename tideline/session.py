"""Session construction and the few cluster-wide settings the operators rely on.

The operators never build a session themselves; they take the caller's.  This
module gives tests, the bench and the entry point one consistent configuration:

* ``spark.sql.session.timeZone=UTC`` so day arithmetic on ``timestamp`` inputs
  does not move with the machine's zone;
* adaptive execution on, with skew-join splitting forced even when it costs an
  extra exchange: one subject may own a third of all records, and the split is
  what keeps that subject out of a single task;
* the broadcast decision left to Spark's size checks (static statistics and,
  under AQE, measured shuffle sizes), never to an unconditional hint.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session used by this library should carry.
ENGINE_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None,
    app_name: str = "tideline",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with :data:`ENGINE_CONF` applied.

    Master, shuffle partitions and driver memory are set only when asked for;
    otherwise they are what the submit command or the cluster says.
    """
    builder = SparkSession.builder.appName(app_name)
    conf = dict(ENGINE_CONF)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            conf["spark.driver.memory"] = os.environ.get("TIDELINE_DRIVER_MEMORY", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, setting one only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    given.  A private temporary folder is created only for a ``local`` master
    (tests, bench); a non-local session without the setting is an error, since
    a machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running operators that cut lineage"
        )
    path = tempfile.mkdtemp(prefix="tideline-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
