"""Session construction and cluster-safe scratch locations.

Everything here is configuration a Spark user would set on a session; no
scheduling or storage of our own.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of the library relies on.  AQE re-plans joins from runtime
# sizes (broadcast only when the measured side is small), coalesces small
# shuffle partitions and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


# Cluster profile for inputs of tens of terabytes.  Shuffles start with many
# partitions and AQE coalesces them to ~256 MB each (so a 100 TB shuffle runs
# as ~400k tasks of bounded size, spilling rather than failing); scans split
# files into 256 MB ranges; a join side is broadcast only when its measured
# size is below 64 MB.  Skewed join partitions (5x the median and > 512 MB)
# are split by AQE.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_session(master: str | None = None, app: str = "riskloom",
                shuffle_partitions: int | None = None, extra: dict | None = None,
                cluster: bool = False) -> SparkSession:
    """A session with the library's settings; ``cluster=True`` adds
    ``CLUSTER_CONF`` (explicit ``shuffle_partitions`` / ``extra`` win)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**BASE_CONF, **(CLUSTER_CONF if cluster else {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the operator (a shared file system or
    object store).  Only when it is unset and everything runs in this process,
    as in local tests, a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run, once
    per application."""
    sc = spark.sparkContext
    name = f"riskloom-{sc.applicationId}.zip"
    if any(f.endswith(name) for f in sc.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="riskloom-"), name[:-4])
    sc.addPyFile(shutil.make_archive(base, "zip", root, "riskloom"))


def prepare(spark: SparkSession) -> SparkSession:
    """What every job of the library needs: a checkpoint folder and the package
    on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df):
    """Reliable checkpoint (written to the shared checkpoint folder).

    Survives executor loss, unlike a local checkpoint; used between the
    phases of multi-pass algorithms so partition ids and values stay fixed.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
