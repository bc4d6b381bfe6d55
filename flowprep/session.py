"""Session construction and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "flowprep",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session with AQE on; on a cluster the submit config wins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_tb: float, partition_mb: int = 256, broadcast_mb: int = 64) -> dict[str, str]:
    """Session settings sized for an input of ``input_tb`` terabytes.

    Shuffles start with one partition per ``partition_mb`` of input (AQE then
    merges small ones toward the same advisory size and splits skewed join
    partitions); scans read ``partition_mb`` splits; broadcasts are capped.
    Pass the result as ``get_session(extra=...)`` or ``--conf`` pairs.
    """
    parts = max(200, int(input_tb * 1024 * 1024 / partition_mb))
    mb = partition_mb * 1024 * 1024
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(mb),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(mb),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_mb * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(broadcast_mb * 1024 * 1024),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory named by the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we only invent
    one when it is unset *and* the master is local (tests, laptops).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001  (not a runtime SQL conf in this deployment)
            conf_dir = None
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="flowprep-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Survives lost executors, runs the plan once, and later reads are pruned to
    the columns they use.  Columns are stored by position, so any names do.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    stored = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = stored.schema
    stored.write.parquet(path)
    return spark.read.schema(schema).parquet(path).toDF(*df.columns)
