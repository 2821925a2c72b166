"""Session construction and the shared staging folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def scale_conf(input_bytes: int, executors: int, cores_per_executor: int,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Shuffle / scan settings sized for the data instead of Spark's fixed defaults.

    Initial shuffle partitions give ~``target_partition_bytes`` per partition of the
    input (AQE coalesces small ones and splits skewed ones at run time), never fewer
    than two waves of the cluster's cores.  For very large inputs raise
    ``target_partition_bytes``: the driver tracks every partition.
    """
    cores = max(1, executors * cores_per_executor)
    parts = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def build_session(master: str | None = None, app: str = "regspark",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None,
                  sizing: tuple[int, int, int] | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE, skew-join splitting and UTC time.

    ``sizing = (input_bytes, executors, cores_per_executor)`` applies :func:`scale_conf`.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if sizing:
        settings.update(scale_conf(*sizing))
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from ``spark.checkpoint.dir`` (or an already set checkpoint dir); only when
    neither is set and the master is local (tests) a private folder is created and
    registered; on a cluster that folder would be a different disk on every machine.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="regspark-ckpt-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint root."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staging_root(spark: SparkSession) -> str:
    """This application's folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/regspark/{spark.sparkContext.applicationId}"


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark resolves it to."""
    p, fs = _hadoop_path(spark, path)
    return fs.makeQualified(p).toString()


def path_version(spark: SparkSession, path: str) -> tuple:
    """Modification time and total length: changes when the files under ``path`` do."""
    p, fs = _hadoop_path(spark, path)
    return fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()


def drop_staging(spark: SparkSession) -> bool:
    """Delete what this application staged; call it when its results are no longer read."""
    p, fs = _hadoop_path(spark, staging_root(spark))
    return fs.delete(p, True)


def cut_lineage(df, spark: SparkSession | None = None, name: str = "stage", fmt: str = "parquet"):
    """Materialise ``df`` as a table in the shared folder and read it back.

    Survives executor loss (unlike a local checkpoint) and gives later stages exact
    file statistics.
    """
    spark = spark or df.sparkSession
    path = staging_path(spark, name)
    df.write.mode("overwrite").format(fmt).save(path)
    return spark.read.format(fmt).load(path)
