"""Session construction and shared-storage helpers.

Scratch data and checkpoints live under the folder named by the session's
``spark.checkpoint.dir``.  On a cluster that folder must be shared storage set
by the deployment; we only invent a local one when running in local mode
(tests, bench) and the setting is absent.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "airshed",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """SparkSession with the settings the job relies on.

    AQE re-plans joins (broadcast of small sides found at run time) and splits
    skewed shuffle partitions; the UI is off (no server in batch runs).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # compact serialisation for cached / checkpointed RDDs (MLlib trees, ranks)
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        # remove checkpoint files once the checkpointed data is unreachable
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session.  Only in local mode, and
    only when unset, a fresh folder under the system temp dir is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not _is_local(spark):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; point it at shared storage "
                "(a machine-local folder does not survive executor loss)")
        path = tempfile.mkdtemp(prefix="airshed-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex}"


def pinned(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back.

    Cuts lineage (a lost executor costs tasks of the reading step only) and
    gives the planner a measured size; nothing is held in executor storage.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this session's checkpoint folder.

    For callers that have consumed their results: lazy frames that read a
    scratch table can't be evaluated afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
