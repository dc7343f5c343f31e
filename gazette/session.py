"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every gazette job relies on. Timestamps are UTC end to end; AQE
# re-plans joins and coalesces shuffle partitions from runtime statistics and
# splits skewed join partitions (one hot URI / token / feed can hold a third
# of the rows).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # AQE splits / coalesces shuffle partitions towards this size, and files
    # are read in splits of at most this size: both keep tasks well inside
    # executor memory whatever the scale.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
    # reliable checkpoints are deleted once their DataFrame is unreachable,
    # so the shared checkpoint folder does not grow with every job
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "gazette",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the gazette defaults.

    On a cluster leave ``master`` as None so spark-submit decides. The number
    of shuffle partitions should be sized to the data (about 128-256 MB per
    partition); AQE coalesces small ones at runtime.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session without any
    setting (tests) gets a private temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder would not survive the
    loss of that machine.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gazette-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder.

    Used for materialised tables (snapshots, streaming checkpoints) so a job
    never overwrites a path it is still reading.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/gazette/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder (reliable checkpoint).

    Survives executor loss, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_cpus() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 256 << 20,
                           minimum: int = 8) -> int:
    """Initial ``spark.sql.shuffle.partitions`` for an input of ``input_bytes``:
    about ``target_bytes`` per partition (AQE then coalesces small ones and
    splits skewed ones). 100 TB -> ~400k partitions; sf0.1 -> the minimum."""
    return max(minimum, -(-int(input_bytes) // target_bytes))
