"""Versioned snapshot tables (write a new version, never overwrite a path
being read).

Plain Parquet has no MERGE, so a table update is written as a new version
directory ``v=<n>``; a version counts once its ``_SUCCESS`` marker exists
(Spark writes it on commit). Readers take the newest committed version.
Writing the same version again (a replayed micro-batch) replaces only that
version, which makes batch replays idempotent. All paths go through the
Hadoop FileSystem API so the folder can be any shared store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def subfolders(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers n of the complete folders ``<prefix><n>`` below ``root``, in order."""
    fs, path, jvm = _fs(spark, root)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[len(prefix):]))
    return sorted(out)


def versions(spark: SparkSession, root: str) -> list[int]:
    return subfolders(spark, root, "v=")


def latest(spark: SparkSession, root: str, at_most: int | None = None) -> DataFrame | None:
    """Newest committed version (at most ``at_most``): a replayed batch
    ``e`` reads version <= e and so never sees its own earlier output."""
    v = [x for x in versions(spark, root) if at_most is None or x <= at_most]
    if not v:
        return None
    return spark.read.parquet(f"{root.rstrip('/')}/v={v[-1]}")


def write_version(df: DataFrame, root: str, version: int) -> str:
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path
