"""Helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bound on rows of a side we broadcast without looking at it again.
DEFAULT_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking it has at most ``max_rows`` rows.

    Beyond the bound the plain DataFrame is returned and Spark shuffles
    (AQE may still pick a broadcast from runtime statistics). The check costs
    one count of ``df``; call it on dimension tables or materialised results.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


#: Bytes of a side, as rows in memory, up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame):
    """Bytes of a row in memory (a Column): fixed-size fields, and what strings, binaries and arrays of numbers hold."""
    total = F.lit(8 + 8 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        elif kind == "array":
            total = total + 8 * F.coalesce(F.size(F.col(f"`{f.name}`")), F.lit(0))
    return total


def fits_bytes(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the rows of ``df`` hold at most ``max_bytes`` (one aggregation; call it on written tables)."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes


def broadcast_if_bytes(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, broadcast if its measured bytes are at most ``max_bytes``; else Spark shuffles."""
    return F.broadcast(df) if fits_bytes(df, max_bytes) else df


def byte_size(text: str) -> int:
    """'134217728', '128m', '128MB', '1g' -> bytes."""
    t = str(text).strip().lower().rstrip("b")
    mult = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}
    if t and t[-1] in mult:
        return int(float(t[:-1]) * mult[t[-1]])
    return int(t)


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of ``df`` (from file sizes; nothing is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Input bytes beyond which ``spread`` leaves the partitions as they are.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition before row-heavy work, only for small inputs.

    A small table may be stored in one row group and would run on one core;
    spreading it costs a shuffle of at most SPREAD_BYTES, however many cores there
    are. Larger inputs are left alone: they have splits enough (decided from the
    optimizer's size estimate, without running anything).
    """
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    max_split = byte_size(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728"))
    if estimated_bytes(df) < min(target * max_split, SPREAD_BYTES):
        return df.repartition(target)
    return df
