"""Log record intake: JSON bodies ``{level, message, ts}`` -> log lines, from a table or a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed import LOG_LINE_TEMPLATE
from ..functions.text import fill

LOG_SCHEMA = "level string, message string, ts string"
_CORRUPT = "_corrupt_record"


def parse_logs(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``level``, ``message``, ``ts`` parsed from the JSON column; rows
    that do not parse keep NULLs (no exception for one bad record)."""
    r = F.from_json(F.col(value_col), LOG_SCHEMA)
    return raw.withColumns({"level": r["level"], "message": r["message"], "ts": r["ts"]})


def log_lines(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``line`` in the fixed log-line format."""
    p = parse_logs(raw, value_col)
    return p.withColumn("line", fill(LOG_LINE_TEMPLATE, ts=F.col("ts"), message=F.col("message")))


def sorted_out(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Add ``bad``: why a record makes no log line, NULL for a good one.

    ``not JSON`` (also truncated or empty), else the name of the first missing field."""
    r = F.from_json(F.col(value_col), f"{LOG_SCHEMA}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    parsed = raw.withColumn("_r", r)
    value = F.trim(F.coalesce(F.col(value_col), F.lit("")))
    bad = F.when((value == "") | F.col("_r").isNull() | F.col(f"_r.{_CORRUPT}").isNotNull(), F.lit("not JSON"))
    for name in ("level", "message", "ts"):
        bad = bad.when(F.col(f"_r.{name}").isNull(), F.lit(f"no {name}"))
    return parsed.withColumns({"level": F.col("_r.level"), "line": fill(LOG_LINE_TEMPLATE, ts=F.col("_r.ts"), message=F.col("_r.message")),
                               "bad": bad}).drop("_r")


def start_log_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, available_now: bool = True,
                     period: str = "60 seconds", files_per_batch: int | None = None) -> StreamingQuery:
    """Log lines from landing files of JSON lines: good ones to ``out/lines``, the others to ``out/quarantine``.

    Each batch writes one folder of its own in both, again when it is replayed, so no
    record is lost or doubled. A record is a line; every line lands in one of the two."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = reader.load(landing)

    def run_batch(batch: DataFrame, epoch: int) -> None:
        rows = sorted_out(batch)
        rows.where("bad is null").select("level", "line").write.mode("overwrite").parquet(f"{out}/lines/batch={epoch}")
        rows.where("bad is not null").select("bad", "value").write.mode("overwrite").parquet(f"{out}/quarantine/batch={epoch}")

    w = src.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)).start()
