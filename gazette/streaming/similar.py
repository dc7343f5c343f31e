"""Sliding 12 h similarity over an article stream (exact mode).

State is the ``recent`` table (id, ct, site, words) kept as epoch-versioned
snapshots. Each micro-batch: score the batch's articles against the state
and against each other in (create_time, id) order with the same blocked join
as the batch operator (word-set pairs and running counts; article pairs
are never formed), append (id, importance) to the output folder
(one sub-folder per batch id, overwritten on replay), insert the new articles
if absent, and evict rows with ``create_time <= max_time - window``, where
``max_time`` is the processing time at most.

Event time is used for both "now" and order (strict window). Articles that come
later than ``late_hours`` after the newest one find only what is left of their
window; with a larger ``late_hours`` the state is kept for so much longer.
``streaming.interval`` is the native alternative, a stream-stream join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed import SIMILARITY_THRESHOLD, SIMILARITY_WINDOW_HOURS
from ..operators.similarity import importance_counted, prepare
from ..sources.snapshots import latest, write_version

STATE_SCHEMA = "id long, ct timestamp, site string, words array<string>"


def start_similarity_stream(spark: SparkSession, articles_dir: str, articles_schema,
                            state_root: str, out_root: str, checkpoint: str,
                            threshold: float = SIMILARITY_THRESHOLD,
                            window_hours: int = SIMILARITY_WINDOW_HOURS,
                            available_now: bool = True,
                            file_format: str = "parquet", late_hours: int = 0,
                            files_per_batch: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(articles_schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = reader.load(articles_dir)

    def run_batch(batch: DataFrame, epoch: int) -> None:
        from ..session import cut_lineage
        recent = latest(spark, state_root, at_most=epoch)
        if recent is None:
            recent = spark.createDataFrame([], STATE_SCHEMA)
        # the first article of an id counts, also within the batch
        rows = prepare(batch)
        first = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), F.struct("ct", "site", "words")).alias("r"))
        new = cut_lineage(first.select("r.*"))
        fresh = new.join(recent.select("id"), "id", "left_anti")
        combined = recent.unionByName(fresh)
        out = importance_counted(combined, threshold, window_hours, prepared=True,
                                 only=new.select("id"))
        out.write.mode("overwrite").parquet(f"{out_root.rstrip('/')}/batch={epoch}")
        # an article dated in the future must not push the window's present ones out
        horizon = combined.agg(F.least(F.max("ct"), F.current_timestamp()).alias("m"))
        kept = combined.join(F.broadcast(horizon), F.col("ct") > F.col("m") - F.expr(
            f"INTERVAL {int(window_hours) + int(late_hours)} HOURS")).drop("m")
        write_version(kept, state_root, epoch + 1)

    w = src.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="60 seconds")
    return w.start()


def read_output(spark: SparkSession, out_root: str) -> DataFrame:
    return spark.read.parquet(out_root).select("id", "importance")
