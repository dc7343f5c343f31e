"""New URIs of a stream of accepted entries, each once, with bounded state.

``dropDuplicatesWithinWatermark`` remembers a URI until the watermark has passed its
first arrival by ``delay``: state holds the URIs of that span, not of all time. The
watermark follows the arrival of files, not the entries' dates, so no entry is late,
whatever its date. What comes again after that span, or is stored already, is
dropped by an anti join with the stored URIs and with those that earlier batches
wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import new_uris
from ..session import cut_lineage

URIS = "uri string"


def start_uri_stream(spark: SparkSession, accepted_dir: str, accepted_schema, stored: DataFrame, out: str, checkpoint: str,
                     delay: str = "1 hour", available_now: bool = True, period: str = "900 seconds") -> StreamingQuery:
    """URIs of landing accepted entries that are new, to ``out/batch=<n>``; ``stored`` has ``uri``."""
    src = spark.readStream.schema(accepted_schema).format("parquet").load(accepted_dir)
    once = src.select("uri", F.col("_metadata.file_modification_time").alias("t")).where("uri is not null") \
        .withWatermark("t", delay).dropDuplicatesWithinWatermark(["uri"])

    def run_batch(batch: DataFrame, epoch: int) -> None:
        # a batch's own folder does not count: a replay writes it again
        earlier = read_uris(spark, out, before=epoch)
        fresh = new_uris(batch, stored.select("uri").unionByName(earlier))
        cut_lineage(fresh).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    w = once.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)).start()


def read_uris(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """URIs written by all batches, or by those before ``before``."""
    from ..sources.snapshots import subfolders
    names = [n for n in subfolders(spark, out, "batch=") if before is None or n < before]
    if not names:
        return spark.createDataFrame([], URIS)
    return spark.read.schema(URIS).parquet(*[f"{out}/batch={n}" for n in names])
