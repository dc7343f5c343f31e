"""Outbox: messages sent once, whatever batch is killed when.

For each batch, in this order: the messages to send are written to ``claims``
(those whose id no earlier batch claimed; of equal ids the first by text), an attempt
is logged, the sender delivers them, and they are written to ``sent``. Claims are
complete before anything is sent and never written again, so a batch that was
killed and is replayed has the same messages. What it had delivered before it was
killed is asked from the target (``delivered``, message ids), and only the
rest is sent. The default sender writes a folder per batch, replaced as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.publish import republish
from ..sources.snapshots import subfolders, write_version

MESSAGE = "message_id string, channel string, text string, button string"


class Outbox:
    """The outbox below `root`; `send(messages, batch)` delivers, `delivered()` tells the ids that have arrived."""

    def __init__(self, spark: SparkSession, root: str, send: Callable[[DataFrame, int], None] | None = None,
                 delivered: Callable[[], DataFrame] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self._send, self._delivered = send or self._write, delivered

    def _write(self, messages: DataFrame, batch: int) -> None:
        messages.write.mode("overwrite").parquet(f"{self.root}/target/batch={batch}")

    def _table(self, name: str, before: int | None = None) -> DataFrame:
        folders = [f"{self.root}/{name}/v={n}" for n in subfolders(self.spark, f"{self.root}/{name}", "v=") if before is None or n < before]
        return self.spark.read.schema(f"{MESSAGE}, v int").option("basePath", f"{self.root}/{name}").parquet(*folders) if folders \
            else self.spark.createDataFrame([], f"{MESSAGE}, v int")

    def publish(self, messages: DataFrame, batch: int) -> None:
        """Sends the messages of one batch that were not sent before; may be called again for the same batch."""
        names = ["message_id", "channel", "text", "button"]
        if batch in subfolders(self.spark, f"{self.root}/sent", "v="):
            return
        again = batch in subfolders(self.spark, f"{self.root}/claims", "v=")
        if not again:
            new = republish(messages.select(F.col("message_id").cast("string").alias("message_id"), *names[1:]), self._table("claims", before=batch))
            once = new.where("message_id is not null").groupBy("message_id").agg(F.min(F.struct("text", "channel", "button")).alias("m"))
            write_version(once.select("message_id", "m.channel", "m.text", "m.button"), f"{self.root}/claims", batch)
        claimed = self.spark.read.schema(MESSAGE).parquet(f"{self.root}/claims/v={batch}")
        todo = republish(claimed, self._delivered().select(F.col("message_id").cast("string"))) if again and self._delivered else claimed
        self.spark.createDataFrame([(batch,)], "batch int").write.mode("append").parquet(f"{self.root}/attempts")
        self._send(todo, batch)
        write_version(claimed, f"{self.root}/sent", batch)

    def status(self) -> DataFrame:
        """(message_id, channel, state, attempts): every claimed message, ``sent`` or ``pending``, and how often its batch was tried."""
        sent = self._table("sent").select("message_id", F.lit("sent").alias("state"))
        tries = self.spark.read.schema("batch int").parquet(f"{self.root}/attempts").groupBy(F.col("batch").alias("v")).agg(F.count(F.lit(1)).alias("attempts"))
        return self._table("claims").join(sent, "message_id", "left").join(tries, "v", "left").select(
            "message_id", "channel", F.coalesce("state", F.lit("pending")).alias("state"), F.coalesce("attempts", F.lit(0)).cast("long").alias("attempts"))


def start_outbox_stream(spark: SparkSession, messages_dir: str, schema, outbox: Outbox, checkpoint: str, available_now: bool = True,
                        period: str = "60 seconds", files_per_batch: int | None = None) -> StreamingQuery:
    """Publishes landing messages."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    w = reader.load(messages_dir).writeStream.foreachBatch(outbox.publish).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)).start()
