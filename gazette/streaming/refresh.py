"""Incremental feed refresh as a Structured Streaming job.

New entry files landing in a folder are processed by ``foreachBatch``: each
micro-batch accepts entries with the feed marks before it and commits a delta to the
article table (``sources.deltas``) under the transaction (job, batch id), so
what it writes follows its entries, other jobs may commit to the same table, and
a replayed batch adds nothing. The few feed rows are a new snapshot version per
batch. The streaming checkpoint records which files were consumed. Trigger
``processingTime='900 seconds'`` reproduces the reference's poll period;
``availableNow`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import accept_entries, article_delta, feed_marks, reference_hits
from ..session import cut_lineage
from ..sources.deltas import ArticleTable
from ..sources.snapshots import latest, versions, write_version

#: Name of the job in the article table's log.
JOB = "refresh"


def init_state(feeds: DataFrame, articles: DataFrame, state_root: str) -> None:
    """Create the article table (metadata only, no ``html``) and version 0 of the feeds, unless they exist."""
    spark = feeds.sparkSession
    ArticleTable(spark, f"{state_root}/articles").create(articles)
    if not versions(spark, f"{state_root}/feeds"):
        write_version(feeds, f"{state_root}/feeds", 0)


def start_refresh_stream(spark: SparkSession, entries_dir: str, entries_schema,
                         state_root: str, checkpoint: str, now: Column,
                         available_now: bool = True, period: str = "900 seconds",
                         file_format: str = "parquet", compact_every: int = 32) -> StreamingQuery:
    """Refresh from landing files; every ``compact_every`` batches the deltas become a new base."""
    src = spark.readStream.schema(entries_schema).format(file_format).load(entries_dir)
    table = ArticleTable(spark, f"{state_root}/articles")

    def run_batch(batch: DataFrame, epoch: int) -> None:
        feeds = latest(spark, f"{state_root}/feeds", at_most=epoch)
        accepted = cut_lineage(accept_entries(batch, feeds, now))
        table.commit(lambda articles: article_delta(reference_hits(articles, accepted), now), (JOB, epoch))
        # after the articles: a replay finds them committed and writes the marks
        write_version(feed_marks(feeds, accepted), f"{state_root}/feeds", epoch + 1)
        if (epoch + 1) % compact_every == 0:
            table.compact()

    w = src.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=period)
    return w.start()


def current(spark: SparkSession, state_root: str, name: str) -> DataFrame | None:
    """The newest state of ``articles`` or ``feeds``."""
    if name == "articles":
        return ArticleTable(spark, f"{state_root}/articles").read()
    return latest(spark, f"{state_root}/{name}")
