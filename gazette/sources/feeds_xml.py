"""RSS / Atom feed files -> entries, with Spark's built-in XML source.

RSS items (rowTag ``item``) and Atom entries (rowTag ``entry``) are mapped to
the entries schema; attributes arrive as ``_name`` fields and element text
next to attributes as ``_VALUE``. ``feed_id`` comes from the folder layout
``feed_id=<n>/`` (partition discovery). Records that do not parse land in
``_corrupt_record`` instead of failing the scan, and are reported by
``operators.ingest.feed_errors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parse_feed_time

RSS_SCHEMA = ("title string, link string, description string, pubDate string, "
              "source struct<_VALUE: string, _url: string>, _corrupt_record string, feed_id int")
ATOM_SCHEMA = ("title string, link array<struct<_href: string, _rel: string>>, summary string, published string, "
               "updated string, source struct<title: string>, _corrupt_record string, feed_id int")


def _entries(df: DataFrame, link, summary, published, updated, source_title) -> DataFrame:
    return df.select(
        F.col("feed_id").cast("int").alias("feed_id"),
        F.monotonically_increasing_id().alias("entry_pos"),
        link.alias("link"), F.col("title").alias("title"), summary.alias("summary"),
        source_title.alias("source_title"),
        parse_feed_time(published).alias("published"),
        parse_feed_time(updated).alias("updated"),
        F.coalesce(published, updated).alias("date_text"),
        F.col("_corrupt_record"))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    raw = (spark.read.format("xml").option("rowTag", "item")
           .option("mode", "PERMISSIVE").schema(RSS_SCHEMA).load(path))
    return _entries(raw, F.col("link"), F.col("description"), F.col("pubDate"),
                    F.lit(None).cast("string"), F.col("source._VALUE"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    raw = (spark.read.format("xml").option("rowTag", "entry")
           .option("mode", "PERMISSIVE").schema(ATOM_SCHEMA).load(path))
    # the entry's own page: the first link that is `alternate`, which is also what no rel means
    pages = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return _entries(raw, F.get(pages, F.lit(0))["_href"], F.col("summary"), F.col("published"),
                    F.col("updated"), F.col("source.title"))


def scan_feeds_xml(spark: SparkSession, rss_path: str | None = None,
                   atom_path: str | None = None, materialize: bool = True) -> DataFrame:
    """RSS and Atom entries in one DataFrame.

    With ``materialize`` the parsed entries are checkpointed: XML is parsed
    once for both the refresh and the error report, and queries that only
    look at ``_corrupt_record`` (refused by Spark on raw files) are allowed.
    """
    parts = []
    if rss_path:
        parts.append(read_rss(spark, rss_path))
    if atom_path:
        parts.append(read_atom(spark, atom_path))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if materialize:
        from ..session import cut_lineage
        out = cut_lineage(out)
    return out


def write_rss(entries: DataFrame, path: str) -> None:
    """Write entries as RSS item files per feed (used to land test feeds)."""
    out = entries.select(
        "feed_id", "title", "link", F.col("summary").alias("description"),
        F.date_format(F.coalesce("published", "updated"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"),
        F.when(F.col("source_title").isNotNull(),
               F.struct(F.col("source_title").alias("_VALUE"), F.lit("").alias("_url"))).alias("source"))
    (out.write.mode("overwrite").format("xml").option("rootTag", "channel")
     .option("rowTag", "item").partitionBy("feed_id").save(path))
