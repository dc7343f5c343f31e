"""Feed refresh golden case (FIXTURES §3.5) and properties."""

from pyspark.sql import functions as F

from gazette.functions.urls import is_blocked
from gazette.operators.ingest import ARTICLE_COLUMNS, refresh
from gazette.sources.seed import seed_if_empty

FEEDS = ("id int, last_publish_time timestamp, uri string, name string, category string, "
         "etag string, modified string, is_aggregator boolean")
ENTRIES = ("feed_id int, entry_pos long, link string, title string, summary string, "
           "source_title string, published timestamp, updated timestamp")
ARTICLES = ("id long, create_time timestamp, update_time timestamp, feed_id int, uri string, "
            "status string, retries int, title string, summary string, html string, "
            "refs_count int, source string")


def _ts(s):
    return F.to_timestamp(F.lit(s))


def _entries(spark):
    rows = [(1, 1, "http://a.example/1", "2024-01-01 10:00:00"),
            (1, 2, "https://www.youtube.com/watch?v=1", "2024-01-01 11:00:00"),
            (1, 3, "http://a.example/2?x=1#y", "2024-01-01 11:00:00"),
            (1, 4, "http://a.example/3", "2024-01-01 11:00:00"),
            (1, 5, "http://a.example/2", "2024-01-01 12:00:00"),
            (1, 6, None, "2024-01-01 13:00:00"),
            (1, 7, "http://a.example/4", None)]
    df = spark.createDataFrame(rows, "feed_id int, entry_pos long, link string, t string")
    return df.select("feed_id", "entry_pos", "link", F.lit(None).cast("string").alias("title"),
                     F.concat(F.lit("s"), F.col("entry_pos").cast("string")).alias("summary"),
                     F.lit(None).cast("string").alias("source_title"),
                     F.to_timestamp("t").alias("published"), F.lit(None).cast("timestamp").alias("updated"))


def _feeds(spark):
    return spark.createDataFrame([(1, None, "u", "Feed", "c", None, None, False)], FEEDS) \
        .withColumn("last_publish_time", _ts("2024-01-01 10:00:00"))


def test_refresh_golden_and_idempotent(spark):
    now = _ts("2024-01-02 00:00:00")
    arts0 = spark.createDataFrame([], ARTICLES)
    arts1, feeds1, _ = refresh(_entries(spark), _feeds(spark), arts0, now, materialize=False)
    got = {r.uri: (r.refs_count, r.summary, r.status) for r in arts1.collect()}
    assert got == {"http://a.example/2": (2, "s3", "N"), "http://a.example/4": (1, "s7", "N")}
    mark = feeds1.select(F.date_format("last_publish_time", "HH:mm")).first()[0]
    assert mark == "12:00"
    # second refresh over the same entries changes nothing
    arts2, feeds2, _ = refresh(_entries(spark), feeds1, arts1, now, materialize=False)
    assert sorted(map(tuple, arts2.select("uri", "refs_count").collect())) == \
        sorted(map(tuple, arts1.select("uri", "refs_count").collect()))
    assert feeds2.select(F.date_format("last_publish_time", "HH:mm")).first()[0] == "12:00"
    assert arts2.columns == ARTICLE_COLUMNS


def test_refs_total_equals_accepted(spark):
    from conftest import SF_SMALL
    from gazette.sources import fixtures as V
    arts, _, acc = refresh(V.entries(spark, SF_SMALL), V.feeds(spark, SF_SMALL),
                           V.articles(spark, SF_SMALL), V.refresh_now(), materialize=False)
    base = V.articles(spark, SF_SMALL).agg(F.sum("refs_count")).first()[0]
    total = arts.agg(F.sum("refs_count")).first()[0]
    assert total - base == acc.count()


def test_blocklist_cases(spark):
    df = spark.createDataFrame([("https://x.example/?u=/www.youtube.com/a",), ("https://www.youtube.com",),
                                ("https://www.youtube.com/watch?v=1",)], "u string")
    assert [r[0] for r in df.select(is_blocked(F.col("u"))).collect()] == [True, False, True]


def test_seed_if_empty(spark):
    empty = spark.createDataFrame([], FEEDS)
    seeded = seed_if_empty(empty)
    assert seeded.count() == 49 and seeded.filter("is_aggregator").count() == 4
    assert seed_if_empty(_feeds(spark)).count() == 1


def test_feed_errors_unknown_feed(spark):
    from conftest import SF_SMALL
    from gazette.operators.ingest import feed_errors
    from gazette.sources import fixtures as V
    e = V.entries(spark, SF_SMALL)
    few = V.feeds(spark, SF_SMALL).filter(F.col("id") < 10)
    errs = feed_errors(e, few)
    unknown = errs.filter(F.col("error") == "unknown feed").count()
    assert unknown == e.filter(F.col("feed_id") >= 10).count() > 0
    missing = errs.filter(F.col("error") == "missing link")
    assert missing.filter(F.col("feed_id") >= 10).count() == 0
