"""Engine-shaped views derived from the driver tables.

Each view is a pure projection of one driver table (no sampling, no id
subsets), so its size grows with the table. Attribute values are assigned by
deterministic rules on the ids so every code path (NULL link, blocked link,
aggregator feed, missing date, each status) is exercised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load

EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC
REFRESH_NOW = "2024-02-01 00:00:00"


def ts_lit(s: str) -> Column:
    return F.to_timestamp(F.lit(s))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("int").alias("id"),
        F.when(k % 5 == 0, F.lit(None).cast("timestamp"))
         .otherwise(ts_lit("2024-01-02 00:00:00")).alias("last_publish_time"),
        F.concat(F.lit("http://feed.example/"), k.cast("string")).alias("uri"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category"),
        F.lit(None).cast("string").alias("etag"),
        F.lit(None).cast("string").alias("modified"),
        (F.col("n_regionkey") == 0).alias("is_aggregator"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    eid, k = F.col("event_id"), F.regexp_extract("props", "[0-9]+", 0)
    ts = F.col("ts").cast("timestamp")
    link = (F.when(eid % 50 == 7, F.lit(None).cast("string"))
            .when(F.col("event_type") == "error",
                  F.concat(F.lit("https://www.youtube.com/watch?v="), k))
            .otherwise(F.concat(F.lit("http://"), F.col("event_type"),
                                F.lit(".example.com/"), k, F.lit("?u="),
                                eid.cast("string"))))
    title = (F.when(eid % 9 == 0, F.concat(F.lit("How to use item "), k))
             .when(eid % 9 == 1, F.concat(F.lit("Deal of the day : item "), k))
             .when(eid % 9 == 2, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Company "), k, F.lit(" opens a new office"))))
    return e.select(
        (F.col("user_id") % 20).cast("int").alias("feed_id"),
        eid.alias("entry_pos"),
        link.alias("link"),
        title.alias("title"),
        F.col("props").alias("summary"),
        F.when(eid % 3 == 0, F.lit("Wire")).alias("source_title"),
        F.when(eid % 10 == 0, F.lit(None).cast("timestamp"))
         .otherwise(F.date_trunc("hour", ts)).alias("published"),
        F.when(eid % 20 == 0, F.lit(None).cast("timestamp")).otherwise(ts).alias("updated"),
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered feed requests with their validators; one in four brings none."""
    e = load(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        (F.col("user_id") % 20).cast("int").alias("feed_id"), F.col("ts").cast("timestamp").alias("fetched_at"),
        F.when(eid % 4 != 0, F.concat(F.lit('W/"'), F.md5("props"), F.lit('"'))).alias("etag"),
        F.when(eid % 4 != 1, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("modified"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "pages")
    pid = F.col("page_id")
    return p.select(
        pid.alias("id"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + pid * 300).alias("create_time"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + (pid * 5 + pid % 180) * 60).alias("update_time"),
        F.when(pid % 7 == 0, F.lit(None).cast("int")).otherwise((pid % 25).cast("int")).alias("feed_id"),
        F.col("url").alias("uri"),
        status_of(pid).alias("status"),
        (pid % 3).cast("int").alias("retries"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.lit(None).cast("string").alias("summary"),
        F.when(pid % 13 == 5, F.lit(None).cast("string")).otherwise(F.col("html")).alias("html"),
        F.lit(1).alias("refs_count"),
        F.when(pid % 11 == 0, F.lit("Wire")).alias("source"),
    )


def status_of(pid: Column) -> Column:
    return (F.when(pid % 10 == 0, "N").when(pid % 10 == 1, "Q")
            .when(pid % 10 == 2, "E").otherwise("D"))


def framed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): pages with a reader header after ``<body>`` and an article footer before ``</body>``, each with
    elements of its own name and paragraphs that are not closed inside."""
    header = ('<div class="bar reader-header wide"><div>By <b>A. Writer</b><p>Three minutes.<p>Save.<div class="reader-header">again</div>'
              "</div></div>")
    footer = "<section id='engadget-article-footer'><ul><li>More.<li>Less.</ul><section>All products.</section></section>"
    html = F.regexp_replace(F.regexp_replace("html", "<body>", "<body>" + header), "</body>", footer + "</body>")
    return load(spark, sf_dir, "pages").select("page_id", html.alias("html"))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token): distinct lower-case words of the pages."""
    from ..operators.common import spread
    return spread(load(spark, sf_dir, "pages").select("html")).select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("[a-z]{2,}"), F.lit(0)))).alias("token")).distinct()


def _md5_number(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(token, vec) of the pages' words, (gram, vec) of their character trigrams, and the vectors' length.

    Each key has an embedding chosen by its md5, as a stand-in for trained vectors;
    one token in eight is left out, as an unknown one. The words are written once."""
    from ..operators.vectors import distinct_grams
    from ..session import cut_lineage
    e = load(spark, sf_dir, "embeddings")
    n, dim = e.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    words = cut_lineage(page_words(spark, sf_dir))

    def chosen(keys: DataFrame, key: str) -> DataFrame:
        at = F.pmod(_md5_number(F.col(key)), F.lit(max(n, 1)))
        return keys.withColumn("vec_id", at).join(e.select("vec_id", F.col("embedding").alias("vec")), "vec_id").select(key, "vec")

    known = words.filter(_md5_number(F.col("token")) % 8 != 0)
    return chosen(known, "token"), chosen(distinct_grams(words, "token"), "gram"), dim or 0


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page captures of the claimed (status Q) articles: reader title + html."""
    p = load(spark, sf_dir, "pages")
    return (p.filter(status_of(F.col("page_id")) == "Q")
             .select(F.col("page_id").alias("id"),
                     F.concat(F.regexp_extract("html", "<title>(.*?)</title>", 1),
                              F.lit(" | Site")).alias("title"),
                     F.col("html")))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return e.select(
        "event_id",
        F.concat(F.lit('{"level":"'), level, F.lit('","message":"'), F.col("event_type"),
                 F.lit('","ts":"'), F.col("ts").cast("string"), F.lit('"}')).alias("value"))


def log_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): the log records as lines; some are cut short, some lack their message, some are empty."""
    eid = F.col("event_id")
    bad = F.when(eid % 97 == 5, F.substring("value", 1, 20)).when(eid % 97 == 6, F.lit("")) \
        .when(eid % 97 == 7, F.regexp_replace("value", '"message":"[^"]*",', ""))
    return logs(spark, sf_dir).select(F.coalesce(bad, F.col("value")).alias("value"))


def claim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events (uri, kind, at, retries): claims of the queued articles, captures that end some of them 0 to 89
    minutes later, and a sighting of every article, by which time goes on."""
    a = articles(spark, sf_dir)
    q = a.filter(F.col("status") == "Q")
    claims = q.select("uri", F.lit("claim").alias("kind"), F.col("update_time").alias("at"), "retries")
    done = q.filter(F.col("id") % 3 == 0).select(
        "uri", F.lit("done").alias("kind"), (F.col("update_time") + F.make_dt_interval(mins=(F.col("id") % 90).cast("int"))).alias("at"),
        F.lit(None).cast("int").alias("retries"))
    seen = a.select("uri", F.lit("seen").alias("kind"), F.col("update_time").alias("at"), F.lit(None).cast("int").alias("retries"))
    return claims.unionByName(done).unionByName(seen)


def callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("message_id"),
        F.when(F.col("event_type") == "click", "promote").otherwise(F.col("event_type")).alias("data"))


def refresh_now() -> Column:
    return ts_lit(REFRESH_NOW)
