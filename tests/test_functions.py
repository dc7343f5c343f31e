"""Scalar helpers: feed dates, ISO times, query stripping, entry time."""

from pyspark.sql import functions as F

from gazette.functions.times import entry_time, parse_feed_time, parse_iso_time
from gazette.functions.urls import strip_query


def test_feed_dates(spark):
    df = spark.createDataFrame([("Mon, 05 Feb 2024 10:00:00 GMT",), ("5 Feb 2024 10:00",),
                                ("2024-02-05T10:00:00+00:00",), ("garbage",)], "s string")
    got = [r[0] for r in df.select(F.date_format(parse_feed_time(F.col("s")), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2024-02-05 10:00", "2024-02-05 10:00", "2024-02-05 10:00", None]


def test_iso_with_optional_fraction(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:07.179575",), ("2024-01-01T00:00:07",)], "s string")
    got = [r[0] for r in df.select(F.date_format(parse_iso_time(F.col("s")), "HH:mm:ss.SSSSSS")).collect()]
    assert got == ["00:00:07.179575", "00:00:07.000000"]


def test_strip_query_and_entry_time(spark):
    df = spark.createDataFrame([("http://a.example/2?x=1#y", None, None)],
                               "u string, p timestamp, up timestamp")
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    r = df.select(strip_query(F.col("u")).alias("u"),
                  F.date_format(entry_time(F.col("p"), F.col("up"), now), "yyyy-MM-dd").alias("t")).first()
    assert r.u == "http://a.example/2" and r.t == "2024-02-01"
