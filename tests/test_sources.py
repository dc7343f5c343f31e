"""Sources: RSS round trip, DOM tier on Spark, spread() decisions, logs."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gazette.operators.common import spread
from gazette.operators.html_dom import html_text_dom
from gazette.sources import feeds_xml as FX
from gazette.sources import fixtures as V
from gazette.sources.logs import log_lines
from gazette.sources.tables import load


def test_rss_round_trip(spark):
    e = V.entries(spark, SF_SMALL)
    path = tempfile.mkdtemp(prefix="gz-rss-") + "/feeds"
    FX.write_rss(e, path)
    back = FX.scan_feeds_xml(spark, rss_path=path)
    assert back.count() == e.count()
    assert back.filter(F.col("_corrupt_record").isNotNull()).count() == 0
    key = ["feed_id", "link", "title", "summary", "source_title"]
    a = sorted(map(tuple, e.select(key).collect()), key=repr)
    b = sorted(map(tuple, back.select(key).collect()), key=repr)
    assert a == b
    # dates go through RFC-822 text and back (second precision)
    t1 = sorted(r[0] for r in e.select(F.date_trunc("second", F.coalesce("published", "updated"))).collect()
                if r[0] is not None)
    t2 = sorted(r[0] for r in back.select("published").collect() if r[0] is not None)
    assert t1 == t2


def test_dom_tier_on_spark(spark):
    df = spark.createDataFrame(
        [(1, '<div class="x reader-header"><p>By <b>A</b></p></div><p>One &amp; two.</p>'),
         (2, None)], "id long, html string")
    got = {r.id: r.text for r in html_text_dom(df).collect()}
    assert got[2] is None and "One & two." in got[1] and "By" not in got[1]


def test_spread_only_small_inputs(spark):
    p = load(spark, SF_SMALL, "pages")
    assert spread(p).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        q = spread(p)
        assert "Repartition" not in q._jdf.queryExecution().logical().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "134217728")


def test_feed_dates_with_zones(spark):
    from gazette.functions.times import parse_feed_time
    given = ["Mon, 05 Feb 2024 10:00:00 -0500", "Mon, 05 Feb 2024 10:00:00 EST", "5 Feb 2024 10:00 +0100",
             "Mon, 05 Feb 2024 10:00:00 GMT", "05 Feb 2024 10:00:00", "2024-02-05T10:00:00+01:00", "Mon, 05 Feb 2024 10:00:00 QQQ", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, s string")
    got = [r[1] for r in df.select("i", F.date_format(parse_feed_time(F.col("s")), "HH:mm")).orderBy("i").collect()]
    assert got == ["15:00", "15:00", "09:00", "10:00", "10:00", "09:00", None, None]


def test_atom_link_choice(spark):
    import os
    root = tempfile.mkdtemp(prefix="gz-rel-") + "/feed_id=3"
    os.makedirs(root)
    with open(root + "/f.xml", "w") as fh:
        fh.write("<feed><entry><title>A</title><link rel='edit' href='http://a/edit'/><link rel='alternate' href='http://a/1'/></entry>"
                 "<entry><title>B</title><link rel='edit' href='http://a/e'/></entry>"
                 "<entry><title>C</title><link href='http://a/3'/></entry></feed>")
    e = FX.scan_feeds_xml(spark, atom_path=os.path.dirname(root))
    assert {r.title: r.link for r in e.collect()} == {"A": "http://a/1", "B": None, "C": "http://a/3"}


def test_entities_and_wide_spaces(spark):
    from gazette.functions.text import html_to_text, polish
    df = spark.createDataFrame([("<p>A&#8217;s &#x2014; &mdash; &amp;#65; &#55296; \u00a0</p>",), (None,)], "h string")
    got = [r[0] for r in df.select(html_to_text(F.col("h"))).collect()]
    assert got == ["A\u2019s \u2014 \u2014 &#65; \ufffd \u00a0", None]
    assert spark.range(1).select(polish(F.lit("\u00a0one\u00a0\u00a0two\u00a0"))).first()[0] == "One two."


def test_save_content_repeats(spark):
    from gazette.operators.lifecycle import save_content, unknown_captures
    arts = spark.createDataFrame([(1, "Q", None, None, None), (2, "Q", None, None, None)],
                                 "id long, status string, title string, html string, update_time timestamp")
    caps = spark.createDataFrame([(1, "old", "<p>1</p>", 1), (1, "new", "<p>2</p>", 2), (9, "x", "y", 1)],
                                 "id long, title string, html string, at int")
    out = save_content(arts, caps, F.current_timestamp(), time_col="at")
    assert sorted((r.id, r.status, r.html) for r in out.collect()) == [(1, "D", "<p>2</p>"), (2, "Q", None)]
    assert [r.id for r in unknown_captures(arts, caps).collect()] == [9]


def test_log_lines(spark):
    raw = spark.createDataFrame([('{"level":"INFO","message":"hi","ts":"2024-01-01T00:00:00Z"}',),
                                 ("not json",)], "value string")
    r = [x.line for x in log_lines(raw).collect()]
    assert r[0] == "<PageSaver> [2024-01-01T00:00:00Z] hi"


def test_feed_errors_on_xml(spark):
    from gazette.operators.ingest import feed_errors
    root = tempfile.mkdtemp(prefix="gz-atom-") + "/feed_id=3"
    import os
    os.makedirs(root)
    with open(root + "/f.xml", "w") as fh:
        fh.write("<feed><entry><title>A</title><link href='http://a/1'/><published>2024-02-05T10:00:00+00:00</published></entry>"
                 "<entry><title>B</title><link href='http://a/2'/><published>yesterday</published></entry>"
                 "<entry><title>C</title><published>2024-02-05T10:00:00+00:00</published></entry></feed>")
    e = FX.scan_feeds_xml(spark, atom_path=os.path.dirname(root))
    feeds = spark.createDataFrame([(3,)], "id int")
    errs = {r.error for r in feed_errors(e, feeds).collect()}
    assert errs == {"bad date", "missing link"}
    assert e.filter(F.col("title") == "A").select("published").first()[0] is not None
