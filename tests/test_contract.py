"""Driver contract: entry() runs; every SQL-expressible key has an oracle."""

import __spark_entry__ as E

ROWS_ONLY = {"html_text_dom", "scan_feed_xml", "stream_similar", "attached_heads"}


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "importance"]
    assert df.count() >= 0


def test_oracle_coverage():
    from gazette.plans.queries import queries
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    # the library's own keys; those of a subpackage that may be absent are checked beside it
    assert set(queries()) <= set(q)
    assert set(queries()) - set(o) == ROWS_ONLY


def test_end_to_end_usage(spark):
    """The README usage example on the sf0.001 tables."""
    import tempfile

    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from gazette.operators import ingest, lifecycle, publish, tfidf
    from gazette.sources import fixtures as V
    from gazette.operators.vectors import open_store
    entries, feeds, articles = V.entries(spark, SF_SMALL), V.feeds(spark, SF_SMALL), V.articles(spark, SF_SMALL)
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    articles, feeds, _ = ingest.refresh(entries, feeds, articles, now)
    articles = lifecycle.save_content(articles, V.captures(spark, SF_SMALL), now)
    path = tempfile.mkdtemp(prefix="gz-model-") + "/vocab"
    vocab = tfidf.train(articles, path)
    msgs = publish.publish_messages(articles, feeds, vocab, open_store(*V.vectors(spark, SF_SMALL)),
                                    since=F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows = msgs.collect()
    assert rows and all(r.text.startswith("<b>") and r.importance > 0 for r in rows)
    assert lifecycle.reschedule(articles, now).count() == articles.count()
