"""Streaming = batch: the same rows split over time-ordered micro-batches."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from gazette.operators import ingest as I
from gazette.operators import similarity as S
from gazette.sources import fixtures as V


def _land(df, time_col, root, n_parts):
    lo, hi = df.agg(F.min(F.unix_seconds(time_col)), F.max(F.unix_seconds(time_col))).first()
    step = (hi - lo) // n_parts + 1
    for i in range(n_parts):
        part = df.filter((F.unix_seconds(time_col) >= lo + i * step) & (F.unix_seconds(time_col) < lo + (i + 1) * step))
        part.coalesce(1).write.mode("overwrite").parquet(f"{root}/{i:03d}")


def test_stream_similarity_equals_batch(spark):
    from gazette.streaming.similar import read_output, start_similarity_stream
    arts = V.articles(spark, SF_MID).select("id", "create_time", "title", "uri")
    root = tempfile.mkdtemp(prefix="gz-sim-")
    _land(arts, "create_time", f"{root}/in", 4)
    q = start_similarity_stream(spark, f"{root}/in/*", arts.schema, f"{root}/state", f"{root}/out",
                                f"{root}/ckpt")
    q.awaitTermination()
    got = sorted(map(tuple, read_output(spark, f"{root}/out").collect()))
    want = sorted(map(tuple, S.importance(V.articles(spark, SF_MID)).collect()))
    assert got == want
    # replaying nothing new leaves the output unchanged
    q2 = start_similarity_stream(spark, f"{root}/in/*", arts.schema, f"{root}/state", f"{root}/out",
                                 f"{root}/ckpt")
    q2.awaitTermination()
    assert sorted(map(tuple, read_output(spark, f"{root}/out").collect())) == want


def test_stream_refresh_equals_batch(spark):
    from gazette.streaming.refresh import current, init_state, start_refresh_stream
    t = F.coalesce(F.col("published").cast("timestamp"), F.col("updated").cast("timestamp"))
    entries = V.entries(spark, SF_SMALL).filter(t.isNotNull())
    root = tempfile.mkdtemp(prefix="gz-ref-")
    _land(entries.withColumn("_t", t), "_t", f"{root}/in", 3)
    init_state(V.feeds(spark, SF_SMALL), V.articles(spark, SF_SMALL), f"{root}/state")
    q = start_refresh_stream(spark, f"{root}/in/*", entries.withColumn("_t", t).schema,
                             f"{root}/state", f"{root}/ckpt", V.refresh_now())
    q.awaitTermination()
    arts_s = current(spark, f"{root}/state", "articles")
    feeds_s = current(spark, f"{root}/state", "feeds")
    arts_b, feeds_b, _ = I.refresh(entries, V.feeds(spark, SF_SMALL), V.articles(spark, SF_SMALL),
                                   V.refresh_now(), materialize=False)
    key = ["uri", "refs_count"]
    assert sorted(map(tuple, arts_s.select(key).collect())) == sorted(map(tuple, arts_b.select(key).collect()))
    mk = ["id", "last_publish_time"]
    assert sorted(map(tuple, feeds_s.select(mk).collect())) == sorted(map(tuple, feeds_b.select(mk).collect()))
    # restarting on the same checkpoint finds nothing new: state unchanged
    before = sorted(map(tuple, current(spark, f"{root}/state", "articles").select(key).collect()))
    q2 = start_refresh_stream(spark, f"{root}/in/*", entries.withColumn("_t", t).schema,
                              f"{root}/state", f"{root}/ckpt", V.refresh_now())
    q2.awaitTermination()
    after = sorted(map(tuple, current(spark, f"{root}/state", "articles").select(key).collect()))
    assert after == before


def test_reschedule_shares_the_table_of_the_refresh(spark):
    """The hourly job and the polls commit to one article table."""
    from gazette.sources.deltas import ArticleTable
    from gazette.streaming.lifecycle import start_reschedule_stream
    from gazette.streaming.refresh import current, init_state, start_refresh_stream
    root = tempfile.mkdtemp(prefix="gz-life-")
    arts = V.articles(spark, SF_SMALL)
    init_state(V.feeds(spark, SF_SMALL), arts, f"{root}/state")
    entries = V.entries(spark, SF_SMALL)
    for i, part in enumerate([F.col("entry_pos") % 2 == 0, F.col("entry_pos") % 2 == 1]):
        entries.filter(part).coalesce(1).write.parquet(f"{root}/in/{i}")
        start_refresh_stream(spark, f"{root}/in/*", entries.schema, f"{root}/state", f"{root}/ckpt", V.refresh_now()).awaitTermination()
        start_reschedule_stream(spark, f"{root}/state/articles", f"{root}/ckpt-life-{i}", once=True).awaitTermination()
    got = {r.uri: (r.status, r.retries) for r in current(spark, f"{root}/state", "articles").collect()}
    for r in arts.collect():
        # all claims of the fixture are long stale: requeued once, by the first of the two jobs
        want = ("N" if r.retries + 1 < 3 else "E", r.retries + 1) if r.status == "Q" else (r.status, r.retries)
        assert got[r.uri] == want
    assert len(got) > arts.count()
    assert ArticleTable(spark, f"{root}/state/articles").version() == 5  # the base, two polls, two timer jobs


def test_stream_similarity_repeats_and_future_dates(spark):
    from gazette.sources.snapshots import latest
    from gazette.streaming.similar import read_output, start_similarity_stream
    root = tempfile.mkdtemp(prefix="gz-rep-")
    title = "Storm floods northern harbour towns"
    rows = [(1, "2024-02-05 10:00:00", title, "http://a.example/1"), (1, "2024-02-05 10:05:00", title, "http://a.example/1"),
            (2, "2024-02-05 11:00:00", title, "http://b.example/2"), (3, "2124-01-01 00:00:00", "Other words entirely", "http://c.example/3")]
    df = spark.createDataFrame(rows, "id long, t string, title string, uri string") \
        .select("id", F.to_timestamp("t").alias("create_time"), "title", "uri")
    df.coalesce(1).write.parquet(f"{root}/in/0")
    start_similarity_stream(spark, f"{root}/in/*", df.schema, f"{root}/state", f"{root}/out", f"{root}/ckpt").awaitTermination()
    out = read_output(spark, f"{root}/out").collect()
    assert sorted(r.id for r in out) == [1, 2, 3]
    assert {r.id: r.importance for r in out}[2] == 1
    # the horizon is the processing time, so the future article stays and does not bound the window itself
    assert {r.id for r in latest(spark, f"{root}/state").collect()} == {3}
