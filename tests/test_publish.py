"""Lifecycle, top-N, source, message text (FIXTURES §3.6, §3.8)."""

from pyspark.sql import functions as F

from gazette.functions.text import keep_sentence_lines, reader_title
from gazette.operators import lifecycle as LC
from gazette.operators import publish as PB
from gazette.operators.html_dom import page_text
from gazette.operators.summarize import collect_summary, top_sentences


def test_reschedule(spark):
    rows = [(1, "Q", 0, "2024-01-01 10:00:00"), (2, "Q", 1, "2024-01-01 10:00:00"),
            (3, "Q", 2, "2024-01-01 10:00:00"), (4, "Q", 0, "2024-01-01 11:00:00"),
            (5, "N", 0, "2024-01-01 09:00:00")]
    df = spark.createDataFrame(rows, "id long, status string, retries int, t string") \
        .withColumn("update_time", F.to_timestamp("t")).drop("t")
    out = LC.reschedule(df, F.to_timestamp(F.lit("2024-01-01 12:00:00")))
    got = {r.id: (r.retries, r.status) for r in out.collect()}
    assert got == {1: (1, "N"), 2: (2, "N"), 3: (3, "E"), 4: (0, "Q"), 5: (0, "N")}


def test_top_n(spark):
    rows = [(1, 0, "A.", 0.2), (1, 1, "B.", 0.9), (1, 2, "B.", 0.9), (1, 3, "C.", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, sent int, polished string, total double")
    s = collect_summary(top_sentences(df, 2)).first().summary
    assert s == ["B.", "C."]


def test_source_and_message(spark):
    arts = spark.createDataFrame([(1, "Wire", 7), (2, None, 7), (3, None, 99), (4, None, None)],
                                 "id long, source string, feed_id int")
    feeds = spark.createDataFrame([(7, "Feed")], "id int, name string")
    got = {r.id: r.display_source for r in PB.display_source(arts, feeds).collect()}
    assert got == {1: "Wire", 2: "Feed", 3: "Anonymous", 4: "Anonymous"}
    m = spark.createDataFrame([("T", ["A.", "B."], "u", "S", 3)],
                              "t string, s array<string>, u string, src string, imp int")
    r = m.select(PB.message_text(F.col("t"), F.col("s"), F.col("u"), F.col("src")).alias("x"),
                 PB.promote_button(F.col("imp")).alias("b")).first()
    assert r.x == '<b>T</b>\n\n— A.\n— B.\n\n<a href="u"><i>S</i></a>'
    assert r.b == "Promote " + "\U0001F525" * 3


def test_text_helpers(spark):
    df = spark.createDataFrame([("Title \t| Site", "Title\n\nOne.\nno dot\nTwo.")], "t string, x string")
    r = df.select(reader_title(F.col("t")).alias("a"), keep_sentence_lines(F.col("x")).alias("b")).first()
    assert r.a == "Title" and r.b == "One. Two."


def test_dom_tier_drops_subtrees():
    html = ('<div class="reader-header"><p>By <b>A</b></p></div><p>One. Two.</p>'
            '<script>x.y</script><!-- c -->')
    t = page_text(html)
    assert "One. Two." in t and "By" not in t and "A" not in t.replace("One", "") and "x.y" not in t


def test_claim_and_save(spark):
    arts = spark.createDataFrame([(i, "N" if i % 2 else "D", f"u{i}", None, None) for i in range(10)],
                                 "id long, status string, uri string, title string, html string") \
        .withColumn("update_time", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    picked = LC.pick_new(arts, k=2)
    assert picked.count() == 2
    claimed = LC.claim(arts, picked, now)
    assert claimed.filter("status = 'Q'").count() == 2
    caps = spark.createDataFrame([(1, "T | S", "<p>x</p>")], "id long, title string, html string")
    saved = {r.id: (r.status, r.title) for r in LC.save_content(claimed, caps, now).collect()}
    assert saved[1] == ("D", "T") and saved[3][1] is None


def test_duplicate_report_hot_checksum(spark):
    from gazette.operators.dups import duplicate_totals, duplicates
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    d = duplicates(docs)
    got = {r.doc_id: r.canonical_id for r in d.collect()}
    assert got == {i: 0 for i in range(3, 300, 3)}
    t = duplicate_totals(d).first()
    assert (t.n_duplicates, t.duplicate_bytes) == (99, 99 * len("same text"))


def test_recent_insert_first_write_wins(spark):
    from gazette.operators.similarity import recent_insert
    schema = "id long, create_time timestamp, title string, site string"
    t = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    recent = spark.createDataFrame([(1, None, "old", "a")], schema).withColumn("create_time", t)
    new = spark.createDataFrame([(1, None, "new", "b"), (2, None, "x", "c"), (2, None, "y", "d")], schema) \
        .withColumn("create_time", t)
    got = {r.id: r.title for r in recent_insert(recent, new).collect()}
    assert got[1] == "old" and got[2] in ("x", "y") and len(got) == 2
    assert recent_insert(recent, new).count() == 2


def test_promotion_collapses_callbacks(spark):
    msgs = spark.createDataFrame([(1, "editors", "t1", "b"), (2, "editors", "t2", "b")],
                                 "message_id long, channel string, text string, button string")
    cbs = spark.createDataFrame([(1, "promote"), (1, "promote"), (2, "other")], "message_id long, data string")
    p = PB.promoted(msgs, cbs).collect()
    assert [(r.message_id, r.channel, r.button) for r in p] == [(1, "public", None)]
    again = PB.republish(msgs, PB.promoted(msgs, cbs)).collect()
    assert [r.message_id for r in again] == [2]


def test_messages_leave_the_pages_after_the_gate(spark, monkeypatch):
    """With annotated sentences at hand, the pages and the sentences of the articles that do not pass are read once, not per branch."""
    from gazette import session
    from gazette.operators import summarize as SM
    from gazette.operators import tfidf as T
    rows = [(i, "D" if i != 3 else "N", 1, f"http://s{i}.example/a", "Apple grew profits quickly" if i < 4 else "Banks & towns", f"<p>Apple grew {i}. Plants said no.</p>", None)
            for i in range(6)]
    arts = spark.createDataFrame(rows, "id long, status string, feed_id int, uri string, title string, html string, source string") \
        .withColumn("create_time", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    feeds = spark.createDataFrame([(1, "Feed")], "id int, name string")
    arts = session.cut_lineage(arts)
    sents = session.cut_lineage(SM.article_sentences(arts))
    vocab = T.fit_terms(SM.sentence_terms(sents), 6)
    seen, cut = [], session.cut_lineage
    monkeypatch.setattr(session, "cut_lineage", lambda df: seen.append(df) or cut(df))
    msgs = PB.publish_messages(arts, feeds, vocab, sentences=sents)
    got = sorted((r.message_id, r.importance, r.text) for r in msgs.collect())
    assert [(m, n) for m, n, _ in got] == [(1, 1), (2, 2), (5, 1)] and "\u2014 Apple grew 1.\n\u2014 Plants said no.\n\n<a href" in got[0][2]
    plain = sorted((r.message_id, r.importance, r.text) for r in PB.publish_messages(arts, feeds, vocab).collect())
    assert got == plain
    assert "html" not in msgs._jdf.queryExecution().optimizedPlan().toString()
    assert any(df.columns == sents.columns for df in seen)
