"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables through the fixture views and runs a
gazette operator over the whole table. Outputs use plain column types
(strings, longs, doubles rounded to 6 places, timestamps as text) so they can
be compared with the DuckDB oracle in ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import fmt_ts
from ..functions.urls import url_host
from ..operators import similarity as S
from ..sources import fixtures as V
from ..sources.tables import load
from ..functions import text as TX
from ..functions import tagger as TG
from ..functions.annotate import sentences_of, sentences_tokens
from ..functions.fixed import DEFAULT_TOP_N, TRAIN_SAMPLE_SIZE
from ..functions.times import parse_iso_time
from ..functions.urls import is_blocked, strip_query
from ..operators import dups as DP
from ..operators import ingest as I
from ..operators import lifecycle as LC
from ..operators import publish as PB
from ..operators import sentences as SN
from ..operators import summarize as SM
from ..operators import tfidf as T
from ..operators.html_dom import html_text_dom
from ..operators.titles import is_news_title
from ..operators.vectors import open_store
from ..session import scratch_path
from ..sources import feeds_xml as FX
from ..sources import logs as LG
from ..sources import seed as SD

RECENT_NOW = "2024-01-02 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    """Register a query; the wrapper pins the session time zone to UTC (the
    fixtures and the oracle are UTC-naive) before building the plan."""
    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def r6(c):
    return F.round(c.cast("double"), 6)


# --- similarity ----------------------------------------------------------------
@register("importance")
def q_importance(spark, sf):
    return S.importance(V.articles(spark, sf))


@register("similar_pairs")
def q_similar_pairs(spark, sf):
    """Pairs that count toward importance (score above the threshold)."""
    from ..functions.fixed import SIMILARITY_THRESHOLD
    p = S.similar_pairs(V.articles(spark, sf), threshold=SIMILARITY_THRESHOLD)
    return p.select("id", "other_id", r6(F.col("score")).alias("score"))


@register("title_wordset")
def q_title_wordset(spark, sf):
    a = V.articles(spark, sf)
    w = a.select("id", S.wordset(F.col("title")).alias("w"))
    return w.select("id", F.size("w").cast("long").alias("n_words"),
                    F.array_join("w", " ").alias("words"))


@register("url_host")
def q_url_host(spark, sf):
    p = load(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), url_host(F.col("url")).alias("host"))


@register("jaccard")
def q_jaccard(spark, sf):
    """Jaccard of each article's title set with the previous article's set."""
    a = S.prepare(V.articles(spark, sf))
    prev = a.select((F.col("id") + 1).alias("id"), F.col("words").alias("prev_words"))
    j = a.join(prev, "id")
    return j.select("id", r6(S.jaccard(F.col("words"), F.col("prev_words"))).alias("score"))


def _recent(spark, sf):
    a = V.articles(spark, sf)
    return a.select("id", "create_time", "title", url_host(F.col("uri")).alias("site"))


def _recent_out(df):
    return df.select("id", fmt_ts(F.col("create_time")).alias("create_time"), "title", "site")


@register("recent_window")
def q_recent_window(spark, sf):
    return _recent_out(S.recent_window(_recent(spark, sf), V.ts_lit(RECENT_NOW)))


@register("recent_evicted")
def q_recent_evicted(spark, sf):
    return _recent_out(S.recent_evicted(_recent(spark, sf), V.ts_lit(RECENT_NOW)))


@register("recent_insert")
def q_recent_insert(spark, sf):
    recent = S.recent_window(_recent(spark, sf), V.ts_lit(RECENT_NOW))
    cap = V.captures(spark, sf).alias("c")
    a = V.articles(spark, sf).select("id", "create_time", "uri")
    new = cap.join(a, "id").select("id", "create_time", F.col("c.title").alias("title"),
                                   url_host(F.col("uri")).alias("site"))
    return _recent_out(S.recent_insert(recent, new))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# --- ingest ------------------------------------------------------------------------


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: int -> long, timestamp -> text, double -> 6 places."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        c = F.col(f.name)
        if t in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif t.startswith("timestamp"):
            c = fmt_ts(c)
        elif t in ("double", "float"):
            c = r6(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _with_entry_counts(spark, sf, feeds: DataFrame) -> DataFrame:
    """Feeds with the number of entries waiting for each (0 when none): the
    feed dimension is tiny, the entry count comes from the fact table."""
    counts = V.entries(spark, sf).groupBy("feed_id").agg(F.count(F.lit(1)).alias("n_entries"))
    j = feeds.join(counts, feeds.id == counts.feed_id, "left")
    return j.select(*[feeds[c] for c in feeds.columns],
                    F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"))


@register("scan_feeds")
def q_scan_feeds(spark, sf):
    return tidy(_with_entry_counts(spark, sf, V.feeds(spark, sf)))


@register("entry_time")
def q_entry_time(spark, sf):
    e = I.timed_entries(V.entries(spark, sf), V.refresh_now())
    return tidy(e.select("entry_pos", "feed_id", "publish_time", "dated"))


@register("canonical_url")
def q_canonical_url(spark, sf):
    e = V.entries(spark, sf).filter(F.col("link").isNotNull())
    return e.select("entry_pos", strip_query(F.col("link")).alias("uri"))


@register("blocklist")
def q_blocklist(spark, sf):
    e = V.entries(spark, sf).filter(F.col("link").isNotNull())
    return e.select("entry_pos", is_blocked(F.col("link")).alias("blocked"))


@register("news_title")
def q_news_title(spark, sf):
    e = V.entries(spark, sf)
    return e.select("entry_pos", is_news_title(F.col("title")).alias("is_news"))


@register("incremental")
def q_incremental(spark, sf):
    acc = I.accept_entries(V.entries(spark, sf), V.feeds(spark, sf), V.refresh_now())
    return tidy(acc.select("feed_id", "entry_pos", "publish_time", "dated"))


@register("feed_refresh")
def q_feed_refresh(spark, sf):
    acc = I.accept_entries(V.entries(spark, sf), V.feeds(spark, sf), V.refresh_now())
    return tidy(acc.select("feed_id", "entry_pos", "uri", "source", "summary"))


@register("new_uris")
def q_new_uris(spark, sf):
    acc = I.accept_entries(V.entries(spark, sf), V.feeds(spark, sf), V.refresh_now())
    return I.new_uris(acc, V.articles(spark, sf))


@register("known_uris")
def q_known_uris(spark, sf):
    """Accepted URIs that the entries dated before the cutoff had brought already."""
    t = F.coalesce(F.col("published").cast("timestamp"), F.col("updated").cast("timestamp"))
    acc = I.accept_entries(V.entries(spark, sf), V.feeds(spark, sf), V.refresh_now())
    stored = V.entries(spark, sf).filter(t < V.ts_lit(SECOND_PASS_CUTOFF)).select(strip_query(F.col("link")).alias("uri"))
    return I.known_uris(acc, stored.unionByName(V.articles(spark, sf).select("uri")))


def _accepted(spark, sf):
    """Accepted entries of one refresh, checkpointed once (both outputs of a
    refresh read them)."""
    from ..session import cut_lineage
    return cut_lineage(I.accept_entries(V.entries(spark, sf), V.feeds(spark, sf), V.refresh_now()))


@register("article_upsert")
def q_article_upsert(spark, sf):
    arts = I.upsert_articles(V.articles(spark, sf), _accepted(spark, sf), V.refresh_now())
    return tidy(arts.drop("html"))


@register("feed_state")
def q_feed_state(spark, sf):
    return tidy(I.feed_marks(V.feeds(spark, sf), _accepted(spark, sf), V.fetches(spark, sf)))


# --- text ----------------------------------------------------------------------------


def _documents(spark, sf):
    from ..operators.common import spread
    return spread(load(spark, sf, "documents"))


def _doc_sentences(spark, sf):
    d = _documents(spark, sf)
    return d.select("doc_id", F.posexplode(sentences_tokens(F.col("text"))).alias("_p", "s")) \
            .select("doc_id", F.col("s.sent").alias("sent"), F.col("s.text").alias("text"),
                    F.col("s.tokens").alias("tokens"))


def _token_sig(tokens):
    return F.array_join(F.transform(tokens, lambda t: F.concat_ws(
        "|", t["text"], t["ws"], t["lemma"], t["pos"], t["dep"], t["head"].cast("string"),
        t["is_stop"].cast("string"), t["is_quote"].cast("string"))), " ")


@register("html_text")
def q_html_text(spark, sf):
    from ..operators.common import spread
    p = spread(load(spark, sf, "pages").select("page_id", "html"))
    return p.select(F.col("page_id").alias("id"), TX.html_to_text(F.col("html")).alias("text"))


@register("html_text_subtrees")
def q_html_text_subtrees(spark, sf):
    """Pages with reader headers and article footers put in (nested, unclosed paragraphs inside): their text is that of the pages."""
    p = V.framed_pages(spark, sf)
    return p.select(F.col("page_id").alias("id"), TX.html_to_text(F.col("html")).alias("text"))


@register("clean_text")
def q_clean_text(spark, sf):
    d = load(spark, sf, "documents")
    return d.select("doc_id", TX.keep_sentence_lines(F.col("text")).alias("text"))


@register("page_clean_text")
def q_page_clean_text(spark, sf):
    p = load(spark, sf, "pages")
    return p.select(F.col("page_id").alias("id"), TX.html_to_clean_text(F.col("html")).alias("text"))


@register("sentences")
def q_sentences(spark, sf):
    d = _documents(spark, sf)
    return d.select("doc_id", F.posexplode(sentences_of(F.col("text"))).alias("sent", "text")) \
            .select("doc_id", F.col("sent").cast("long").alias("sent"), "text")


@register("tokens")
def q_tokens(spark, sf):
    s = _doc_sentences(spark, sf)
    return s.select("doc_id", F.col("sent").cast("long").alias("sent"),
                    F.size("tokens").cast("long").alias("n_tokens"),
                    _token_sig(F.col("tokens")).alias("sig"))


@register("tagged_tokens")
def q_tagged_tokens(spark, sf):
    """Tags of every sentence by Viterbi decoding."""
    s = _documents(spark, sf).select("doc_id", F.explode(TG.tagged_sentences(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.sent").cast("long").alias("sent"),
                    F.size("s.tokens").cast("long").alias("n_tokens"),
                    F.array_join(F.col("s.tokens.pos"), " ").alias("tags"))


@register("attached_heads")
def q_attached_heads(spark, sf):
    """Arcs of every sentence by the stack of open heads, and whether a subject stands left of its verb."""
    s = _documents(spark, sf).select("doc_id", F.explode(TG.tagged_sentences(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.sent").cast("long").alias("sent"),
                    F.array_join(F.transform("s.tokens", lambda t: F.concat_ws(">", t["dep"], t["head"].cast("string"))), " ").alias("arcs"),
                    SN.is_relevant(F.col("s.text"), F.col("s.tokens")).alias("relevant"))


@register("relevant_sentences")
def q_relevant_sentences(spark, sf):
    d = _documents(spark, sf)
    s = d.select("doc_id", F.explode(SN.dotted_in_batches(F.col("text"))).alias("s"))
    return s.filter(SN.is_relevant(F.col("s.text"), F.col("s.tokens"))) \
            .select("doc_id", F.col("s.sent").cast("long").alias("sent"))


@register("trim_sentence")
def q_trim_sentence(spark, sf):
    from ..functions.annotate import span_text
    d = _documents(spark, sf)
    s = d.select("doc_id", F.explode(SN.dotted_in_batches(F.col("text"))).alias("s")) \
         .select("doc_id", "s.sent", "s.text", "s.tokens") \
         .filter(SN.is_relevant(F.col("text"), F.col("tokens")))
    # exploded from one element, so that the filter and both columns read one trimmed span
    t = s.select("doc_id", "sent", F.explode(F.array(SN.trim_tokens(F.col("tokens")))).alias("tt"))
    return t.filter(F.size("tt") > 0).select(
        "doc_id", F.col("sent").cast("long").alias("sent"),
        F.size("tt").cast("long").alias("n_tokens"), span_text(F.col("tt")).alias("text"))


@register("content_tokens")
def q_content_tokens(spark, sf):
    s = _doc_sentences(spark, sf)
    c = SN.content_tokens(F.col("tokens"))
    return s.select("doc_id", F.col("sent").cast("long").alias("sent"),
                    F.array_join(F.transform(c, lambda t: t["lemma"]), " ").alias("lemmas"))


@register("polish")
def q_polish(spark, sf):
    d = _documents(spark, sf)
    k = d.select("doc_id", F.explode(SN.kept_in_batches(F.col("text"))).alias("s"))
    return k.select("doc_id", F.col("s.sent").cast("long").alias("sent"),
                    TX.polish(F.col("s.text")).alias("text"))


@register("training_text")
def q_training_text(spark, sf):
    a = V.articles(spark, sf).filter((F.col("status") == "D") & F.col("html").isNotNull())
    return SN.with_clean_text(a, "_text").select("id", SN.training_text(SN.kept_in_batches(F.col("_text"))).alias("text"))


@register("clean_title")
def q_clean_title(spark, sf):
    c = V.captures(spark, sf)
    return c.select("id", TX.reader_title(F.col("title")).alias("title"))


# --- tf-idf and summaries -------------------------------------------------------------


def _publishable(spark, sf):
    return V.articles(spark, sf).filter((F.col("status") == "D") & F.col("html").isNotNull())


def _train_texts(spark, sf):
    samp = T.sample_for_training(V.articles(spark, sf).filter(F.col("html").isNotNull()))
    from ..operators.common import spread
    return SN.with_clean_text(spread(samp), "_text").select(F.col("id").alias("doc_id"), SN.training_text(SN.kept_in_batches(F.col("_text"))).alias("text"))


def _vocab(spark, sf, sents=None):
    """Fit, then save/load the model: the vocabulary is checkpointed to the
    shared folder once, so later size checks and joins read it back.

    When the annotated sentence table of the publishable articles is at hand
    (it contains the training sample), the fit reads its terms instead of
    annotating the sample a second time.
    """
    from ..session import cut_lineage
    if sents is None:
        return cut_lineage(T.fit(_train_texts(spark, sf)))
    ids = cut_lineage(T.sample_for_training(V.articles(spark, sf).filter(F.col("html").isNotNull())).select("id"))
    terms = SM.sentence_terms(sents).join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return cut_lineage(T.fit_terms(terms, ids.count()))


def _store(spark, sf):
    return open_store(*V.vectors(spark, sf))


class _Summ:
    """Shared inputs of the summary queries (built lazily per call)."""

    def __init__(self, spark, sf, vectors=True):
        from ..session import cut_lineage
        arts = _publishable(spark, sf)
        self.sents = cut_lineage(SM.article_sentences(arts))
        self.weights = SM.doc_weights(self.sents, _vocab(spark, sf, self.sents))
        titles = arts.select(F.col("id").alias("doc_id"), "title")
        self.vectors = SM.Vectors(self.sents, titles, _store(spark, sf)) if vectors else None

    def scores(self):
        return SM.sentence_scores(self.sents, self.weights, self.vectors)


@register("train_sample")
def q_train_sample(spark, sf):
    return T.sample_for_training(V.articles(spark, sf), TRAIN_SAMPLE_SIZE).select("id")


@register("tfidf_fit")
def q_tfidf_fit(spark, sf):
    return tidy(_vocab(spark, sf))


@register("tfidf_transform")
def q_tfidf_transform(spark, sf):
    from ..session import cut_lineage
    s = cut_lineage(SM.article_sentences(_publishable(spark, sf)))
    return tidy(SM.doc_weights(s, _vocab(spark, sf, s)))


@register("sentence_frequency")
def q_sentence_frequency(spark, sf):
    m = _Summ(spark, sf, vectors=False)
    return tidy(SM.sentence_frequency(m.sents, m.weights).withColumn("sent", F.col("sent").cast("long")))


@register("mean_vector")
def q_mean_vector(spark, sf):
    m = _Summ(spark, sf)
    v = SM.vector_sums(SM.sentence_lemmas(m.sents), ["doc_id", "sent"], m.vectors.table, m.vectors.dim)
    norm = F.sqrt(F.aggregate("vsum", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("doc_id", F.col("sent").cast("long").alias("sent"), F.col("n_vec").cast("long").alias("n_vec"),
                    F.round(norm, 4).alias("norm"))


@register("cosine_to_title")
def q_cosine_to_title(spark, sf):
    m = _Summ(spark, sf)
    return tidy(SM.title_similarity(m.sents, m.vectors).withColumn("sent", F.col("sent").cast("long")))


@register("sentence_score")
def q_sentence_score(spark, sf):
    m = _Summ(spark, sf)
    return tidy(m.scores().drop("polished").withColumn("sent", F.col("sent").cast("long")))


@register("score_threshold")
def q_score_threshold(spark, sf):
    return tidy(SM.average_score(_Summ(spark, sf).scores()))


@register("top_sentences")
def q_top_sentences(spark, sf):
    t = SM.top_sentences(_Summ(spark, sf).scores(), DEFAULT_TOP_N)
    return t.select("doc_id", F.col("sent").cast("long").alias("sent"), F.col("polished").alias("text"))


@register("summarize")
def q_summarize(spark, sf):
    s = SM.summarize(_publishable(spark, sf), None, _store(spark, sf),
                     vocab_fn=lambda sents: _vocab(spark, sf, sents))
    return s.select("doc_id", F.size("summary").cast("long").alias("n_sentences"),
                    F.array_join("summary", "\n").alias("summary"))


# --- publishing, lifecycle, logs, duplicates, seed -------------------------------------

LIFECYCLE_NOW = "2024-01-01 12:00:00"


def _messages(spark, sf, curated=False):
    """Train and publish in one job: the publishable articles are annotated
    once; the vocabulary is fitted from that table and the summariser reuses
    it for the gated articles. (With a saved model, pass only ``vocab`` and
    the summariser annotates just the articles that pass the gate.)"""
    from ..session import cut_lineage
    sents = cut_lineage(SM.article_sentences(_publishable(spark, sf)))
    return PB.publish_messages(V.articles(spark, sf), V.feeds(spark, sf), _vocab(spark, sf, sents),
                               _store(spark, sf), curated=curated, sentences=sents)


@register("seed_feeds")
def q_seed_feeds(spark, sf):
    return tidy(_with_entry_counts(spark, sf, SD.seed_if_empty(V.feeds(spark, sf))))


@register("article_by_id")
def q_article_by_id(spark, sf):
    ids = V.captures(spark, sf).select("id")
    return V.articles(spark, sf).join(ids, "id", "left_semi").select("id", "title", "html")


@register("display_source")
def q_display_source(spark, sf):
    return PB.display_source(V.articles(spark, sf), V.feeds(spark, sf)).select("id", "display_source")


@register("publishable")
def q_publishable(spark, sf):
    return PB.publishable(V.articles(spark, sf)).select("id", "publishable", "reason")


@register("parse_time")
def q_parse_time(spark, sf):
    e = load(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    iso = F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")) \
           .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return tidy(e.select("event_id", parse_iso_time(iso).alias("ts")))


@register("reschedule")
def q_reschedule(spark, sf):
    r = LC.reschedule(V.articles(spark, sf), V.ts_lit(LIFECYCLE_NOW))
    return tidy(r.select("id", "status", "retries", "update_time"))


@register("claim_next")
def q_claim_next(spark, sf):
    a = V.articles(spark, sf)
    picked = LC.pick_new(a, k=5)
    c = LC.claim(a, picked, V.ts_lit(LIFECYCLE_NOW))
    return tidy(c.join(picked.select("id"), "id", "left_semi").select("id", "uri", "status", "update_time"))


@register("save_content")
def q_save_content(spark, sf):
    s = LC.save_content(V.articles(spark, sf), V.captures(spark, sf), V.refresh_now())
    return tidy(s.select("id", "title", "status", "update_time", F.md5("html").alias("html_md5")))


@register("log_lines")
def q_log_lines(spark, sf):
    return LG.log_lines(V.logs(spark, sf)).select("event_id", "level", "line")


@register("duplicate_content")
def q_duplicate_content(spark, sf):
    return DP.duplicates(load(spark, sf, "documents"))


@register("duplicate_totals")
def q_duplicate_totals(spark, sf):
    return DP.duplicate_totals(DP.duplicates(load(spark, sf, "documents")))


@register("publish_messages")
def q_publish_messages(spark, sf):
    return _messages(spark, sf).select("message_id", F.col("importance").cast("long").alias("importance"),
                                       "channel", "text", "button")


@register("route_messages")
def q_route_messages(spark, sf):
    return _messages(spark, sf, curated=True).select("message_id", "channel", "button")


@register("promoted")
def q_promoted(spark, sf):
    p = PB.promoted(_messages(spark, sf, curated=True), V.callbacks(spark, sf))
    return p.select("message_id", "channel", "text", "button")


@register("republish")
def q_republish(spark, sf):
    msgs = _messages(spark, sf)
    sent = PB.promoted(msgs, V.callbacks(spark, sf))
    return PB.republish(msgs, sent).select("message_id", "channel")


# --- sources, DOM tier, streaming, errors -----------------------------------------------


@register("html_text_dom")
def q_html_text_dom(spark, sf):
    p = load(spark, sf, "pages")
    return html_text_dom(p.select(F.col("page_id").alias("id"), "html"))


@register("scan_feed_xml")
def q_scan_feed_xml(spark, sf):
    """Land the entries as RSS files (one folder per feed), scan them back."""
    path = scratch_path(spark, "rss")
    FX.write_rss(V.entries(spark, sf), path)
    e = FX.scan_feeds_xml(spark, rss_path=path)
    return tidy(e.select("feed_id", "link", "title", "summary", "source_title", "published"))


@register("feed_errors")
def q_feed_errors(spark, sf):
    return tidy(I.feed_errors(V.entries(spark, sf), V.feeds(spark, sf)))


#: Bytes of rows in a landed file.
LANDED_BYTES = 16 << 20


def _land_in_slices(df: DataFrame, time_col: str, root: str, slices: int = 4):
    """Land ``df`` as ``slices`` folders of equal time span, in time order (rows
    without a time in the last one), to feed a file stream; yields after each. The
    input is checkpointed once, so the cost is a fixed number of scans of it. A folder has
    files by its bytes, not by the splits of the tables it comes from: streams count files."""
    from ..operators.common import row_bytes
    from ..session import cut_lineage
    sec = F.unix_seconds(F.col(time_col))
    src = cut_lineage(df)
    lo, hi, size = src.agg(F.min(sec), F.max(sec), F.sum(row_bytes(src))).first()
    files = max(1, -(-(size or 0) // (slices * LANDED_BYTES)))
    step = ((hi - lo) // slices + 1) if lo is not None else 1
    for i in range(slices + 1):
        if i < slices:
            cond = (sec >= F.lit(lo + i * step)) & (sec < F.lit(lo + (i + 1) * step)) if lo is not None else F.lit(False)
        else:
            cond = sec.isNull()
        src.filter(cond).drop("_t").coalesce(files).write.mode("overwrite").parquet(f"{root}/{i:04d}")
        yield i


@register("stream_refresh")
def q_stream_refresh(spark, sf):
    """Polls in time order, each landed, accepted and committed as a delta; undated entries last."""
    from ..streaming.refresh import current, init_state, start_refresh_stream
    entries = V.entries(spark, sf)
    land, state, ckpt = (scratch_path(spark, n) for n in ("entries", "refresh-state", "refresh-ckpt"))
    timed = entries.withColumn("_t", F.coalesce(F.col("published").cast("timestamp"),
                                                 F.col("updated").cast("timestamp")))
    init_state(V.feeds(spark, sf), V.articles(spark, sf), state)
    for _ in _land_in_slices(timed, "_t", land):
        start_refresh_stream(spark, f"{land}/*", entries.schema, state, ckpt, V.refresh_now()).awaitTermination()
    return tidy(current(spark, state, "articles"))


@register("stream_similar")
def q_stream_similar(spark, sf):
    from ..streaming.similar import read_output, start_similarity_stream
    arts = V.articles(spark, sf).select("id", "create_time", "title", "uri")
    land, state, out, ckpt = (scratch_path(spark, n) for n in ("articles", "recent", "scores", "sim-ckpt"))
    for _ in _land_in_slices(arts, "create_time", land):
        pass
    q = start_similarity_stream(spark, f"{land}/*", arts.schema, state, out, ckpt)
    q.awaitTermination()
    return read_output(spark, out)


SECOND_PASS_CUTOFF = "2024-01-15 00:00:00"


@register("known_uris_second_pass")
def q_known_uris_second_pass(spark, sf):
    """Two refreshes: entries dated before the cutoff first, then the rest
    against the refreshed articles and marks; URIs of the second pass that are
    already stored, with their new references (J3 semi join)."""
    e = V.entries(spark, sf)
    t = F.coalesce(F.col("published").cast("timestamp"), F.col("updated").cast("timestamp"))
    cut = V.ts_lit(SECOND_PASS_CUTOFF)
    first = e.filter(t < cut)
    rest = e.filter(t.isNull() | (t >= cut))
    arts1, feeds1, _ = I.refresh(first, V.feeds(spark, sf), V.articles(spark, sf),
                                 V.refresh_now(), materialize=True)
    acc2 = I.accept_entries(rest, feeds1, V.refresh_now())
    return I.known_uris(acc2, arts1)


@register("stream_logs")
def q_stream_logs(spark, sf):
    """Log lines and quarantined records of a stream of files, counted per kind and text."""
    land, out, ckpt = (scratch_path(spark, n) for n in ("log-files", "log-lines", "log-ckpt"))
    V.log_file_lines(spark, sf).write.text(land)
    LG.start_log_stream(spark, land, out, ckpt).awaitTermination()
    lines = spark.read.schema("level string, line string").parquet(f"{out}/lines")
    bad = spark.read.schema("bad string, value string").parquet(f"{out}/quarantine")
    rows = lines.select(F.lit(None).cast("string").alias("bad"), F.col("line").alias("text")) \
        .unionByName(bad.select("bad", F.col("value").alias("text")))
    return rows.groupBy("bad", "text").agg(F.count(F.lit(1)).alias("n"))


@register("stream_new_uris")
def q_stream_new_uris(spark, sf):
    from ..streaming.uris import read_uris, start_uri_stream
    acc = _accepted(spark, sf).select("uri", "publish_time")
    land, out, ckpt = (scratch_path(spark, n) for n in ("accepted", "uris", "uri-ckpt"))
    for _ in _land_in_slices(acc.withColumn("_t", F.col("publish_time")), "_t", land, slices=2):
        start_uri_stream(spark, f"{land}/*", acc.schema, V.articles(spark, sf), out, ckpt).awaitTermination()
    return read_uris(spark, out)


def _interval(spark, sf, arrived, late_hours):
    from ..streaming.interval import IntervalSimilarity
    arts = V.articles(spark, sf).select("id", "create_time", "title", "uri", arrived.alias("arrived"))
    land, out = scratch_path(spark, "articles"), scratch_path(spark, "intervals")
    for _ in _land_in_slices(arts.withColumn("_t", F.timestamp_seconds("arrived")), "_t", land, slices=3):
        pass
    s = IntervalSimilarity(spark, f"{land}/*", arts.schema, out, arrived=F.col("arrived"), late_hours=late_hours, files_per_batch=6)
    for q in s.start():
        q.awaitTermination()
    return s.importance()


@register("stream_interval")
def q_stream_interval(spark, sf):
    """Interval join over articles that arrive in the order of their time: the importance of all."""
    return _interval(spark, sf, F.floor(F.col("id") / 100).cast("long"), 12)


@register("stream_interval_late")
def q_stream_interval_late(spark, sf):
    """Interval join over articles that arrive shuffled, many of them later than the watermark allows."""
    return _interval(spark, sf, (F.col("id") * 7 % 5).cast("long"), 3)


@register("claim_timers")
def q_claim_timers(spark, sf):
    """Stale claims requeued by timers, committed to the article table."""
    from ..sources.deltas import ArticleTable
    from ..streaming.claims import start_claim_stream
    land, root, ckpt = (scratch_path(spark, n) for n in ("claim-events", "claimed-articles", "claim-ckpt"))
    table = ArticleTable(spark, root)
    table.create(V.articles(spark, sf))
    V.claim_events(spark, sf).write.parquet(land)
    start_claim_stream(spark, land, root, ckpt).awaitTermination()
    return tidy(table.read().select("id", "status", "retries", F.date_trunc("second", "update_time").alias("update_time")))


@register("publish_outbox")
def q_publish_outbox(spark, sf):
    """Messages published in three batches: the first is killed after sending and replayed, the last one fails."""
    from ..session import cut_lineage
    from ..streaming.outbox import Outbox
    msgs = cut_lineage(_messages(spark, sf))
    root, calls = scratch_path(spark, "outbox"), []

    def send(rows, batch):
        calls.append(batch)
        if batch == 2:
            raise ConnectionError("the target is away")
        rows.write.mode("append").parquet(f"{root}/chat")  # a target that would take a message twice
        if calls == [0]:
            raise KeyboardInterrupt

    arrived = lambda: spark.read.schema("message_id string").parquet(f"{root}/chat")
    box = Outbox(spark, root, send, arrived)
    for batch in (0, 0, 1, 1, 2):
        # messages of earlier batches come again
        try:
            box.publish(msgs.where(F.col("message_id") % 3 <= batch), batch)
        except (KeyboardInterrupt, ConnectionError):
            pass
    got = arrived().groupBy("message_id").agg(F.count(F.lit(1)).alias("copies"))
    return box.status().join(got, "message_id", "left").select("message_id", "channel", "state", "attempts", F.coalesce("copies", F.lit(0)).alias("copies"))


@register("promoted_editors")
def q_promoted_editors(spark, sf):
    """Editors' messages after promotion, with or without their button."""
    return PB.unbuttoned(_messages(spark, sf, curated=True), V.callbacks(spark, sf)).select("message_id", "channel", "button")


@register("article_report")
def q_article_report(spark, sf):
    """Single-article reports of the captured articles' neighbours (batched lookup of ids)."""
    from ..session import cut_lineage
    arts = _publishable(spark, sf)
    ids = V.captures(spark, sf).select((F.col("id") + 2).alias("id"))
    vocab = _vocab(spark, sf, cut_lineage(SM.article_sentences(arts)))
    return SM.article_report(arts, vocab, ids, _store(spark, sf))


@register("seed_empty")
def q_seed_empty(spark, sf):
    """Seeding of an empty feed table: the default feeds, with the entries waiting for each."""
    return tidy(_with_entry_counts(spark, sf, SD.seed_if_empty(V.feeds(spark, sf).filter(F.lit(False)))))


@register("model_saved")
def q_model_saved(spark, sf):
    """Train, save, load: the vocabulary read back from its file."""
    path = scratch_path(spark, "model")
    T.train(V.articles(spark, sf), path)
    return tidy(T.load_model(spark, path))
