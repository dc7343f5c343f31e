"""Publishing: display source, publish gate, message text, routing, promotion.

The publish job computes the gate (importance > 0) first and summarises only
the surviving articles; the reference summarised every article before
looking at the gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (ANONYMOUS_SOURCE, DEFAULT_TOP_N, IMPORTANCE_ICON,
                               MESSAGE_TEMPLATE, NOT_FETCHED_TEMPLATE, PROMOTE_BUTTON_TEMPLATE,
                               PROMOTE_CALLBACK, STATUS_DONE, SUMMARY_LINE_SEPARATOR,
                               SUMMARY_LINE_TEMPLATE)
from ..functions.text import fill
from .common import broadcast_if_bytes, broadcast_if_small
from .similarity import importance as importance_of
from .summarize import summarize
from .vectors import VectorStore

PUBLIC_CHANNEL = "public"
EDITORS_CHANNEL = "editors"


def display_source(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Add ``display_source``: article source, else feed name, else Anonymous.

    The feed table is a small dimension: broadcast after a size check.
    """
    f = broadcast_if_small(feeds.select(F.col("id").alias("_fid"), F.col("name").alias("_fname")))
    j = articles.join(f, articles.feed_id == f._fid, "left")
    return j.withColumn("display_source", F.coalesce(
        F.col("source"), F.col("_fname"), F.lit(ANONYMOUS_SOURCE))).drop("_fid", "_fname")


def publishable(articles: DataFrame) -> DataFrame:
    """Add ``publishable`` and ``reason`` (NULL when publishable)."""
    fetched = F.coalesce((F.col("status") == STATUS_DONE) & F.col("html").isNotNull(), F.lit(False))
    return articles.withColumns({
        "publishable": fetched & F.col("title").isNotNull(),
        "reason": F.when(~fetched, fill(NOT_FETCHED_TEMPLATE, id=F.col("id").cast("string")))
        .when(F.col("title").isNull(), F.lit("no title")),
    })


def message_text(title: Column, summary: Column, uri: Column, source: Column) -> Column:
    """The message: title, one line per summary sentence, link labelled with
    the source (title and source are not escaped)."""
    lines = F.array_join(F.transform(summary, lambda s: fill(SUMMARY_LINE_TEMPLATE, sentence=s)),
                         SUMMARY_LINE_SEPARATOR)
    return fill(MESSAGE_TEMPLATE, title=title, summary=lines, uri=uri, source=source)


def promote_button(importance: Column) -> Column:
    icons = F.repeat(F.lit(IMPORTANCE_ICON), F.coalesce(importance, F.lit(0)))
    return fill(PROMOTE_BUTTON_TEMPLATE, icons=icons)


def route(messages: DataFrame, curated: bool = False,
          public_channel: str = PUBLIC_CHANNEL, editors_channel: str = EDITORS_CHANNEL) -> DataFrame:
    """Add ``channel`` and ``button``: editors with a promote button when
    curated, else the public channel without a button."""
    if curated:
        return messages.withColumns({"channel": F.lit(editors_channel),
                                     "button": promote_button(F.col("importance"))})
    return messages.withColumns({"channel": F.lit(public_channel),
                                 "button": F.lit(None).cast("string")})


def publish_messages(articles: DataFrame, feeds: DataFrame, vocab: DataFrame,
                     store: VectorStore | None = None, top_n: int = DEFAULT_TOP_N,
                     curated: bool = False, sentences: DataFrame | None = None,
                     since: Column | None = None) -> DataFrame:
    """(message_id, importance, channel, text, button) for every publishable
    article with importance > 0; the gate runs before the summariser, which
    annotates only the surviving articles (or reuses ``sentences``). With
    ``since``, only articles created since then are considered (incremental
    runs read the 12 h look-back, not the history)."""
    from ..session import cut_lineage
    # the gate is small (ids + counts); materialise it once, it is joined by
    # every branch of the summariser below
    imp = cut_lineage(importance_of(articles, since=since).filter(F.col("importance") > 0))
    gated = publishable(articles).filter("publishable").join(broadcast_if_bytes(imp), "id")
    if sentences is not None:
        # the pages are annotated already: the rest of the surviving rows is written once, not looked up in the pages per branch
        gated = cut_lineage(gated.drop("html"))
    summ = summarize(gated, vocab, store, top_n, sentences=sentences).select(
        F.col("doc_id").alias("id"), F.col("summary").alias("_sentences"))
    src = display_source(gated, feeds)
    msg = src.join(summ, "id").select(
        F.col("id").alias("message_id"), "importance",
        message_text(F.col("title"), F.col("_sentences"), F.col("uri"), F.col("display_source")).alias("text"))
    return route(msg, curated)


def promoted(messages: DataFrame, callbacks: DataFrame,
             public_channel: str = PUBLIC_CHANNEL) -> DataFrame:
    """Messages with a ``promote`` callback, copied to the public channel
    without a button; repeated callbacks collapse (semi join)."""
    hits = callbacks.filter(F.col("data") == PROMOTE_CALLBACK).select("message_id")
    return (messages.join(hits, "message_id", "left_semi")
            .withColumns({"channel": F.lit(public_channel), "button": F.lit(None).cast("string")}))


def unbuttoned(messages: DataFrame, callbacks: DataFrame,
               editors_channel: str = EDITORS_CHANNEL) -> DataFrame:
    """Messages after their promotion: an editors' message with a ``promote``
    callback loses its button; all others stay as they are."""
    hits = callbacks.filter(F.col("data") == PROMOTE_CALLBACK).select("message_id").distinct().withColumn("_hit", F.lit(True))
    j = messages.join(hits, "message_id", "left")
    gone = F.col("_hit").isNotNull() & (F.col("channel") == editors_channel)
    return j.withColumn("button", F.when(~gone, F.col("button"))).select(*messages.columns)


def republish(messages: DataFrame, sent: DataFrame) -> DataFrame:
    """Idempotent sink write: messages whose id is not in the sink yet."""
    return messages.join(sent.select("message_id"), "message_id", "left_anti")
