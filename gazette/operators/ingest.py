"""Feed refresh: incremental accept, URL dedup with reference counting,
per-feed high-water mark.

The reference walks each feed's entries in time order, one database
transaction per entry. As a set-based plan:

1. entry time = published, else updated, else ``now`` (undated);
2. join the (small, size-checked, broadcast) feed table for the old mark;
3. row predicates with the *old* mark: link present, strictly newer than the
   mark, raw link not blocked, title is news;
4. tie rule (W1): per (feed, time) only the first entry by position survives,
   because an accepted entry moves the mark to its time and the test is
   strict; undated entries are kept once per (feed, link);
5. articles: existing URIs get ``refs_count += hits`` and ``update_time = now``;
   new URIs are inserted once, first-wins by (feed, time, position);
6. feeds: mark = max accepted dated time, unchanged when none.

Only the accepted entries are shuffled; the article table is probed through
a broadcast of the accepted URIs when their bytes are under the bound, else
through a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import STATUS_NEW
from ..functions.times import entry_time
from ..functions.urls import is_blocked, strip_query
from .common import BROADCAST_BYTES, broadcast_if_bytes, broadcast_if_small, spread
from .titles import is_news_title

ARTICLE_COLUMNS = ["id", "create_time", "update_time", "feed_id", "uri", "status",
                   "retries", "title", "summary", "html", "refs_count", "source"]


def article_id(uri: Column) -> Column:
    """Id of a new article: the 128 bits of its URI's md5, as 32 hex digits. Deterministic, so that
    replays and concurrent jobs give an article the same id; ids are strings for that reason."""
    return F.md5(uri)


def timed_entries(entries: DataFrame, now: Column) -> DataFrame:
    t = F.coalesce(F.col("published").cast("timestamp"), F.col("updated").cast("timestamp"))
    return entries.withColumns({
        "dated": t.isNotNull(),
        "publish_time": entry_time(F.col("published"), F.col("updated"), now),
    })


def accept_entries(entries: DataFrame, feeds: DataFrame, now: Column,
                   blocklist: list[str] | None = None,
                   check_titles: bool = True) -> DataFrame:
    """Entries accepted by one refresh, with ``uri`` (stripped) and ``source``."""
    f = broadcast_if_small(feeds.select(
        F.col("id").alias("_fid"), F.col("last_publish_time").alias("_mark"),
        F.col("is_aggregator").alias("_agg")))
    e = timed_entries(spread(entries), now)
    j = e.join(f, e.feed_id == f._fid)
    keep = (F.col("link").isNotNull()
            & (F.col("_mark").isNull() | (F.col("_mark") < F.col("publish_time")))
            & ~is_blocked(F.col("link"), blocklist))
    if check_titles:
        keep = keep & is_news_title(F.col("title"))
    cand = j.filter(keep).withColumns({
        "uri": strip_query(F.col("link")),
        "source": F.when(F.col("_agg"), F.col("source_title")),
    })
    # tie rule: first entry by position per (feed, time), or per (feed, link)
    # when undated. A min_by aggregate combines map-side, so a hot feed/time
    # key is reduced before the shuffle (a window would sort it in one task).
    cols = [c for c in cand.columns if c not in ("_fid", "_mark", "_agg")]
    keys = [F.col("feed_id").alias("_k0"), F.col("dated").alias("_k1"),
            F.when(F.col("dated"), F.col("publish_time")).alias("_k2"),
            F.when(~F.col("dated"), F.col("link")).alias("_k3")]
    first = cand.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col("entry_pos")).alias("_r"))
    return first.select("_r.*")


def new_uris(accepted: DataFrame, articles: DataFrame) -> DataFrame:
    """Accepted URIs not stored yet (J3 anti join), one row per URI."""
    return (accepted.select("uri").distinct()
            .join(articles.select("uri"), "uri", "left_anti"))


def known_uris(accepted: DataFrame, articles: DataFrame) -> DataFrame:
    """Accepted URIs already stored, with the number of new references."""
    hits = accepted.groupBy("uri").agg(F.count(F.lit(1)).alias("hits"))
    return hits.join(articles.select("uri"), "uri", "left_semi")


def reference_hits(stored: DataFrame, accepted: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(uri, hits, first, known): what one refresh adds to each URI, written once.

    ``stored`` needs ``uri`` and ``feed_id`` and is scanned once, through a
    broadcast of the accepted URIs if their bytes are few. An undated entry
    whose (feed, URI) is stored was seen by an earlier run and adds nothing.
    """
    from ..session import cut_lineage
    uris = cut_lineage(accepted.select("uri").distinct())
    found = cut_lineage(stored.select("uri", "feed_id").join(broadcast_if_bytes(uris, max_bytes), "uri", "left_semi"))
    seen = found.select("uri", "feed_id", F.lit(False).alias("dated"))
    acc = accepted.join(broadcast_if_bytes(seen, max_bytes), ["uri", "feed_id", "dated"], "left_anti")
    per_uri = acc.groupBy("uri").agg(
        F.count(F.lit(1)).cast("int").alias("hits"),
        F.min_by(F.struct("feed_id", "summary", "source"),
                 F.struct("feed_id", "publish_time", "entry_pos")).alias("first"))
    known = found.select("uri").distinct().withColumn("known", F.lit(True))
    hits = per_uri.join(broadcast_if_bytes(known, max_bytes), "uri", "left")
    return cut_lineage(hits.withColumn("known", F.coalesce("known", F.lit(False))))


def article_delta(hits: DataFrame, now: Column) -> DataFrame:
    """Delta rows of one refresh (``sources.deltas``): references of stored URIs, attributes of new ones."""
    new = ~F.col("known")
    only_new = lambda c: F.when(new, c)
    return hits.select(
        "uri", "hits", now.alias("update_time"), only_new(F.lit(STATUS_NEW)).alias("status"), only_new(F.lit(0)).alias("retries"),
        only_new(article_id(F.col("uri"))).alias("id"), only_new(now).alias("create_time"), only_new(F.col("first.feed_id")).alias("feed_id"),
        only_new(F.col("first.summary")).alias("summary"), only_new(F.col("first.source")).alias("source"))


def upsert_articles(articles: DataFrame, accepted: DataFrame, now: Column,
                    max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Insert new URIs (first wins) and count references on known ones.

    Works on any subset of the article columns. Ids come out as strings (an
    older store's numbers as their decimal text). This form rewrites the whole
    table; a table that grows is kept as base and deltas (``sources.deltas``),
    which take only ``article_delta``. The stored articles are only ever
    streamed through broadcast hash joins while the refresh's URIs are few.
    """
    hits = reference_hits(articles, accepted, max_bytes)
    old = hits.filter("known").select("uri", F.col("hits").alias("_hits"))
    stored = articles.join(broadcast_if_bytes(old, max_bytes), "uri", "left")
    hit = F.col("_hits").isNotNull()
    cols = articles.columns       # any subset of ARTICLE_COLUMNS (e.g. without html)
    updated = stored.select(*[
        (F.when(hit, F.col("refs_count") + F.col("_hits")).otherwise(F.col("refs_count"))
         .cast("int").alias(c)) if c == "refs_count" else
        (F.when(hit, now).otherwise(F.col("update_time")).alias(c)) if c == "update_time" else
        F.col(c).cast("string").alias(c) if c == "id" else
        F.col(c) for c in cols])
    fresh = article_delta(hits.filter(~F.col("known")), now).select(
        "*", F.col("hits").alias("refs_count"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("html"))
    return updated.unionByName(fresh.select(*[F.col(c).cast("int").alias(c) if c == "feed_id" else F.col(c) for c in cols]))


def feed_marks(feeds: DataFrame, accepted: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Feeds with the new high-water mark (max accepted dated time).

    ``fetches`` (feed_id, fetched_at, etag, modified), one row per answered
    request, gives the validators for the next conditional request: of each the
    one that a feed's latest answer with it brought (ties to the greater); a feed
    whose answers brought none keeps its own.
    """
    m = (accepted.filter(F.col("dated")).groupBy("feed_id")
         .agg(F.max("publish_time").alias("_new")))
    j = feeds.join(broadcast_if_small(m), feeds.id == m.feed_id, "left").drop("feed_id")
    taken = {"last_publish_time": F.greatest(F.col("_new"), F.col("last_publish_time"))}
    if fetches is not None:
        validators = ("etag", "modified")
        last = fetches.groupBy(F.col("feed_id").alias("_feed")).agg(*[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("fetched_at", c))).alias(f"_{c}") for c in validators])
        j = j.join(broadcast_if_small(last), j.id == last._feed, "left")
        taken |= {c: F.coalesce(f"_{c}", c) for c in validators}
    return j.select(*[taken[c].alias(c) if c in taken else F.col(c) for c in feeds.columns])


def refresh(entries: DataFrame, feeds: DataFrame, articles: DataFrame, now: Column,
            blocklist: list[str] | None = None, materialize: bool = True,
            fetches: DataFrame | None = None):
    """One refresh: returns (articles', feeds', accepted entries).

    With ``materialize`` the accepted entries are checkpointed (shared
    checkpoint folder) once, so both outputs reuse them and a lost executor
    does not re-run title annotation.
    """
    acc = accept_entries(entries, feeds, now, blocklist)
    if materialize:
        from ..session import cut_lineage
        acc = cut_lineage(acc)
    return upsert_articles(articles, acc, now), feed_marks(feeds, acc, fetches), acc


def feed_errors(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """(feed_id, entry_pos, error) for entries a refresh cannot use: unknown
    feed, missing link, unparsed record, or a date text that does not parse
    (such an entry would be taken as undated). Reported, never raised, so one bad
    feed or record does not stop the others."""
    f = broadcast_if_small(feeds.select(F.col("id").alias("_fid")))
    j = entries.join(f, entries.feed_id == f._fid, "left")
    corrupt = (F.col("_corrupt_record").isNotNull() if "_corrupt_record" in entries.columns
               else F.lit(False))
    bad_date = ((F.col("date_text").isNotNull() & F.col("published").isNull() & F.col("updated").isNull())
                if "date_text" in entries.columns else F.lit(False))
    err = (F.when(corrupt, F.lit("unparsed record"))
           .when(F.col("_fid").isNull(), F.lit("unknown feed"))
           .when(F.col("link").isNull(), F.lit("missing link"))
           .when(bad_date, F.lit("bad date")))
    return j.select("feed_id", "entry_pos", err.alias("error")).filter(F.col("error").isNotNull())
