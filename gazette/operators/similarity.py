"""Near-duplicate stories: title word sets, Jaccard, the sliding 12 h window.

The reference scores each new article against every article of the last 12
hours (a quadratic band join). Here the same pairs come out of an equi-join
on ``(token, time bucket)``:

* only pairs that share a token can score above 0, so candidate pairs are
  generated by joining on a shared token;
* the 12 h window is covered by 12 h buckets: the earlier article is
  replicated to its bucket and the next one, the later article probes its own
  bucket, then the exact window predicate is applied;
* for a threshold t > 0 only a *prefix* of each word set is indexed (tokens in
  ascending global frequency, the first ``|x| - floor(t*|x|)``): any pair
  with Jaccard >= t shares a prefix token (all-pairs / PPJoin prefix filter),
  so frequent tokens -- the skew -- are mostly never join keys;
* each pair is emitted once, from its first common prefix token, so no
  distinct/shuffle is needed to de-duplicate candidates.

``importance`` (the count the publish gate needs) goes further and never
forms article pairs at all: see ``importance_counted`` below. The pair join
serves ``similar_pairs`` (the pair list itself) and cross-checks.

Everything is DataFrame code: explode, aggregate, window, equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.annotate import annotated, tokens_of
from ..functions.fixed import (CONTENT_LEMMA_PATTERN, SIMILARITY_THRESHOLD,
                               SIMILARITY_WINDOW_HOURS)
from ..functions.urls import url_host
from .common import broadcast_if_bytes


def content_tokens(tokens: Column) -> Column:
    """Tokens that are not stop words and whose lemma starts with 2 letters."""
    return F.filter(tokens, lambda t: (~t["is_stop"]) & t["lemma"].rlike(CONTENT_LEMMA_PATTERN))


def wordset(title: Column) -> Column:
    """Distinct content lemmas of a title, sorted; empty for NULL."""
    lemmas = F.transform(content_tokens(tokens_of(title, parse=False)), lambda t: t["lemma"])
    return F.coalesce(F.array_sort(F.array_distinct(lemmas)), F.array().cast("array<string>"))


def tokens_in_batches(span: Column) -> Column:
    """``tokens_of`` of a plain text column, annotated batch by batch (``functions.words``); none for NULL."""
    return annotated(F.array(F.struct(F.lit(0).alias("sent"), span.alias("text"))))[0]["tokens"]


def wordset_in_batches(title: Column) -> Column:
    """``wordset`` of a plain text column, annotated batch by batch."""
    lemmas = F.transform(content_tokens(tokens_in_batches(title)), lambda t: t["lemma"])
    return F.array_sort(F.array_distinct(lemmas))


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / (|a| + |b| - |a ∩ b|); 0.0 when either set is empty."""
    inter = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(inter / (F.size(a) + F.size(b) - inter)))


def prepare(articles: DataFrame, id_col="id", time_col="create_time",
            title_col="title", uri_col="uri") -> DataFrame:
    """(id, ct, site, words) for the similarity operators."""
    from .common import spread
    return spread(articles).select(
        F.col(id_col).alias("id"), F.col(time_col).alias("ct"),
        url_host(F.col(uri_col)).alias("site"), F.explode(F.array(wordset_in_batches(F.col(title_col)))).alias("words"))


def _materialized(base: DataFrame) -> DataFrame:
    """Checkpoint the prepared word sets (id, time, site, words): they feed the
    token frequencies, the prefixes and both join sides, and annotating the
    titles once is much cheaper than once per branch."""
    from ..session import cut_lineage
    return cut_lineage(base)


def _prefix_sets(base: DataFrame, threshold: float) -> DataFrame:
    """Add ``prefix``: the indexed tokens of each word set in global order."""
    if threshold <= 0:
        return base.withColumn("prefix", F.col("words"))
    exploded = base.select("id", F.explode("words").alias("token"))
    freq = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = exploded.join(freq, "token")
    ordered = ranked.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ord"))
    n = F.size("ord")
    # Jaccard > t needs an overlap of at least floor(t*|x|) + 1 tokens, so the
    # first |x| - floor(t*|x|) tokens suffice; the epsilon only ever lengthens
    # the prefix (0.3 * 10 is 3.0000000000000004 in binary floating point).
    plen = n - F.floor(F.lit(threshold) * n - F.lit(1e-9))
    with_prefix = ordered.select(
        "id", F.transform(F.slice("ord", 1, plen), lambda s: s["token"]).alias("prefix"))
    return base.join(with_prefix, "id", "left").withColumn(
        "prefix", F.coalesce("prefix", F.array().cast("array<string>")))


#: Articles of one (token, bucket) that one task joins; more are dealt over tiles.
TILE = 4096


def _tiled(later: DataFrame, earlier: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``tile``: a (token, bucket) of over ``tile`` later rows is dealt over tiles by id,
    and its earlier rows are copied to each, so that every pair still meets exactly once.

    Hot keys are at most rows / ``tile``; they are written, and broadcast if their bytes are few."""
    from ..session import cut_lineage
    hot = cut_lineage(later.groupBy("token", F.col("a_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
                      .filter(F.col("n") > tile).select("token", "bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    if hot.isEmpty():
        return later.withColumn("a_tile", F.lit(0)), earlier.withColumn("b_tile", F.lit(0))
    at = lambda c: broadcast_if_bytes(hot.withColumnRenamed("bucket", c))
    tiles = F.coalesce("tiles", F.lit(1))
    return (later.join(at("a_bucket"), ["token", "a_bucket"], "left").withColumn("a_tile", F.pmod(F.xxhash64("a_id"), tiles).cast("int")).drop("tiles"),
            earlier.join(at("b_bucket"), ["token", "b_bucket"], "left").withColumn("b_tile", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("tiles"))


def similar_pairs(articles: DataFrame, threshold: float = 0.0,
                  window_hours: int = SIMILARITY_WINDOW_HOURS,
                  prepared: bool = False, tile: int = TILE) -> DataFrame:
    """Pairs (id, other_id, score) with score > threshold, where other_id is an
    earlier article ((create_time, id) order) of another site whose
    create_time lies in (create_time - window, create_time].

    Pairs scoring 0 (no shared word, same site, empty set) are not emitted:
    they cannot pass any threshold >= 0.
    """
    base = articles if prepared else _materialized(prepare(articles))
    base = base.filter(F.size("words") > 0)
    span = window_hours * 3600
    from ..session import cut_lineage
    base = cut_lineage(_prefix_sets(base, threshold)).withColumn(
        "bucket", F.floor(F.unix_seconds(F.col("ct")) / span))
    later = base.select(
        F.col("id").alias("a_id"), F.col("ct").alias("a_ct"), F.col("site").alias("a_site"),
        F.col("words").alias("a_words"), F.col("prefix").alias("a_prefix"),
        F.col("bucket").alias("a_bucket"), F.explode("prefix").alias("token"))
    earlier = base.select(
        F.col("id").alias("b_id"), F.col("ct").alias("b_ct"), F.col("site").alias("b_site"),
        F.col("words").alias("b_words"), F.col("prefix").alias("b_prefix"),
        F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("b_bucket"),
    ).select("*", F.explode("b_prefix").alias("token"))
    later, earlier = _tiled(later, earlier, tile)
    cond = [
        later.token == earlier.token,
        later.a_bucket == earlier.b_bucket,
        later.a_tile == earlier.b_tile,
        earlier.b_ct > later.a_ct - F.expr(f"INTERVAL {int(window_hours)} HOURS"),
        (earlier.b_ct < later.a_ct) | ((earlier.b_ct == later.a_ct) & (earlier.b_id < later.a_id)),
        ~earlier.b_site.eqNullSafe(later.a_site),
    ]
    if threshold > 0:
        na, nb = F.size(later.a_words), F.size(earlier.b_words)
        cond += [nb >= F.lit(threshold) * na, nb * F.lit(threshold) <= na]
    joined = later.join(earlier, cond)
    # emit each pair once: from its first common prefix token
    first_common = F.element_at(F.array_intersect(F.col("a_prefix"), F.col("b_prefix")), 1)
    pairs = joined.filter(first_common == later.token).select(
        F.col("a_id").alias("id"), F.col("b_id").alias("other_id"),
        jaccard(F.col("a_words"), F.col("b_words")).alias("score"))
    return pairs.filter(F.col("score") > threshold)


def importance(articles: DataFrame, threshold: float = SIMILARITY_THRESHOLD,
               window_hours: int = SIMILARITY_WINDOW_HOURS,
               since: Column | None = None, time_col: str = "create_time") -> DataFrame:
    """Per article: number of earlier in-window articles of other sites whose
    title Jaccard is above ``threshold`` (0 when none).

    Skew-safe form: article pairs are never enumerated (see
    ``importance_counted``), so a group of copies holding a large share of
    all rows costs linear work. With ``since`` only articles created at or
    after it are scored, and only the look-back window before it is read as
    neighbours (a time filter the scan can prune on), so a periodic job does
    not rescan the whole history.
    """
    if since is None:
        return importance_counted(articles, threshold, window_hours)
    window = F.expr(f"INTERVAL {int(window_hours)} HOURS")
    recent = articles.filter(F.col(time_col) > since - window)
    base = _materialized(prepare(recent, time_col=time_col))
    return importance_counted(base, threshold, window_hours, prepared=True,
                              only=base.filter(F.col("ct") >= since).select("id"))


def importance_pairs(articles: DataFrame, threshold: float = SIMILARITY_THRESHOLD,
                     window_hours: int = SIMILARITY_WINDOW_HOURS) -> DataFrame:
    """``importance`` through the article-pair join (counts the emitted pairs)."""
    base = _materialized(prepare(articles))
    counts = (similar_pairs(base, threshold, window_hours, prepared=True)
              .groupBy("id").agg(F.count(F.lit(1)).alias("importance")))
    return (base.select("id").join(counts, "id", "left")
            .select("id", F.coalesce("importance", F.lit(0)).cast("long").alias("importance")))


def similar_pairs_literal(articles: DataFrame, window_hours: int = SIMILARITY_WINDOW_HOURS,
                          prepared: bool = False) -> DataFrame:
    """Brute-force band join: every earlier in-window article, zeros included.

    Quadratic in the window; used as the test oracle of ``similar_pairs`` on
    small fixtures only.
    """
    base = articles if prepared else prepare(articles)
    a = base.select(*[F.col(c).alias("a_" + c) for c in base.columns])
    b = base.select(*[F.col(c).alias("b_" + c) for c in base.columns])
    cond = ((b.b_ct > a.a_ct - F.expr(f"INTERVAL {int(window_hours)} HOURS"))
            & ((b.b_ct < a.a_ct) | ((b.b_ct == a.a_ct) & (b.b_id < a.a_id))))
    return a.join(b, cond).select(
        F.col("a_id").alias("id"), F.col("b_id").alias("other_id"),
        F.when(F.col("a_site").eqNullSafe(F.col("b_site")), F.lit(0.0))
         .otherwise(jaccard(F.col("a_words"), F.col("b_words"))).alias("score"))


def recent_window(recent: DataFrame, now: Column,
                  window_hours: int = SIMILARITY_WINDOW_HOURS,
                  time_col: str = "create_time", day_col: str | None = None) -> DataFrame:
    """Rows still in the window: ``create_time > now - window`` (strict).

    The time predicate is pushed to the Parquet scan; on a table partitioned
    by creation day pass ``day_col`` and the implied day bound prunes whole
    partitions as well.
    """
    lower = now - F.expr(f"INTERVAL {int(window_hours)} HOURS")
    out = recent.filter(F.col(time_col) > lower)
    if day_col is not None:
        out = out.filter(F.col(day_col) >= F.to_date(lower))
    return out


def recent_evicted(recent: DataFrame, now: Column,
                   window_hours: int = SIMILARITY_WINDOW_HOURS,
                   time_col: str = "create_time") -> DataFrame:
    """Rows that leave the window: ``create_time <= now - window``."""
    return recent.filter(F.col(time_col) <= now - F.expr(f"INTERVAL {int(window_hours)} HOURS"))


def recent_insert(recent: DataFrame, new_rows: DataFrame, key: str = "id") -> DataFrame:
    """Insert rows whose key is absent; an existing row always wins.

    Among new rows with the same key the first by (create_time, key) wins.
    """
    w = Window.partitionBy(key).orderBy(F.col("create_time"), F.col(key))
    fresh = (new_rows.join(recent.select(key), key, "left_anti")
             .withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn"))
    return recent.unionByName(fresh.select(*recent.columns))


# --- importance without enumerating article pairs ----------------------------------
#
# A group of copies (identical titles) may hold a large share of all rows; the
# pair join above would emit every pair inside it. Here article pairs are
# never formed:
#
# 1. distinct word sets per 12 h bucket (map-side de-duplication collapses the
#    copies before any shuffle) are joined with the prefix filter to find
#    similar set pairs (W1 in bucket bA, W2 in bucket bA or bA - 1), including
#    W1 = W2;
# 2. for every such pair, the articles of W1 are "queries" and those of W2
#    "points"; an article's count is #points with (ct, id) before its own
#    minus #points with ct <= ct - 12 h, minus the same two counts within its
#    own site. Counts are running sums over a range-partitioned sort, so a
#    hot group is split across tasks by time, then stitched with per-partition
#    offsets (one row per partition and group).

_NULL_SITE = "\u0000"


def _set_key(words: Column) -> Column:
    return F.md5(F.array_join(words, "\u0001"))


def _similar_sets(base: DataFrame, threshold: float) -> DataFrame:
    """(w1, b1, w2, b2): distinct word sets of bucket b1 and b2 in {b1, b1-1}
    with Jaccard > threshold (each pair once)."""
    sets = base.select("wkey", "bucket", "words").dropDuplicates(["wkey", "bucket"])
    distinct_sets = sets.select(F.col("wkey").alias("id"), "words").dropDuplicates(["id"])
    prefixes = _prefix_sets(distinct_sets, threshold).select(F.col("id").alias("wkey"), "prefix")
    sets = sets.join(prefixes, "wkey")
    later = sets.select(F.col("wkey").alias("w1"), F.col("bucket").alias("b1"),
                        F.col("words").alias("a_words"), F.col("prefix").alias("a_prefix"),
                        F.explode("prefix").alias("token"))
    earlier = sets.select(F.col("wkey").alias("w2"), F.col("bucket").alias("b2"),
                          F.col("words").alias("b_words"), F.col("prefix").alias("b_prefix"),
                          F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bk")
                          ).select("*", F.explode("b_prefix").alias("token"))
    na, nb = F.size(later.a_words), F.size(earlier.b_words)
    cond = [later.token == earlier.token, later.b1 == earlier.bk]
    if threshold > 0:
        cond += [nb >= F.lit(threshold) * na, na >= F.lit(threshold) * nb]
    j = later.join(earlier, cond)
    first_common = F.element_at(F.array_intersect(F.col("a_prefix"), F.col("b_prefix")), 1)
    return (j.filter((first_common == later.token)
                     & (jaccard(F.col("a_words"), F.col("b_words")) > threshold))
            .select("w1", "b1", "w2", "b2"))


def _points_before(events: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``before``: number of point events ordered before each event within
    ``keys`` (order: t, bounds last, id, kind), computed without a single-group task."""
    from ..session import cut_lineage
    order = ["t", "bound", "id", "kind"]
    # partition ids must be the same in both branches below: materialise them
    r = cut_lineage(events.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_local", F.coalesce(F.sum("is_point").over(w), F.lit(0)))
    tot = r.groupBy("_pid", *keys).agg(F.sum("is_point").alias("_n"))
    wo = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", *keys, F.coalesce(F.sum("_n").over(wo), F.lit(0)).alias("_off"))
    return r.join(off, ["_pid", *keys]).withColumn("before", F.col("_local") + F.col("_off"))


def importance_counted(articles: DataFrame, threshold: float = SIMILARITY_THRESHOLD,
                       window_hours: int = SIMILARITY_WINDOW_HOURS,
                       prepared: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Same result as ``importance`` without forming article pairs.

    ``only`` (a DataFrame with column ``id``) restricts the scored articles;
    all articles still count as earlier neighbours (the streaming job scores
    a micro-batch against its state this way).
    """
    base = articles if prepared else _materialized(prepare(articles))
    span = window_hours * 3600
    b = (base.filter(F.size("words") > 0)
         .withColumns({"wkey": _set_key(F.col("words")),
                       "bucket": F.floor(F.unix_seconds(F.col("ct")) / span),
                       "skey": F.coalesce(F.col("site"), F.lit(_NULL_SITE))}))
    from ..session import cut_lineage
    # both sides of the join below read the pairs of sets: they are found once
    pairs = cut_lineage(_similar_sets(b, threshold))
    gid = F.concat_ws("|", "w1", F.col("b1").cast("string"), "w2", F.col("b2").cast("string"))
    art = b.select("id", "ct", "skey", "wkey", "bucket")
    qart = art if only is None else art.join(only.select("id"), "id", "left_semi")
    q = qart.join(pairs, (qart.wkey == pairs.w1) & (qart.bucket == pairs.b1)).select(
        gid.alias("gid"), "skey", "ct", "id")
    p = art.join(pairs, (art.wkey == pairs.w2) & (art.bucket == pairs.b2)).select(
        gid.alias("gid"), "skey", F.col("ct").alias("t"), "id")
    window = F.expr(f"INTERVAL {int(window_hours)} HOURS")
    id_type = dict(base.dtypes)["id"]
    no_id = F.lit(None).cast(id_type)
    # a query is its own event and, after all points of its time whatever their ids, the window's lower bound
    bounds = F.explode(F.array(F.struct(F.col("ct").alias("t"), F.lit(0).alias("bound"), F.lit(1).alias("sign")),
                               F.struct((F.col("ct") - window).alias("t"), F.lit(1).alias("bound"), F.lit(-1).alias("sign"))))
    events = (p.select("gid", "skey", "t", F.lit(0).alias("bound"), "id", F.lit(1).alias("kind"), F.lit(1).alias("is_point"),
                       no_id.alias("a"), F.lit(0).alias("sign"))
              .unionByName(q.select("gid", "skey", "id", bounds.alias("e")).select(
                  "gid", "skey", "e.t", "e.bound", "id", F.lit(0).alias("kind"), F.lit(0).alias("is_point"), F.col("id").alias("a"), "e.sign")))
    events = cut_lineage(events)
    all_sites = _points_before(events, ["gid"]).filter("is_point = 0") \
        .select("a", (F.col("sign") * F.col("before")).alias("c"))
    same_site = _points_before(events, ["gid", "skey"]).filter("is_point = 0") \
        .select("a", (-F.col("sign") * F.col("before")).alias("c"))
    counts = all_sites.unionByName(same_site).groupBy("a").agg(F.sum("c").alias("importance"))
    scored = base.select("id") if only is None else only.select("id")
    return (scored.join(counts, scored.id == counts.a, "left")
            .select("id", F.coalesce("importance", F.lit(0)).cast("long").alias("importance")))
