"""Article lifecycle as table updates: reschedule, claim, complete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import (MAX_RETRIES, STALE_AFTER_HOURS, STATUS_DONE,
                               STATUS_ERROR, STATUS_NEW, STATUS_QUEUED)
from ..functions.text import reader_title
from .common import broadcast_if_bytes
from .sample import bottom_k, fetch


def stale(articles: DataFrame, now: Column, hours: int = STALE_AFTER_HOURS) -> Column:
    return (F.col("status") == STATUS_QUEUED) & (F.col("update_time") < now - F.expr(f"INTERVAL {int(hours)} HOURS"))


def requeue_status(retries: Column, max_retries: int = MAX_RETRIES) -> Column:
    """N while the retries are below ``max_retries``, else E."""
    return F.when(retries < max_retries, F.lit(STATUS_NEW)).otherwise(F.lit(STATUS_ERROR))


def reschedule(articles: DataFrame, now: Column, max_retries: int = MAX_RETRIES,
               hours: int = STALE_AFTER_HOURS) -> DataFrame:
    """Queued articles older than ``hours``: retries + 1, back to N while
    below ``max_retries``, else E; the update touches ``update_time``."""
    s = stale(articles, now, hours)
    r = F.col("retries") + 1
    return articles.withColumns({
        "retries": F.when(s, r).otherwise(F.col("retries")).cast("int"),
        "status": F.when(s, requeue_status(r, max_retries)).otherwise(F.col("status")),
        "update_time": F.when(s, now).otherwise(F.col("update_time")),
    })


def reschedule_delta(articles: DataFrame, now: Column, max_retries: int = MAX_RETRIES,
                     hours: int = STALE_AFTER_HOURS) -> DataFrame:
    """Delta rows (``sources.deltas``) of ``reschedule``: the stale articles only."""
    r = F.col("retries") + 1
    return articles.filter(stale(articles, now, hours)).select(
        "uri", now.alias("update_time"), r.cast("int").alias("retries"), requeue_status(r, max_retries).alias("status"))


def claim_delta(picked: DataFrame, now: Column) -> DataFrame:
    """Delta rows of ``claim``: the picked articles only."""
    return picked.select("uri", now.alias("update_time"), F.lit(STATUS_QUEUED).alias("status"))


def pick_new(articles: DataFrame, k: int = 1, seed: str | None = "0") -> DataFrame:
    """Up to ``k`` random articles with status N (id, uri, sample_seed); a new choice each time for seed None.
    The limit is the feature: one browser tab claims one article."""
    new = articles.filter(F.col("status") == STATUS_NEW).select("id", "uri")
    return fetch(new, bottom_k(new, k, seed))


def claim(articles: DataFrame, picked: DataFrame, now: Column) -> DataFrame:
    """Picked articles move N -> Q (``picked`` is broadcast if its bytes are few)."""
    p = broadcast_if_bytes(picked.select(F.col("id").cast("string").alias("_pid")))
    j = articles.join(p, F.col("id").cast("string") == F.col("_pid"), "left")
    hit = F.col("_pid").isNotNull()
    return j.withColumns({
        "status": F.when(hit, F.lit(STATUS_QUEUED)).otherwise(F.col("status")),
        "update_time": F.when(hit, now).otherwise(F.col("update_time")),
    }).drop("_pid")


def unknown_captures(articles: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures whose id no article has (``save_content`` leaves them out)."""
    known = articles.select(F.col("id").cast("string").alias("_aid"))
    return captures.join(known, F.col("id").cast("string") == F.col("_aid"), "left_anti")


def save_content(articles: DataFrame, captures: DataFrame, now: Column, time_col: str | None = None) -> DataFrame:
    """Captured pages set html, reader title and status D (any status).

    Of several captures of one id the latest by ``time_col`` counts; ties, and
    captures without a time, go to the greatest (title, html). Pages carry
    html, so no broadcast is asked for."""
    page = F.struct("title", "html")
    order = F.struct(time_col, "title", "html") if time_col else page
    c = captures.groupBy(F.col("id").cast("string").alias("_cid")).agg(F.max_by(page, order).alias("_page")).select(
        "_cid", reader_title(F.col("_page.title")).alias("_title"), F.col("_page.html").alias("_html"))
    j = articles.join(c, F.col("id").cast("string") == F.col("_cid"), "left")
    hit = F.col("_cid").isNotNull()
    return j.withColumns({
        "html": F.when(hit, F.col("_html")).otherwise(F.col("html")),
        "title": F.when(hit, F.col("_title")).otherwise(F.col("title")),
        "status": F.when(hit, F.lit(STATUS_DONE)).otherwise(F.col("status")),
        "update_time": F.when(hit, now).otherwise(F.col("update_time")),
    }).drop("_cid", "_title", "_html")
