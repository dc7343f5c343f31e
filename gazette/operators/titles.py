"""Non-news title filter over annotated title tokens (array form, row-local)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.annotate import let, tokens_of
from ..functions.fixed import (TITLE_ANYWHERE_PATTERNS, TITLE_DEAL_LEMMA,
                               TITLE_DEAL_PATTERNS, TITLE_START_PATTERNS)


def _any(conds):
    return reduce(lambda a, b: a | b, conds)


def _match_at(toks: Column, n: Column, pattern, i: Column) -> Column:
    """All terms of ``pattern`` hold at positions i, i+1, ...; false when the
    pattern would run past the end."""
    terms = [F.get(toks, i + j)[field] == value for j, (field, value) in enumerate(pattern)]
    inside = (i + len(pattern)) <= n
    return inside & F.coalesce(reduce(lambda a, b: a & b, terms), F.lit(False))


def news_title_tokens(toks: Column) -> Column:
    """True if a title (given as tokens) is news.

    Fewer than 2 tokens: not news. Start positions scanned are 0 .. n-3 only,
    so 2-token titles always pass and a 2-term pattern at the very end is not
    seen. Start-only patterns apply at position 0; the ``SYM NUM`` pattern
    only when the lemma ``deal`` occurs somewhere in the title.
    """
    def body(arr):
        n = F.size(arr)
        has_deal = F.exists(arr, lambda t: t["lemma"] == TITLE_DEAL_LEMMA)
        starts = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))

        def hit(i):
            anywhere = _any([_match_at(arr, n, p, i) for p in TITLE_ANYWHERE_PATTERNS])
            deal = has_deal & _any([_match_at(arr, n, p, i) for p in TITLE_DEAL_PATTERNS])
            first = (i == 0) & _any([_match_at(arr, n, p, i) for p in TITLE_START_PATTERNS])
            return anywhere | deal | first

        # sequence(0, -1) would count down, hence the n >= 3 guard
        blocked = (n >= 3) & F.exists(starts, hit)
        return F.when(n < 2, F.lit(False)).otherwise(~blocked)
    return let(toks, body)


def is_news_title(title: Column) -> Column:
    """News-title test on raw text; a NULL title passes."""
    return F.when(title.isNull(), F.lit(True)).otherwise(news_title_tokens(tokens_of(title, parse=False)))
