"""Exact samples of k rows by smallest hash, from ids alone.

A row's rank is the md5 of its id and the seed, ties to the smaller id, so a sample
of the union of tables is the sample of their samples, and the same seed gives the
same rows. The rows are counted; of a larger table only those whose hash lies below
a cut sized for a little more than k go on to the sort. No other column is touched:
what the sample needs of a row (its page) is fetched by a semi join.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_bytes


def drawn_seed(seed: str | None) -> str:
    """``seed``, or one drawn at random."""
    return uuid.uuid4().hex if seed is None else seed


def _rank(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)))


def bottom_k(rows: DataFrame, k: int, seed: str | None = None, id_col: str = "id") -> DataFrame:
    """(``id_col``, sample_seed) of the ``k`` ids of smallest rank (all, if fewer); null ids take no part.

    Repeated ids are one. Without ``seed`` one is drawn; ``sample_seed`` records it.
    The result is written once (k rows)."""
    from ..session import cut_lineage
    seed = drawn_seed(seed)
    ids = rows.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    ranked = ids.select(id_col, _rank(id_col, seed).alias("_rank"))
    ranked = cut_lineage(ranked)
    n, few = ranked.count(), ranked
    want = k + 6 * math.sqrt(k) + 20
    while n > want:
        # the first 13 hex digits as a number in [0, 1)
        cut = F.lit(format(min(int(16 ** 13 * want / n), 16 ** 13 - 1), "013x"))
        few = ranked.where(F.substring("_rank", 1, 13) <= cut)
        if few.count() >= k:
            break
        want *= 2
    else:
        few = ranked
    return cut_lineage(few.orderBy("_rank", id_col).limit(k).select(id_col, F.lit(seed).alias("sample_seed")))


def fetch(rows: DataFrame, sample: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of the sampled ids, with the seed; ``rows`` is not shuffled while the sample's bytes are few."""
    return rows.join(broadcast_if_bytes(sample), id_col)
