"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become integers floor(256 * x). Rows are dealt into blocks of BLOCK, and
queries into blocks of QUERY_BLOCK; every pair of blocks is one task's work. A
block's index holds, per dimension, its rows in order of value, cut into
segments of equal quantised impact. A query walks all dimensions' segments by
descending impact (its own weight times the segment's level), adding to each
row's score at least what the segment guarantees. Nothing is unknown but by how
much a row may still rise: the sum over dimensions of the weight times the next
segment's upper end. A row whose score plus that sum stays under the k-th
lowest-possible score is proven out; the walk stops when few rows are left or no
segment is, and the rows not proven out are rescored exactly, however many.

Defined cases: a vector that is null, or holds null or a non-finite component,
takes no part, nor does a row without an id; vectors of unequal length are
padded with zeros; rows with the query's vec_id are its own and no candidates;
of several vectors of one query id the smallest, component by component, asks,
and each row of a repeated vec_id is a candidate of its own; ties go to the
smaller vec_id; an empty table gives an empty result. Scores are exact while
they fit 64 bits.

Scale: the stated query set meets all rows block by block, through one shuffle
that copies a row once per query block and a query once per row block. Blocks of
equal size make the copies of both together fewest for what a task holds: one
pair of blocks and one index, built for 16,384 queries. Each pair returns k rows
a query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.util import load, written

BLOCK, QUERY_BLOCK = 16_384, 16_384
#: Segments of a dimension; checks for proof in a walk; rows (as a share of a block) few enough to rescore.
LEVELS, CHECKS, FEW = 64, 16, 1 / 128
SCALE, K, EVERY = 256, 5, 50


class ImpactIndex:
    """Segments of a block of integer vectors (rows by dimensions)."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        self.width = (self.high - self.low) // LEVELS + 1
        level = (x - self.low) // self.width
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        counts = np.zeros((x.shape[1], LEVELS + 1), np.int64)
        for d in range(x.shape[1]):
            counts[d, 1:] = np.bincount(level[:, d], minlength=LEVELS)
        self.at = np.cumsum(counts, axis=1)
        self.n = n

    def top(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best of the block for q; no best row is missing."""
        if self.n <= k:
            return np.arange(self.n)
        dims = np.flatnonzero(q)
        weight = np.abs(q[dims])[:, None].astype(np.float64)
        up = (q[dims] > 0)[:, None]
        width = self.width[dims][:, None].astype(np.float64)
        lev = np.arange(LEVELS)[None, :]
        # impacts count from a dimension's far end, so that none is negative
        reach = (self.high - self.low)[dims][:, None].astype(np.float64)
        least = np.where(up, lev * width, np.maximum(reach - (lev + 1) * width + 1, 0)) * weight
        most = np.where(up, np.minimum((lev + 1) * width - 1, reach), reach - lev * width) * weight
        size = np.diff(self.at[dims], axis=1)
        d, s = np.nonzero(size)
        order = np.argsort(-most[d, s], kind="stable")
        d, s = d[order], s[order]
        gain, total, n = least[d, s], size[d, s], self.n
        a = self.at[dims[d], s]
        done = np.cumsum(total)
        slack = ((width - 1) * weight)[:, 0]
        score = np.zeros(n)
        start = 0
        for c in range(1, CHECKS + 1):
            stop = int(np.searchsorted(done, done[-1] * c / CHECKS)) + 1 if c < CHECKS and len(done) else len(d)
            if stop > start:
                rows = np.concatenate([self.order[i, x:x + m] for i, x, m in zip(dims[d[start:stop]].tolist(), a[start:stop].tolist(), total[start:stop].tolist())])
                score += np.bincount(rows, np.repeat(gain[start:stop], total[start:stop]), n)
                start = stop
            rest = slack.copy()
            np.maximum.at(rest, d[start:], most[d[start:], s[start:]])
            bar = np.partition(score, n - k)[n - k] - rest.sum()
            left = np.flatnonzero(score >= bar - 1e-6 * abs(bar))
            if len(left) <= max(k, n * FEW):
                break
        return left


def _matrix(table: pa.Table, dims: int | None = None) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    dims = max(1, dims or 0, int(n.max(initial=0)))
    out = np.zeros((len(n), dims), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def complete(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double"))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for every row for which `is_query` holds."""
    rows = vectors.where(F.col(vec_id).isNotNull() & complete(F.col(vector))) \
        .select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = written(rows, "vectors")
    n = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0)).alias("q")).first()
    blocks, query_blocks = max(1, math.ceil(n["n"] / BLOCK)), max(1, math.ceil(n["q"] / QUERY_BLOCK))
    # dealt by place in the written table: even blocks, whatever the ids are
    place = F.monotonically_increasing_id()
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = rows.select("id", "v", F.pmod(F.hash(place), F.lit(blocks)).alias("b")).select("id", "v", "b", every(query_blocks).alias("q"))
    asked = rows.where("is_query").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q"))
    asked = asked.select("id", "v", every(blocks).alias("b"), "q")

    names = ["query_id", "vec_id", "score"]

    def pair(key, base_rows, queries):
        parts = []
        if base_rows.num_rows and queries.num_rows:
            x = _matrix(base_rows)
            q = _matrix(queries, x.shape[1])
            index, ids = ImpactIndex(x), base_rows.column("id").to_numpy()
            for qid, v in zip(queries.column("id").to_pylist(), q):
                may = index.top(v[:x.shape[1]], k + 1)  # the query's own row may be one
                may = may[ids[may] != qid] if (ids == qid).sum() <= 1 else np.flatnonzero(ids != qid)
                score = x[may] @ v[:x.shape[1]]
                best = np.lexsort((ids[may], -score))[:k]
                parts.append((np.full(len(best), qid), ids[may][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, cols)})

    found = base.groupBy("b", "q").cogroup(asked.groupBy("b", "q")).applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 5 best rows for every row whose vec_id is divisible by 50."""
    return top_k(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)


ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_prepend(0, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, vec_id, unnest(range(len(e))) AS d, unnest(e) AS x FROM v),
a AS (SELECT vec_id AS query_id, min(e) AS e FROM v WHERE vec_id % {EVERY} = 0 GROUP BY 1),
q AS (SELECT query_id, unnest(range(len(e))) AS d, unnest(e) AS x FROM a),
s AS (
  SELECT query_id, r, vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM q JOIN c ON c.d = q.d AND c.vec_id <> query_id GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= {K}
"""
