"""Lexical retrieval packing: documents that share rare words share a training window.

1. Every text becomes ids with an end id (``token_files.token_table``). Whole
   windows of a long document are sequences of their own; what is left of each
   document (its tail, under a window) is packed.
2. Document frequencies of ids are counted over all tails. A tail's route is its
   id of highest tf * idf among ids that another tail holds too.
3. Routes are laid end to end by size and cut into shards of SHARD_TOKENS; a
   document's place within its route is a hash of its doc_id. So similar tails
   meet in a shard, and a route that holds a third of all rows spreads over as
   many shards as it needs.
4. Each shard builds a BM25 inverted index (corpus-wide idf and mean length) and
   takes seeds in turn: the index returns the seed's unused neighbours by score,
   which fill its window greedily; the last one is cut to fit and what is left of
   it is the next seed. Only a shard's last window can be short.

Scale: one shuffle of the tails by shard, each group bounded by SHARD_TOKENS in
the mean. The two tables that reach the driver have one row per vocabulary id
(49,408 at most), whatever the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.token_files import id_counts, token_table
from gazette.llm.util import load, unit_hash, written

WINDOW, END_ID = 2048, 1
#: Tokens of a shard, in the mean: 256 windows.
SHARD_TOKENS = 256 * WINDOW
#: BM25's usual constants.
K1, B = 1.2, 0.75
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split(" ")[0] for f in _PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows) if rows else [[]] * 7, _KINDS)], names=names)


def _wide(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


class Shard:
    """BM25 index of a shard's tails; postings in numpy, grouped by id. Used tails' postings go when they are half."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        terms = [np.unique(t, return_counts=True) for t in tails]
        n = [len(t) for t, _ in terms]
        doc = np.repeat(np.arange(len(tails)), n)
        term, tf = np.concatenate([t for t, _ in terms]), np.concatenate([c for _, c in terms])
        norm = K1 * (1 - B + B * np.array([len(t) for t in tails]) / mean)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        order = np.argsort(term, kind="stable")
        self.term, self.doc, self.weight = term[order], doc[order], weight[order]
        self.terms, self.size, self.ids = [t.tolist() for t, _ in terms], len(tails), len(idf)
        self.live = len(tails)
        self._ends()

    def _ends(self) -> None:
        self.end = np.concatenate(([0], np.cumsum(np.bincount(self.term, minlength=self.ids)))).tolist()

    def keep(self, alive: np.ndarray) -> None:
        """Drop the postings of used tails, if half of those indexed are used."""
        if 2 * (n := int(alive.sum())) < self.live:
            held = alive[self.doc]
            self.term, self.doc, self.weight, self.live = self.term[held], self.doc[held], self.weight[held], n
            self._ends()

    def scores(self, i: int) -> np.ndarray:
        """BM25 score of every tail for the words of tail i."""
        spans = [(self.end[t], self.end[t + 1]) for t in self.terms[i]]
        return np.bincount(np.concatenate([self.doc[a:b] for a, b in spans]),
                           np.concatenate([self.weight[a:b] for a, b in spans]), self.size)


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows of (tail, from, to) pieces. Every id of every tail lies in one piece."""
    index = Shard(tails, idf, mean)
    length = np.array([len(t) for t in tails])
    used, alive = np.zeros(len(tails), np.int64), np.ones(len(tails), bool)
    out, cursor, seed = [], 0, -1
    while True:
        if seed < 0:
            while cursor < len(tails) and not alive[cursor]:
                cursor += 1
            if cursor == len(tails):
                return out
            seed = cursor
        pieces, space, nxt = [(seed, int(used[seed]), int(length[seed]))], window - int(length[seed] - used[seed]), -1
        alive[seed] = False
        if space and alive.any():
            index.keep(alive)
            score = np.where(alive, index.scores(seed), -1.0)
            few = 4 * (1 + space // max(1, int(mean)))
            ranked = np.argpartition(-score, few)[:few] if few < len(score) else np.arange(len(score))
            ranked = ranked[np.lexsort((ranked, -score[ranked]))]
            left = length - used
            if left[ranked[alive[ranked]]].sum() < space:
                ranked = np.argsort(-score, kind="stable")
            for i in ranked.tolist():
                if not alive[i]:
                    break
                take = min(space, int(left[i]))
                pieces.append((i, int(used[i]), int(used[i]) + take))
                space -= take
                if take == left[i]:
                    alive[i] = False
                else:
                    used[i] += take
                    nxt = i
                if not space:
                    break
        out.append(pieces)
        seed = nxt


def pack(docs: DataFrame, path: str, kind: str = "word", end_id: int = END_ID, window: int = WINDOW,
         shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    `docs` has doc_id and text (null: empty, which leaves the end id). ids are
    little-endian u32. Rows that repeat a doc_id are packed apart, each from
    start 0. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    tokens = token_table(docs, path, kind, end_id)

    def windows(batches):
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = []
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                for a in range(0, len(ids) - window + 1, window):
                    rows.append((d, a, window, _wide(ids[a:a + window]), len(ids), (task << 32) | k, 0))
                    k += 1
            yield _batch(rows)

    whole = tokens.where(F.col("n") >= window).select("doc_id", "ids").mapInArrow(windows, _PIECES)

    cut = F.col("n") - F.col("n") % window
    tails = tokens.where(F.col("n") % window > 0).select(
        "doc_id", cut.alias("start"), F.col("n").alias("doc_tokens"),
        F.substring("ids", (2 * cut + 1).cast("int"), 2 * window).alias("ids"))
    df = id_counts(tails, per_document=True)
    total = tails.agg(F.count("*").alias("n"), F.sum(F.length("ids") / 2).alias("ids")).first()
    n, mean = total["n"], float(total["ids"] or 0) / max(1, total["n"])
    idf = np.log1p((n - df + 0.5) / (df + 0.5))

    def routes(batches):
        for b in batches:
            route = []
            for x in b.column(3):
                t, tf = np.unique(np.frombuffer(x.as_buffer(), "<u2"), return_counts=True)
                route.append(int(t[np.argmax(np.where(df[t] > 1, tf * idf[t], -1.0))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route, pa.int64())], names=[*b.schema.names, "route"])

    routed = written(tails.mapInArrow(routes, "doc_id long, start long, doc_tokens long, ids binary, route long"), "tails")
    sizes = routed.groupBy("route").agg((F.sum(F.length("ids")) / 2).alias("size")).orderBy("route").collect()
    at, plan = 0.0, []
    for r in sizes:
        plan.append((r["route"], at, r["size"]))
        at += r["size"]
    # one row per vocabulary id at most, so small enough to send to every task
    places = F.broadcast(spark.createDataFrame(plan, "route long, at double, size double"))
    place = F.col("at") + unit_hash(F.col("doc_id"), F.crc32("ids")) * F.col("size")
    sharded = routed.join(places, "route").select(
        F.floor(place / shard_tokens).alias("shard"), "doc_id", "start", "doc_tokens", "ids")

    def shards(key, table):
        shard = key[0].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))),
                      key=lambda r: (r[0] is None, r[0] or 0, r[3]))
        tails_ = [np.frombuffer(r[3], "<u2") for r in rows]
        out = []
        for k, pieces in enumerate(pack_shard(tails_, idf, mean, window)):
            offset = 0
            for i, a, z in pieces:
                out.append((rows[i][0], rows[i][1] + a, z - a, _wide(tails_[i][a:z]), rows[i][2], (1 << 62) | (shard << 24) | k, offset))
                offset += z - a
        return pa.Table.from_batches([_batch(out)])

    return whole.unionByName(sharded.groupBy("shard").applyInArrow(shards, _PIECES))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the pieces of all documents with the checksum of their ids."""
    import public_tokenizers
    pieces = pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
