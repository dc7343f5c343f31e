"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and the trigrams of its character classes (lower
case, capitals, digits, blanks, line ends, each mark for itself), hashed to DIMS
places, and one place for words that repeat the word before. Weights are
log(1 + count) times the idf of all documents, of length 1. Labelled texts span the
latent space: randomised subspace iteration finds the strongest right singular
directions of their matrix; the first one, which all texts share, is left out.
Every document is projected and compared with every labelled vector in blocks; the
NEIGHBOURS most similar ones (and all that tie with the last) vote for their labels
with their cosines as weights. The score is the share of label 1 in the vote.

Scores depend on texts alone, and labels only on rows outside the fold
crc32(doc_id as text) mod 4 = 2.

Bounds: MAX_LABELLED labelled texts at most are kept, chosen by hash (a documented
sample of labelled rows); their vectors (32 floats each, 1 MB) are broadcast. Document
frequencies cover all documents. The driver holds DIMS frequencies, the basis
(DIMS x 32), SAMPLE_PARTS partial products a round and the labelled vectors.

Defined cases: null and empty texts, and texts similar to no labelled one, score
the labelled texts' mean label (0.5 without any); several labels of a document
count as their mean, null labels not at all; a null doc_id is not held out and has
no label; repeated rows are scored alike; a text counts in pieces of PIECE bytes at
most, cut behind white space where there is one, all of which count; an empty table
gives an empty result.

Scale: two passes over the texts, no shuffle of text; the sample's ids are
broadcast to find their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.hashing import mix, span_hashes
from gazette.llm.util import free_name, load, python_column, small_batches, unit_hash, written

DIMS, SHAPES = 4096, 2048
MAX_LABELLED, NEIGHBOURS, DIRECTIONS = 8192, 15, 32
#: Subspace iteration: spare directions, rounds, partial products a round.
SPARE, ROUNDS, SAMPLE_PARTS = 16, 4, 8
#: Texts, and bytes of text, worked on at once.
BLOCK, PIECE = 256, 1 << 22
#: The fold that labels are never taken from, and the score of a good text (fixed values).
FOLDS, HELD_OUT, GOOD = 4, 2, 0.7


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint64) + np.uint64(16)  # marks stand for themselves
    out[ord("a"):ord("z") + 1] = out[128:] = 1
    out[ord("A"):ord("Z") + 1], out[ord("0"):ord("9") + 1], out[:32] = 2, 3, 5
    out[[ord(" "), ord("\t")]] = 4
    return out


_CLASS = _classes()


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, bytes]]:
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        while len(raw) > PIECE:
            cut = max(raw.rfind(b" ", 0, PIECE), raw.rfind(b"\n", 0, PIECE)) + 1 or PIECE
            yield i, raw[:cut]
            raw = raw[cut:]
        yield i, raw


def _add(out: np.ndarray, pieces: list[tuple[int, bytes]]) -> None:
    end = b"\n\n"
    sizes = np.array([len(p) + len(end) for _, p in pieces])
    raw = np.frombuffer(end.join(p for _, p in pieces) + end, np.uint8)
    at = np.repeat(np.arange(len(pieces)), sizes)  # the piece of each byte
    text = np.array([i for i, _ in pieces])
    k = _CLASS[raw]
    shape = mix((k[:-2] << np.uint64(18)) | (k[1:-1] << np.uint64(9)) | k[2:]) % np.uint64(SHAPES)
    inside = at[:-2] == at[2:]
    blank = np.concatenate(([True], (k == 4) | (k == 5), [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edges[::2], edges[1::2]
    word = span_hashes(raw, first, last)
    again = np.flatnonzero((word[1:] == word[:-1]) & (at[first[1:]] == at[first[:-1]])) + 1
    places = [(text[at[:-2][inside]], shape[inside].astype(np.int64)),
              (text[at[first]], (SHAPES + word % np.uint64(DIMS - SHAPES - 1)).astype(np.int64)),
              (text[at[first[again]]], np.full(len(again), DIMS - 1))]
    for row, place in places:
        out += np.bincount(row * DIMS + place, minlength=out.size).reshape(out.shape)


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the terms of each text (rows by DIMS)."""
    out = np.zeros((len(texts), DIMS), np.float32)
    held, size = [], 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1])
        if size >= PIECE:
            _add(out, held)
            held, size = [], 0
    if held:
        _add(out, held)
    return out


def weights(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of each text, of length 1 (or 0 without terms)."""
    w = np.log1p(term_counts(texts)) * idf
    return w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)


def _blocks(texts: list) -> Iterator[list]:
    for i in range(0, len(texts), BLOCK):
        yield texts[i:i + BLOCK]


def inverse_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """idf of every place over all documents."""
    def count(batches):
        n, seen = 0, np.zeros(DIMS, np.int64)
        for b in batches:
            for part in _blocks(b.column(0).to_pylist()):
                n += len(part)
                seen += (term_counts(part) > 0).sum(axis=0)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMS), pa.int64()), pa.array(np.append(seen[at], n), pa.int64())], names=["place", "df"])

    small_batches(docs.sparkSession)
    counted = docs.select(F.col(text)).mapInArrow(count, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))
    df = np.zeros(DIMS + 1)
    for r in counted.collect():  # DIMS + 1 rows at most
        df[r["place"]] = r["df"]
    return (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)


def _cut(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """`rows` if they are `most` at most, else those whose hash of `key` is small enough."""
    n, share = rows.count(), 1.0
    while n > most:
        share *= 0.95 * most / n
        rows = rows.where(unit_hash(*[F.col(c) for c in key]) < share)
        n = rows.count()
    return rows


def labelled_texts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                   most: int = MAX_LABELLED) -> DataFrame:
    """(id, text, label) of `most` labelled documents at most, none of the held-out fold; written once."""
    known = labels.where(F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    known = _cut(written(known.where("label is not null"), "labels"), ["id"], most)
    # `most` rows at most: broadcast
    found = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    found = found.withColumn("h", F.sha2("text", 256))
    # a doc_id may have several texts
    return _cut(written(found.dropDuplicates(["id", "h"]), "labelled"), ["id", "h"], most).select("id", "text", "label")


def held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    rows, places, values = batch.column("row").to_pylist(), batch.column("places"), batch.column("values")
    out = np.zeros((len(rows), DIMS), np.float32)
    n = np.diff(places.offsets.to_numpy())
    out[np.repeat(np.arange(len(rows)), n), places.flatten().to_numpy()] = values.flatten().to_numpy()
    return out


class Model:
    """idf, latent basis, and the labelled vectors with their labels: plain arrays, a few MB."""

    def __init__(self, idf, basis, vectors, labels):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels
        self.base = float(labels.mean()) if len(labels) else 0.5

    def scores(self, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(texts), self.base)
        m = len(self.labels)
        if m:
            k = min(neighbours, m)
            for i, part in zip(range(0, len(texts), BLOCK), _blocks(texts)):
                cos = _unit(weights(part, self.idf) @ self.basis) @ self.vectors.T
                last = np.partition(cos, m - k, axis=1)[:, m - k, None]
                vote = np.where(cos >= last - 1e-6, np.maximum(cos, 0), 0).astype(np.float64)
                total = vote.sum(axis=1)
                out[i:i + len(part)] = np.where(total > 0, vote @ self.labels / np.maximum(total, 1e-300), self.base)
        return np.clip(out, 0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 1e-6, x / np.maximum(n, 1e-6), 0).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> Model:
    """The classifier of `docs`, from their frequencies and at most `most` labelled texts."""
    idf = inverse_frequencies(docs, text)

    def sparse(batches):
        for b in batches:
            for i, part in zip(range(0, b.num_rows, BLOCK), _blocks(b.column(0).to_pylist())):
                w = weights(part, idf)
                row, place = np.nonzero(w)
                at = pa.array(np.searchsorted(row, np.arange(len(part) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    b.column(1).slice(i, len(part)).cast(pa.float64()), pa.ListArray.from_arrays(at, pa.array(place, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(w[row, place], pa.float32()))], names=["row", "places", "values"])

    sample = labelled_texts(docs, labels, doc_id, text, label, most).repartition(SAMPLE_PARTS, "id").select("text", "label")
    rows = written(sample.mapInArrow(sparse, "row double, places array<int>, values array<float>"), "weights")

    def product(q):
        """A'Aq, A being the labelled texts' matrix: one partial product from each of a few tasks."""
        def part(batches):
            out = np.zeros_like(q)
            for b in batches:
                a = _matrix(b)
                out += a.T @ (a @ q)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["p"])

        return sum(np.frombuffer(r["p"], q.dtype).reshape(q.shape) for r in rows.coalesce(SAMPLE_PARTS).mapInArrow(part, "p binary").collect())

    q = np.linalg.qr(np.random.default_rng(0).standard_normal((DIMS, DIRECTIONS + 1 + SPARE)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        p = product(q)
        if not np.any(p):
            return Model(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
        q = np.linalg.qr(p)[0].astype(np.float32)
    gram = q.T @ product(q)
    strength, turn = np.linalg.eigh((gram + gram.T).astype(np.float64) / 2)
    order = np.argsort(-strength)[1:DIRECTIONS + 1]
    basis = (q @ turn[:, order]).astype(np.float32)

    def project(batches):
        for b in batches:
            z = _unit(_matrix(b) @ basis)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([v.tobytes() for v in z], pa.binary())], names=["label", "z"])

    got = rows.mapInArrow(project, "label double, z binary").collect()  # `most` rows at most
    got.sort(key=lambda r: (r["z"], r["label"]))
    return Model(idf, basis, np.array([np.frombuffer(r["z"], np.float32) for r in got]).reshape(-1, basis.shape[1]), np.array([r["label"] for r in got]))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "quality_score") -> tuple[DataFrame, str]:
    """`docs` with a struct (score, predicted), and that column's name. The model travels with the task's function (Spark broadcasts it)."""
    name = free_name(docs, name)
    def judge(b):
        score = np.round(model.scores(b.column(0).to_pylist()), 6)
        return {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= GOOD).astype(np.int32), pa.int32())}

    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return python_column(docs, [text], name, fields, judge), name


def op12_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the score of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out, c = scored(docs, fit(docs, load(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), f"{c}.score", f"{c}.predicted")
