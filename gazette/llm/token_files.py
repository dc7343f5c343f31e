"""Token-ID files: documents as ids, entropy coded with a shared static table.

Format. A folder with two Parquet tables. ``table``: one row (bits, lanes,
freq: an array by id). ``chunks``: one row per chunk of whole documents in
ascending doc_id order: file_no, chunk_no, first_token (ids of the file before
the chunk, the checkpoint from which it can be read alone), doc_ids, lengths
(ids per document) and blocks, an array of rANS blocks (``rans.encode``) of at
most ``rans.BLOCK`` ids, each with a checksum and its own lane states. Blocks
don't depend on each other, so any number of tasks can decode a file. Parquet
carries the bytes because only Spark's own writers reach every cluster store.

Scale. The text is read and encoded once, into a scratch table of 16-bit ids.
Counts are summed per task in numpy, so the shuffle has at most one row per id
and task, and only the table (as many rows as the vocabulary has ids) reaches
the driver. The ids move in one range shuffle on (doc_id, checksum), which also
splits a doc_id that many rows share. A task holds one Arrow batch of texts or
one chunk at a time; one document is the largest unit that must fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm import rans
from gazette.llm.tokens import encoder
from gazette.llm.util import load, small_batches, written
from gazette.session import scratch_path

END_ID = 2


def token_table(docs: DataFrame, path: str, kind: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, n, crc) of every row: 16-bit little-endian ids with `end_id` appended.

    Null or empty text: the end id alone. Rows that repeat a doc_id stay apart.
    Written to the shared folder, since tokenizing costs more than reading.
    """
    end = int(end_id).to_bytes(2, "little")

    def tokens(batches):
        enc = encoder(path, kind)
        for b in batches:
            ids = []
            for a in range(0, b.num_rows, 1024):
                ids += [x + end for x in enc.encode(b.column(1).slice(a, 1024).to_pylist())]
            # the text stays behind: sending it back costs more than the ids
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64())], names=["doc_id", "ids", "n", "crc"])

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([slim.schema["doc_id"], T.StructField("ids", T.BinaryType()),
                           T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])
    return written(slim.mapInArrow(tokens, schema), "tokens")


def id_counts(tokens: DataFrame, per_document: bool = False) -> np.ndarray:
    """Uses of each id, or rows that hold it; as long as the largest id says (at most 65,536)."""
    def count(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            parts = [np.frombuffer(x.as_buffer(), "<u2") for x in b.column(0)]
            parts = [np.unique(p) for p in parts] if per_document else parts
            total += np.bincount(np.concatenate([np.zeros(0, "<u2"), *parts]), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["id", "n"])

    # bounded by the vocabulary: at most one row per id
    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 + max((r["id"] for r in rows), default=0), np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_token_files(docs: DataFrame, path: str, out: str, kind: str = "byte", end_id: int = END_ID) -> str:
    """Encode `docs` (doc_id, text) into the folder `out`; returns `out`. See the module's notes.

    Empty input gives empty tables. Null doc_ids come first.
    """
    spark = docs.sparkSession
    tokens = token_table(docs, path, kind, end_id)
    counts = id_counts(tokens)
    counts[0] += not counts.any()
    freq = rans.Table.scaled(counts)
    spark.createDataFrame([(rans.BITS, rans.LANES, freq.tolist())], "bits int, lanes int, freq array<long>") \
        .coalesce(1).write.parquet(f"{out}/table")

    schema = "file_no long, chunk_no long, first_token long, doc_ids array<long>, lengths array<long>, blocks array<binary>"

    def chunks(batches):
        table, file_no = rans.Table(freq), TaskContext.get().partitionId()
        names = [f.strip().split(" ")[0] for f in schema.split(", ")]
        doc_ids, parts, held, chunk_no, first = [], [], 0, 0, 0

        def chunk():
            ids = np.concatenate(parts)
            blocks = [rans.encode(ids[a:a + rans.BLOCK], table) for a in range(0, len(ids), rans.BLOCK)]
            row = [file_no, chunk_no, first, doc_ids, [len(p) for p in parts], blocks]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)], names=names)

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(x.as_buffer(), "<u2")
                if held and held + len(ids) > rans.BLOCK:
                    yield chunk()
                    first, chunk_no = first + held, chunk_no + 1
                    doc_ids, parts, held = [], [], 0
                doc_ids.append(d)
                parts.append(ids)
                held += len(ids)
        if held:
            yield chunk()

    tokens.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc", "ids") \
        .select("doc_id", "ids").mapInArrow(chunks, schema).write.parquet(f"{out}/chunks")
    return out


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the folder; ids as little-endian u32.

    start: ids of all documents before it. A block that fails its checksum raises.
    """
    freq = np.array(spark.read.parquet(f"{folder}/table").first()["freq"], np.int64)
    chunks = spark.read.schema("file_no long, chunk_no long, first_token long, doc_ids array<long>, lengths array<long>, blocks array<binary>") \
        .parquet(f"{folder}/chunks")

    def documents(batches):
        table = rans.Table(freq)
        for b in batches:
            for row in range(b.num_rows):
                first, doc_ids, lengths, blocks = (b.column(i)[row].as_py() for i in range(4))
                ids = np.concatenate([rans.decode(x, table) for x in blocks]).astype("<u4")
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()),
                    pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array([raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths)], pa.binary()),
                ], names=["doc_id", "start", "n_tokens", "ids"])

    # one row per file, from the checkpoints alone: as many as the writing job had partitions
    files = chunks.groupBy("file_no").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(files.select("file_no", before.alias("before")))
    placed = chunks.join(starts, "file_no").select((F.col("before") + F.col("first_token")).alias("first"), "doc_ids", "lengths", "blocks")
    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, start, n_tokens, ids_crc32 of every document, read back from the files."""
    import public_tokenizers
    folder = scratch_path(spark, "token-files")
    write_token_files(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
