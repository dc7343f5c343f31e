"""Duplicate-content report: the first item per checksum is canonical, later
ones are reported against it, with totals of duplicates and bytes.

The text is read and hashed once, into a written table of (doc_id, checksum,
bytes). The canonical id is a grouped ``min`` (partial aggregation before the
shuffle), joined back on the checksum for those that occur twice at least; a
checksum shared by a third of all rows is a skewed join key on the streamed
side only, which AQE's skew-join handling splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, canonical_id, bytes) for every non-canonical copy."""
    from ..session import cut_lineage
    d = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col)).alias("checksum"),
                                F.octet_length(F.col(text_col)).alias("bytes")))
    canon = d.groupBy("checksum").agg(F.min("doc_id").alias("canonical_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return (d.join(canon, "checksum").filter(F.col("doc_id") != F.col("canonical_id"))
            .select("doc_id", "canonical_id", F.col("bytes").cast("long").alias("bytes")))


def duplicate_totals(dups: DataFrame) -> DataFrame:
    return dups.agg(F.count(F.lit(1)).alias("n_duplicates"),
                    F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("duplicate_bytes"))
