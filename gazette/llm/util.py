"""Helpers of the llm operators: table access, shared scratch tables, row-wise Python columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.session import scratch_path

#: A word of the contracts: a run of anything but space and \t \n \v \f \r (fixed value).
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch of texts.
BATCH = 1000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once as Parquet in the cluster's shared folder and read back.

    Cuts the lineage: later stages read files that outlive any executor, and
    columns they don't use are not read.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or `name` with underscores appended until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the values alone: 52 bits of an md5 of their text."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))


def small_batches(spark: SparkSession) -> None:
    """At most BATCH rows in an Arrow batch: texts may be long, so few rows bound a worker's memory."""
    conf, key = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))


def python_column(df: DataFrame, inputs: list[str], name: str, fields: T.StructType,
                  fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """`df` with a struct column `name` computed per Arrow batch, all other columns passed through.

    `fn` gets the columns `inputs` as a record batch and returns a list or
    Arrow array for each field.
    """
    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(name, fields)])
    kinds = _arrow(fields)
    at = [df.columns.index(c) for c in inputs]

    def run(batches):
        for b in batches:
            got = fn(pa.RecordBatch.from_arrays([b.column(i) for i in at], names=inputs))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=k.type) for k, x in ((k, got[k.name]) for k in kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(arrays, fields=list(kinds))],
                                             names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def _arrow(fields: T.StructType) -> list[pa.Field]:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(),
             T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}

    def kind(t):
        return pa.list_(kind(t.elementType)) if isinstance(t, T.ArrayType) else kinds[type(t)]

    return [pa.field(f.name, kind(f.dataType)) for f in fields]
