"""12 h similarity as a native stream-stream interval join, with a side path for late articles.

Two copies of the article stream are joined on a shared prefix token and the
12 h range of their times, under a watermark, so Spark drops state as time goes on.
A pair counts for the later article (by time, then id) if the earlier one had arrived
by then, as a service that scores each article when it comes would count.

The join drops articles older than its watermark. They are scored beside it: a
second query over the same files finds every article more than ``late_hours`` older
than the newest one before it in arrival, scores it against the articles landed
so far, and scores each batch against the late articles known. Both may find a
pair, so pairs are made distinct when they are read; ``late_hours`` decides how many
articles go which way, not the result.

Both sides are keyed by token and time bucket (a bucket is as long as the window; the
earlier article stands in its own and the next), so an article meets the articles of
its token in two windows, not all that the state or the late table holds. A
batch pays some seconds of task time for each state partition, whatever it brings, so
there are STATE_PARTITIONS per core at most: the state is one window of articles.

The side path joins tables. Their files are small beside their keyed rows (a title is written once and
compressed, keyed it is a row per token and bucket with all its words), so a side is broadcast by what
those rows hold, never by its files; otherwise both are shuffled.

Prefix tokens are taken in the order of their hash, which needs no statistics; a
token of most titles is as likely a key as a rare one, so titles of one common word
and bucket meet in one place (the batch operator orders by frequency and tiles hot tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.fixed import SIMILARITY_THRESHOLD, SIMILARITY_WINDOW_HOURS
from ..functions.urls import url_host
from ..operators.common import byte_size
from ..operators.similarity import jaccard, wordset_in_batches
from ..sources.snapshots import latest, subfolders, write_version

#: State partitions per core, at most; the session's shuffle partitions, if fewer.
STATE_PARTITIONS = 2

ROWS = "id long, ct timestamp, site string, words array<string>, arrived long"


def _rows(articles: DataFrame, arrived: Column) -> DataFrame:
    """Articles as (id, ct, site, words, arrived); those without words score 0 and take no part in the joins."""
    # exploded from one element, so that filters on the words do not annotate the titles again
    return articles.select("id", F.col("create_time").alias("ct"), url_host(F.col("uri")).alias("site"),
                           F.explode(F.array(wordset_in_batches(F.col("title")))).alias("words"), arrived.cast("long").alias("arrived"))


def _prefix_size(threshold: float) -> Column:
    n = F.size("words")
    return (n - F.floor(F.lit(threshold) * n - F.lit(1e-9))).cast("int")


def _keyed(rows: DataFrame, threshold: float, side: str, hours: int) -> DataFrame:
    """One row per prefix token (side b: and for two buckets), columns named after the side."""
    hashed = F.array_sort(F.transform("words", lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w"))))
    n = F.size("words")
    prefix = F.transform(F.slice(hashed, F.lit(1), _prefix_size(threshold)), lambda s: s["w"])
    keyed = rows.where(n > 0).withColumn("prefix", prefix)
    out = keyed.select(*[F.col(c).alias(f"{side}_{c}") for c in keyed.columns], F.explode("prefix").alias(f"{side}_token"))
    bucket = F.floor(F.unix_seconds(f"{side}_ct") / (max(int(hours), 1) * 3600))
    return out.withColumn(f"{side}_bucket", bucket if side == "a" else F.explode(F.array(bucket, bucket + 1)))


def _keyed_bytes(threshold: float, side: str) -> Column:
    """Bytes that an article's keyed rows hold in memory, at most."""
    n = F.size("words")
    # words, their prefix and the token: 8 for its place and 7 of padding at most for each string
    words = 3 * (16 * n + F.octet_length(F.array_join("words", "")))
    row = F.lit(136) + F.coalesce(F.octet_length("site"), F.lit(0)) + words
    return F.when(n > 0, row.cast("long") * _prefix_size(threshold) * (1 if side == "a" else 2)).otherwise(0)


def _pairs(later: DataFrame, earlier: DataFrame, threshold: float, hours: int) -> DataFrame:
    """(id, other_id, score) of keyed sides a and b; works on streams and tables."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    joined = later.join(earlier, (a("token") == b("token")) & (a("bucket") == b("bucket")) & (b("ct") > a("ct") - F.expr(f"INTERVAL {int(hours)} HOURS")) & (b("ct") <= a("ct")))
    order = (b("ct") < a("ct")) | (b("id") < a("id"))
    first = F.element_at(F.array_intersect(a("prefix"), b("prefix")), 1) == a("token")
    score = jaccard(a("words"), b("words"))
    return joined.where(order & first & (b("arrived") <= a("arrived")) & ~b("site").eqNullSafe(a("site")) & (score > threshold)) \
        .select(a("id").alias("id"), b("id").alias("other_id"), score.alias("score"))


class IntervalSimilarity:
    """The two queries over a folder of landing articles (id, create_time, title, uri, ...) and the reader of their result.

    ``arrived`` orders arrivals; by default it is the time of the file. The result
    folder ``out`` holds pairs, late pairs, landed rows and checkpoints."""

    def __init__(self, spark: SparkSession, articles_dir: str, schema, out: str, threshold: float = SIMILARITY_THRESHOLD,
                 window_hours: int = SIMILARITY_WINDOW_HOURS, late_hours: int = SIMILARITY_WINDOW_HOURS, arrived: Column | None = None,
                 files_per_batch: int | None = None):
        self.spark, self.dir, self.schema, self.out = spark, articles_dir, schema, out.rstrip("/")
        self.threshold, self.hours, self.late_hours = threshold, window_hours, late_hours
        self.arrived = F.unix_micros(F.col("_metadata.file_modification_time")) if arrived is None else arrived
        self.files = files_per_batch

    def _stream(self) -> DataFrame:
        reader = self.spark.readStream.schema(self.schema).format("parquet")
        if self.files:
            reader = reader.option("maxFilesPerTrigger", self.files)
        return _rows(reader.load(self.dir), self.arrived)

    def start(self, available_now: bool = True, period: str = "60 seconds") -> list[StreamingQuery]:
        """Starts the join and the side path."""
        side = lambda s: _keyed(self._stream().withWatermark("ct", f"{self.late_hours} hours"), self.threshold, s, self.hours)
        join = _pairs(side("a"), side("b"), self.threshold, self.hours).writeStream.format("parquet").outputMode("append") \
            .option("path", f"{self.out}/pairs").option("checkpointLocation", f"{self.out}/checkpoint/join")
        late = self._stream().writeStream.foreachBatch(self._late_batch).option("checkpointLocation", f"{self.out}/checkpoint/late")
        once = (lambda w: w.trigger(availableNow=True)) if available_now else (lambda w: w.trigger(processingTime=period))
        # a query keeps the number it first started with
        key, conf = "spark.sql.shuffle.partitions", self.spark.conf
        session = conf.get(key)
        conf.set(key, str(min(int(session), STATE_PARTITIONS * self.spark.sparkContext.defaultParallelism)))
        try:
            joined = once(join).start()
        finally:
            conf.set(key, session)
        return [joined, once(late).start()]

    def _read(self, name: str, upto: int) -> DataFrame:
        folders = [f"{self.out}/{name}/batch={n}" for n in subfolders(self.spark, f"{self.out}/{name}", "batch=") if n <= upto]
        return self.spark.read.schema(ROWS).parquet(*folders) if folders else self.spark.createDataFrame([], ROWS)

    def _fits(self, rows: DataFrame, side: str) -> bool:
        """True if the keyed rows hold no more than the session broadcasts (one aggregation)."""
        held = rows.agg(F.sum(_keyed_bytes(self.threshold, side))).first()[0] or 0
        return held <= byte_size(self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))

    def _table_pairs(self, later: DataFrame, earlier: DataFrame) -> DataFrame:
        """``_pairs`` of two written tables: the first side that fits is broadcast, or both are shuffled."""
        a, b = _keyed(later, self.threshold, "a", self.hours), _keyed(earlier, self.threshold, "b", self.hours)
        if self._fits(later, "a"):
            a = F.broadcast(a)
        elif self._fits(earlier, "b"):
            b = F.broadcast(b)
        else:
            a = a.hint("merge")
        return _pairs(a, b, self.threshold, self.hours)

    def _late_batch(self, batch: DataFrame, epoch: int) -> None:
        """Lands the batch, and scores what the join may have dropped. A replay writes the same folders again."""
        batch.write.mode("overwrite").parquet(f"{self.out}/landed/batch={epoch}")
        new = self.spark.read.schema(ROWS).parquet(f"{self.out}/landed/batch={epoch}")
        newest = latest(self.spark, f"{self.out}/newest", at_most=epoch)
        before = newest.first()["ct"] if newest is not None else None
        # the newest article up to each arrival of this batch: a row per landed file at most
        arrivals = new.groupBy("arrived").agg(F.max("ct").alias("ct"))
        top = arrivals.select("arrived", F.greatest(F.max("ct").over(Window.orderBy("arrived")), F.lit(before).cast("timestamp")).alias("top"))
        late = new.join(F.broadcast(top), "arrived").where(F.col("ct") <= F.col("top") - F.expr(f"INTERVAL {self.late_hours} HOURS")).drop("top")
        late.select(new.columns).write.mode("overwrite").parquet(f"{self.out}/late/batch={epoch}")
        late = self.spark.read.schema(ROWS).parquet(f"{self.out}/late/batch={epoch}")
        known_late = self._read("late", epoch)
        pairs = self._table_pairs(new, known_late)
        span = late.agg(F.min("ct"), F.max("ct")).first()
        if span[0] is not None:
            near = self._read("landed", epoch).where((F.col("ct") > F.lit(span[0]) - F.expr(f"INTERVAL {self.hours} HOURS")) & (F.col("ct") <= F.lit(span[1])))
            pairs = pairs.unionByName(self._table_pairs(late, near))
        pairs.write.mode("overwrite").parquet(f"{self.out}/late_pairs/batch={epoch}")
        write_version(arrivals.agg(F.greatest(F.max("ct"), F.lit(before).cast("timestamp")).alias("ct")), f"{self.out}/newest", epoch + 1)

    def pairs(self) -> DataFrame:
        """Distinct (id, other_id, score) so far."""
        late = [f"{self.out}/late_pairs/batch={n}" for n in subfolders(self.spark, f"{self.out}/late_pairs", "batch=")]
        schema = "id long, other_id long, score double"
        found = self.spark.read.schema(schema).parquet(f"{self.out}/pairs")
        if late:
            found = found.unionByName(self.spark.read.schema(schema).parquet(*late))
        return found.dropDuplicates(["id", "other_id"])

    def importance(self) -> DataFrame:
        """(id, importance) of all articles landed so far."""
        counts = self.pairs().groupBy("id").agg(F.count(F.lit(1)).alias("importance"))
        landed = self._read("landed", 1 << 60).select("id").distinct()
        return landed.join(counts, "id", "left").select("id", F.coalesce("importance", F.lit(0)).cast("long").alias("importance"))
