"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with SQL functions only.

Each source gets a target share of the words; targets stop at `max_epochs`
times their source's size, and what is over is shared out anew by weight (the
water level is found in closed form from the sources sorted by where they
fill up). A source is taken whole as many times as its target holds it; the
remaining budget is drawn without replacement: every document has the key
-ln(u) / weight with u from a hash of its doc_id and a weight from its quality
(in the query and the pipeline that of the table `labels`, by doc_id), keys are sorted within the source, and sizes are summed along them up to the budget. The document on the
border is taken if that comes nearer, so a source misses its target by half a
document at most.

Defined cases: null or empty text has size 0; null sources come last; rows that
repeat a doc_id share a key and are taken or left together; a null quality is
neutral, and so is a missing label; an empty table gives an empty result. Reruns
agree.

Scale: the text is read once for sizes. Sorting a source that holds a third of
all rows would need one task, so keys are first cut into BUCKETS ranges: sums by
(source, range) combine on the map side, and only the range on the border is
sorted. Each source then has one cut (a key and doc_id), and every document
decides for itself by a join with the plan, one row per source: the plans of up
to HOT sources are broadcast, so no document of a frequent source is shuffled,
and beyond that number the small sources' documents join theirs by a shuffle. Labels
meet the slim rows (doc_id, source, size); with them, texts are shuffled once, to
meet (doc_id, source, times), and are not sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.util import WORD, free_name, load, unit_hash, written

#: Weights of the sources in code point order, repeating; most epochs of a source (fixed values).
WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
#: Ranges of the key, by 1 - exp(-key), which spreads keys of quality 1 evenly.
BUCKETS = 4096
#: Sources whose plan is sent to every task, at most.
HOT = 10_000
#: Characters of a usual word and the space after it.
USUAL = 6


def word_length_quality(text: str = "text") -> Column:
    """1 for texts of USUAL characters a word (white space included), falling to 0 at none and at twice as many."""
    size = F.regexp_count(text, F.lit(WORD))
    return F.when(size > 0, F.greatest(1 - F.abs(F.length(text) / size - USUAL) / USUAL, F.lit(0.0)))


def words(text: str = "text") -> Column:
    """The size of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, bucket) of `docs`, with quality from labels (doc_id, quality 0 to 1), averaged if repeated."""
    slim = written(docs.select("doc_id", "source", words().alias("size")), "mix-sizes").alias("s")
    mean = labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality")).alias("q")
    slim = slim.join(mean, F.col("s.doc_id") == F.col("q.doc_id"), "left").select("s.*", "quality")
    return keyed(slim, F.col("quality"), size=F.col("size")).select("mix.*")


def keyed(docs: DataFrame, quality: Column | None = None, doc_id: str = "doc_id", source: str = "source",
          text: str = "text", name: str = "mix", size: Column | None = None) -> DataFrame:
    """`docs` with a struct (doc_id, source, size, key, bucket). quality: 0 to 1, by default of word_length_quality.

    Quality 1 makes a document four times as likely as quality 0; null counts as 1/3.
    With both quality and size given, the text is not needed.
    """
    weight = F.coalesce(0.5 + 1.5 * (word_length_quality(text) if quality is None else quality), F.lit(1.0))
    key = -F.log(unit_hash(F.col(doc_id))) / weight
    bucket = F.least(F.floor((1 - F.exp(-key)) * BUCKETS), F.lit(BUCKETS - 1))
    size = words(text) if size is None else size
    return docs.withColumn(name, F.struct(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
                                          key.alias("key"), bucket.alias("bucket")))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size). One row per source of the mixture."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("n", F.row_number().over(order)) \
        .withColumn("weight", F.element_at(given, (F.col("n") - 1) % len(weights) + 1)) \
        .withColumn("most", (F.col("source_size") * max_epochs).cast("double"))
    by_level, everyone = Window.orderBy(F.col("most") / F.col("weight"), "n"), Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) \
        / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("rank", F.row_number().over(by_level))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    s = s.withColumn("level", F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("rank"))).over(everyone))
    return s.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def plan(slim: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs, and the cut (range, key, doc_id) of the last epoch."""
    t = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    size = F.col("source_size")
    t = t.withColumn("epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)) \
        .withColumn("rest", F.col("target") - F.col("epochs") * size)
    t = written(t, "mix-targets")

    along = Window.partitionBy("source").orderBy("bucket")
    ranges = slim.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(along)).alias("r")
    # the first range whose sum reaches the budget
    border = ranges.join(t.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.upto") >= F.col("t.rest"))) \
        .groupBy(F.col("t.source").alias("source"), F.col("t.rest").alias("rest")) \
        .agg(F.min(F.struct("r.bucket", (F.col("r.upto") - F.col("r.n")).alias("before"))).alias("b")).alias("b")
    inside = slim.alias("d").join(border, F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.b.bucket"))) \
        .select("d.source", "d.doc_id", "d.key", "d.size", "b.rest", F.col("b.b.before").alias("before"))
    place = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(place)
    cut = inside.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest")) \
        .groupBy("source").agg(F.max(F.struct("key", "doc_id")).alias("cut")).alias("c")
    t = t.alias("t")
    return t.join(border, F.col("t.source").eqNullSafe(F.col("b.source")), "left") \
        .join(cut, F.col("t.source").eqNullSafe(F.col("c.source")), "left") \
        .select("t.source", "t.source_size", "t.target", "t.epochs", F.col("b.b.bucket").alias("border"), F.col("c.cut").alias("cut"))


def taken(rows: DataFrame, mix: str, plan_: DataFrame, name: str = "plan") -> DataFrame:
    """`rows` with a struct `name`: the source's plan, and times, how often the mix takes the document.

    `plan_` is a written table, for it is read more than once.
    """
    p = plan_.select(F.struct("*").alias(name))
    same = F.col(f"{mix}.source").eqNullSafe(F.col(f"{name}.source"))
    # HOT rows at most: all sources if there are so few, else those that hold a share of 1 / HOT of all words
    n, words = plan_.agg(F.count("*"), F.sum("source_size")).first()
    often = F.lit(True) if n <= HOT else F.col(f"{name}.source_size") * HOT > words
    joined = rows.join(F.broadcast(p.where(often)), same)
    if n > HOT:
        # the others are many and small each: their documents alone are shuffled, by source
        few = p.where(~often)
        joined = joined.unionByName(rows.join(F.broadcast(p.where(often)), same, "left_anti").join(few, same))
    m, q = lambda c: F.col(f"{mix}.{c}"), lambda c: F.col(f"{name}.{c}")
    drawn = F.coalesce((m("bucket") < q("border")) | ((m("bucket") == q("border")) & (F.struct(m("key"), m("doc_id")) <= q("cut"))), F.lit(False))
    return joined.withColumn(name, F.struct(f"{name}.*", (q("epochs") + drawn.cast("long")).alias("times")))


def mixed(docs: DataFrame, quality: Column | None = None, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
          labels: DataFrame | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with.

    labels: (doc_id, quality 0 to 1) instead of `quality`.
    """
    m, p, k = free_name(docs, "mix"), free_name(docs, "plan"), free_name(docs, "copy")
    if labels is not None:
        slim = written(labelled(docs, labels), "mix")
        plan_ = written(plan(slim, weights, max_epochs), "mix-plan")
        # rows of a doc_id and source share a key, so they are taken equally often
        times = taken(slim.select(F.struct("*").alias("mix")), "mix", plan_) \
            .select(F.struct("mix.doc_id", "mix.source", "plan.times").alias(p)).where(F.col(f"{p}.times") > 0).distinct()
        same = F.col("doc_id").eqNullSafe(F.col(f"{p}.doc_id")) & F.col("source").eqNullSafe(F.col(f"{p}.source"))
        out = docs.join(times.hint("shuffle_hash"), same)
        return out.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}.times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
    rows = keyed(docs, quality, name=m)
    plan_ = written(plan(written(rows.select(f"{m}.*"), "mix"), weights, max_epochs), "mix-plan")
    out = taken(rows, m, plan_, p).where(F.col(f"{p}.times") > 0)
    return out.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}.times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: how many words the mix takes of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = written(labelled(docs, load(spark, sf_dir, "labels").select("doc_id", "quality")), "mix")
    rows = taken(slim.select(F.struct("*").alias("mix")), "mix", written(plan(slim), "mix-plan"))
    return rows.select("mix.doc_id", "mix.size", "plan.source_size", "plan.target", (F.col("mix.size") * F.col("plan.times")).alias("taken"))


ORACLE_SQL = rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
v AS (SELECT doc_id, avg(quality)::DOUBLE AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
q AS (SELECT z.*, v.quality FROM z LEFT JOIN v ON v.doc_id = z.doc_id),
d AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '~')), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(16 ** 13)}::DOUBLE)
         / coalesce(0.5::DOUBLE + 1.5::DOUBLE * quality, 1.0::DOUBLE) AS key
  FROM q),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((n - 1) % 3 + 1)::INT] AS weight, ({MAX_EPOCHS} * source_size)::DOUBLE AS most FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY most / weight, n) AS rank,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
t AS (
  SELECT source, source_size, least(most, weight * (SELECT arg_min(level, rank) FROM l WHERE level * weight <= most)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
k AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""
