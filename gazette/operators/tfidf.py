"""TF-IDF at corpus scale, in long form (never densified).

Fit: distinct (doc, term) pairs -> document frequency per term (one shuffle on
term, with map-side partial counts) -> ``idf = ln((1 + n) / (1 + df)) + 1``
(smooth idf, as the default TfidfVectorizer; MLlib's IDF has no ``+ 1``).
Transform: term counts per (doc, term) -> join the vocabulary -> L2
normalisation per document with a window over the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_bytes
from .sample import bottom_k, fetch

# Default vectorizer tokens: 2+ word characters, lower-cased (Unicode-aware).
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"


def terms_of(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def fit(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        n: int | None = None) -> DataFrame:
    """Vocabulary (term, df, idf) of a corpus of training texts.

    ``n`` (number of documents, empty ones included) is one scalar. When it
    is not given, the training texts (one short string per document) are
    checkpointed first, so counting them does not re-run the text pipeline.
    """
    if n is None:
        from ..session import cut_lineage
        texts = cut_lineage(texts.select(text_col))
        n = texts.count()
    pairs = texts.select(F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term"))
    df = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)


def fit_terms(doc_terms: DataFrame, n: int) -> DataFrame:
    """Vocabulary from (doc_id, term) occurrences of ``n`` training documents
    (documents without terms count in ``n``); same result as ``fit`` on their
    training texts, without rebuilding the texts."""
    df = (doc_terms.select("doc_id", "term").distinct()
          .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return df.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1.0)


def transform(texts: DataFrame, vocab: DataFrame, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(doc_id, term, weight): tf x idf, L2-normalised per document; terms
    outside the vocabulary are ignored. The vocabulary is broadcast only
    if its bytes are few."""
    tf = (texts.select(F.col(id_col).alias("doc_id"), F.explode(terms_of(F.col(text_col))).alias("term"))
          .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    v = vocab.select("term", "idf")
    j = tf.join(broadcast_if_bytes(v), "term")
    w = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy("doc_id")))
    return j.select("doc_id", "term", (w / norm).alias("weight"))


def sample_for_training(articles: DataFrame, n: int | None = None, seed: str | None = "0",
                        status: str = "D") -> DataFrame:
    """All done articles, or ``n`` of them at random: the same ones for the same
    seed, others each time for None (``sample_seed`` records the one drawn)."""
    done = articles.filter(F.col("status") == status)
    return done if n is None else fetch(done, bottom_k(done, n, seed))


def train(articles: DataFrame, model_path: str, n: int | None = None, seed: str | None = "0") -> DataFrame:
    """Train job: all done articles (or a sample of ``n``) -> HTML to text -> annotate -> training text -> fit ->
    save the vocabulary as Parquet at ``model_path``; returns the saved model."""
    from .common import spread
    from .sentences import kept_in_batches, training_text, with_clean_text
    samp = spread(sample_for_training(articles.filter(F.col("html").isNotNull()), n, seed))
    texts = with_clean_text(samp, "_text").select(F.col("id").alias("doc_id"), training_text(kept_in_batches(F.col("_text"))).alias("text"))
    fit(texts).write.mode("overwrite").parquet(model_path)
    return load_model(articles.sparkSession, model_path)


def load_model(spark, model_path: str) -> DataFrame:
    """The saved vocabulary (term, df, idf)."""
    return spark.read.parquet(model_path)
