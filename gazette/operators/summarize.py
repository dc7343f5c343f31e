"""Extractive summary: score the kept sentences of each article, pick the top N.

score = 0.5 * frequency + 0.4 * title similarity + 0.1 * length score

* frequency: sum of the document's TF-IDF weights over the sentence's NOUN
  tokens (each occurrence), divided by the sum of all weights of the
  document (0 when that sum is 0);
* title similarity: cosine between the summed word vectors of the title's
  content lemmas and of the sentence's content lemmas (0 when either is
  empty or has no vector);
* length score: 0.1 / (1 + |20 - tokens|) on the trimmed sentence.

Top N: sentences ranked by score (ties by position), equal polished texts
collapse to the best one, the N best are returned in document order.

All steps are joins/aggregations keyed by document; word vectors are summed in
blocks of sentences, so that a token's vector is not shuffled for each occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.fixed import (DEFAULT_TOP_N, FREQ_WEIGHT, LEN_SCORE_NUMERATOR,
                               LEN_TARGET, LEN_WEIGHT, SIM_WEIGHT)
from ..functions.text import polish
from . import tfidf as T
from .common import broadcast_if_bytes, spread
from .sentences import kept_compact, with_clean_text
from .similarity import content_tokens, tokens_in_batches
from .vectors import VectorStore, block_sums, lemma_vectors

# Scores are rounded before ranking so that equal scores summed in a
# different order still tie (and fall back to sentence position).
RANK_DIGITS = 10
# Bytes of the vectors of a block's tokens, at most; tokens below which no block is split for the cores.
BLOCK_BYTES, BLOCK_LEAST = 256 << 20, 1 << 14
# Sentence number of a title among the sentences of its article.
TITLE = -1


def article_sentences(articles: DataFrame, id_col: str = "id", html_col: str = "html") -> DataFrame:
    """Kept sentences of each page in the compact form the scorers need:
    (doc_id, sent, text, polished, n_tokens, content, nouns) where ``content``
    and ``nouns`` are the lemmas of the content tokens and of the NOUN tokens.
    The annotator gives this form itself (``kept_compact``): token structs never
    leave its batches. ``compact`` makes the same table of another annotator's sentences."""
    pages = with_clean_text(spread(articles.select(F.col(id_col).alias("doc_id"), F.col(html_col).alias("html"))), "_text")
    ex = pages.select("doc_id", F.explode(kept_compact(F.col("_text"))).alias("s"))
    return ex.select("doc_id", "s.sent", "s.text", polish(F.col("s.text")).alias("polished"), "s.n_tokens", "s.content", "s.nouns")


def compact(sents: DataFrame) -> DataFrame:
    """(doc_id, sent, text, tokens) -> the compact sentence table."""
    return sents.select(
        "doc_id", "sent", "text", polish(F.col("text")).alias("polished"),
        F.size("tokens").alias("n_tokens"),
        F.transform(content_tokens(F.col("tokens")), lambda t: t["lemma"]).alias("content"),
        F.transform(F.filter("tokens", lambda t: t["pos"] == "NOUN"), lambda t: t["lemma"]).alias("nouns"))


def sentence_terms(sents: DataFrame) -> DataFrame:
    """(doc_id, term): vectorizer terms of the content lemmas, one row per
    occurrence (the terms of the document's training text)."""
    # no term holds a space, so a sentence's lemmas are searched as one text
    return sents.select("doc_id", F.explode(T.terms_of(F.array_join("content", " "))).alias("term"))


def doc_weights(sents: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, term, weight): TF-IDF vector of each document's training text."""
    tf = sentence_terms(sents).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    v = vocab.select("term", "idf")
    j = tf.join(broadcast_if_bytes(v), "term")
    w = F.col("tf") * F.col("idf")
    norm = F.sqrt(F.sum(w * w).over(Window.partitionBy("doc_id")))
    return j.select("doc_id", "term", (w / norm).alias("weight"))


def sentence_frequency(sents: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, sent, freq) for every kept sentence."""
    nouns = sents.select("doc_id", "sent", F.explode("nouns").alias("term"))
    num = (nouns.join(weights, ["doc_id", "term"])
           .groupBy("doc_id", "sent").agg(F.sum("weight").alias("num")))
    den = weights.groupBy("doc_id").agg(F.sum("weight").alias("den"))
    base = sents.select("doc_id", "sent")
    j = base.join(num, ["doc_id", "sent"], "left").join(den, "doc_id", "left")
    freq = F.coalesce(F.try_divide(F.coalesce("num", F.lit(0.0)), F.col("den")), F.lit(0.0))
    return j.select("doc_id", "sent", freq.alias("freq"))


def title_lemmas(titles: DataFrame) -> DataFrame:
    """(doc_id, sent, lemma) of the titles' content lemmas, ``sent`` being TITLE, written once."""
    from ..session import cut_lineage
    t = titles.select("doc_id", F.explode(content_tokens(tokens_in_batches(F.col("title")))).alias("t"))
    return cut_lineage(t.select("doc_id", F.lit(TITLE).alias("sent"), F.col("t.lemma").alias("lemma")))


def sentence_lemmas(sents: DataFrame) -> DataFrame:
    """(doc_id, sent, lemma) of the sentences' content lemmas."""
    return sents.select("doc_id", "sent", F.explode("content").alias("lemma"))


def vector_sums(lemmas: DataFrame, keys: list[str], vectors: DataFrame, dim: int) -> DataFrame:
    """keys + (vsum array<double>, n_vec): sum of the vectors of the lemmas.

    ``vectors`` is a written (lemma, vec) table. The keys are dealt over blocks, and a block
    gets each vector once, however often its lemma occurs there (``block_sums``). A
    block's tokens are so few that BLOCK_BYTES hold their vectors if no lemma comes twice."""
    n, spark = lemmas.count(), lemmas.sparkSession
    spread_out = min(2 * spark.sparkContext.defaultParallelism, n // BLOCK_LEAST)
    blocks = max(1, spread_out, -(-n * 8 * max(dim, 1) // BLOCK_BYTES))
    tokens = lemmas.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    whole = F.transform(F.sequence(F.lit(0), F.lit(max(dim, 1) - 1)), lambda k: F.get("vec", k).cast("double"))
    once = tokens.select(F.col("_block").alias("_of"), F.col("lemma").alias("_lemma")).distinct()
    needed = once.join(broadcast_if_bytes(vectors), F.col("_lemma") == F.col("lemma")).select("_of", "_lemma", whole.alias("vec"))
    schema = StructType([*(tokens.schema[k] for k in keys), StructField("vsum", ArrayType(DoubleType())), StructField("n_vec", LongType())])
    return tokens.groupBy("_block").cogroup(needed.groupBy("_of")).applyInArrow(block_sums(keys, dim), schema)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot / (na * nb))


class Vectors:
    """Vectors of a corpus's lemmas: the titles' lemmas, and the rows of the store that sentences and titles need."""

    def __init__(self, sents: DataFrame, titles: DataFrame, store: VectorStore):
        self.titles = title_lemmas(titles)
        self.dim = store.dim
        lemmas = sents.select(F.explode("content").alias("lemma")).unionByName(self.titles.select("lemma"))
        self.table = lemma_vectors(lemmas, store)


def title_similarity(sents: DataFrame, vectors: Vectors) -> DataFrame:
    """(doc_id, sent, sim): cosine of sentence and title lemma vectors.

    Sentences and titles are summed in one aggregation."""
    v = vector_sums(sentence_lemmas(sents).unionByName(vectors.titles), ["doc_id", "sent"], vectors.table, vectors.dim)
    sv = v.filter(F.col("sent") != TITLE).select("doc_id", "sent", "vsum")
    tv = v.filter(F.col("sent") == TITLE).select("doc_id", F.col("vsum").alias("tsum"))
    sim = sv.join(tv, "doc_id").select("doc_id", "sent", cosine(F.col("vsum"), F.col("tsum")).alias("_sim"))
    return sents.select("doc_id", "sent").join(sim, ["doc_id", "sent"], "left") \
        .select("doc_id", "sent", F.coalesce("_sim", F.lit(0.0)).alias("sim"))


def length_score(n_tokens: Column) -> Column:
    return F.lit(LEN_SCORE_NUMERATOR) / (F.lit(1.0) + F.abs(F.lit(LEN_TARGET) - n_tokens))


def sentence_scores(sents: DataFrame, weights: DataFrame, vectors: Vectors | None) -> DataFrame:
    """(doc_id, sent, polished, freq, sim, len, total)."""
    fr = sentence_frequency(sents, weights)
    base = sents.select("doc_id", "sent", "polished", length_score(F.col("n_tokens")).alias("len"))
    j = base.join(fr, ["doc_id", "sent"])
    if vectors is not None:
        j = j.join(title_similarity(sents, vectors), ["doc_id", "sent"])
    else:
        j = j.withColumn("sim", F.lit(0.0))
    total = (F.col("freq") * FREQ_WEIGHT + F.col("sim") * SIM_WEIGHT + F.col("len") * LEN_WEIGHT)
    return j.withColumn("total", total)


def top_sentences(scores: DataFrame, top_n: int = DEFAULT_TOP_N) -> DataFrame:
    """(doc_id, sent, polished, total) of the selected sentences."""
    rank = F.round(F.col("total"), RANK_DIGITS)
    s = scores.filter(F.col("polished").isNotNull())
    best = (s.withColumn("_r", F.row_number().over(
        Window.partitionBy("doc_id", "polished").orderBy(rank.desc(), F.col("sent"))))
        .filter("_r = 1"))
    top = best.withColumn("_k", F.row_number().over(
        Window.partitionBy("doc_id").orderBy(rank.desc(), F.col("sent")))).filter(F.col("_k") <= top_n)
    return top.select("doc_id", "sent", "polished", "total")


def collect_summary(top: DataFrame) -> DataFrame:
    """(doc_id, summary array<string>) in document order (<= N per doc)."""
    g = top.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent", "polished"))).alias("s"))
    return g.select("doc_id", F.transform("s", lambda x: x["polished"]).alias("summary"))


def average_score(scores: DataFrame) -> DataFrame:
    """(doc_id, avg_score): mean total score (threshold candidate, off by default)."""
    return scores.groupBy("doc_id").agg(F.avg("total").alias("avg_score"))


def summarize(articles: DataFrame, vocab: DataFrame | None, store: VectorStore | None = None,
              top_n: int = DEFAULT_TOP_N, id_col: str = "id", title_col: str = "title",
              html_col: str = "html", materialize: bool = True, vocab_fn=None,
              sentences: DataFrame | None = None) -> DataFrame:
    """(doc_id, summary): up to ``top_n`` sentences per article, in order.

    Articles without any kept sentence get an empty summary. ``vocab`` may be
    None with ``vocab_fn(sentences) -> vocab`` to fit on the same annotated
    sentences (one annotation pass for training and scoring); ``sentences``
    passes an annotated sentence table (``article_sentences``) to reuse. The annotated
    sentence table feeds four branches (weights, frequency, similarity,
    length); with ``materialize`` it is computed once and checkpointed to the
    shared folder instead of being re-annotated, or read whole and cut down
    to ``articles``, per branch.
    """
    if sentences is not None:
        # already annotated (e.g. shared with the vocabulary fit): keep ours
        sents = sentences.join(articles.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    else:
        sents = article_sentences(articles, id_col, html_col)
    if materialize:
        from ..session import cut_lineage
        sents = cut_lineage(sents)
    if vocab is None:
        # fit on the same annotated sentences (train and summarise in one job)
        vocab = vocab_fn(sents)
    weights = doc_weights(sents, vocab)
    titles = articles.select(F.col(id_col).alias("doc_id"), F.col(title_col).alias("title"))
    vectors = None
    if store is not None:
        vectors = Vectors(sents, titles, store)
    scores = sentence_scores(sents, weights, vectors)
    summ = collect_summary(top_sentences(scores, top_n))
    return (articles.select(F.col(id_col).alias("doc_id")).join(summ, "doc_id", "left")
            .select("doc_id", F.coalesce("summary", F.array().cast("array<string>")).alias("summary")))


def article_report(articles: DataFrame, vocab: DataFrame, ids: DataFrame,
                   store: VectorStore | None = None, top_n: int = DEFAULT_TOP_N) -> DataFrame:
    """(id, report): title, a blank line, then the summary sentences, for the
    requested ids (a semi join, so any number of ids is one job)."""
    a = articles.join(ids.select("id"), "id", "left_semi")
    s = summarize(a, vocab, store, top_n).select(
        F.col("doc_id").alias("id"), F.col("summary").alias("_sentences"))
    return a.select("id", "title").join(s, "id").select(
        "id", F.concat(F.col("title"), F.lit("\n\n"), F.array_join("_sentences", "\n\n")).alias("report"))
