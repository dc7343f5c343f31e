
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gazette.operators import summarize as SM
from gazette.operators import tfidf as T
from gazette.operators.sentences import kept_sentences, training_text
from gazette.functions.text import html_to_clean_text
from gazette.sources import fixtures as V
from gazette.operators.vectors import open_store


def _setup(spark):
    arts = V.articles(spark, SF_SMALL).filter((F.col("status") == "D") & F.col("html").isNotNull())
    texts = arts.select(F.col("id").alias("doc_id"),
                        training_text(kept_sentences(html_to_clean_text(F.col("html")))).alias("text"))
    return arts, T.fit(texts)


def test_l2_norm_is_one(spark):
    arts, vocab = _setup(spark)
    sents = SM.article_sentences(arts)
    w = SM.doc_weights(sents, vocab)
    norms = [r.n for r in w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()]
    assert norms and all(abs(n - 1.0) < 1e-9 for n in norms)


def test_summary_bounded_ordered_distinct(spark):
    arts, vocab = _setup(spark)
    n = 2
    sents = SM.article_sentences(arts)
    store = open_store(*V.vectors(spark, SF_SMALL))
    vectors = SM.Vectors(sents, arts.select(F.col("id").alias("doc_id"), "title"), store)
    scores = SM.sentence_scores(sents, SM.doc_weights(sents, vocab), vectors)
    top = SM.top_sentences(scores, n).collect()
    by_doc = {}
    for r in top:
        by_doc.setdefault(r.doc_id, []).append((r.sent, r.polished))
    assert by_doc
    for doc, items in by_doc.items():
        assert len(items) <= n
        texts = [t for _, t in items]
        assert len(set(texts)) == len(texts)
    summ = {r.doc_id: r.summary for r in SM.collect_summary(SM.top_sentences(scores, n)).collect()}
    for doc, items in by_doc.items():
        assert summ[doc] == [t for _, t in sorted(items)]
    # the full operator gives every article a (possibly empty) summary
    full = SM.summarize(arts, vocab, store, top_n=n)
    assert full.count() == arts.count()
    assert full.filter(F.size("summary") > n).count() == 0
