"""Batches of sentences: the same tokens as the rules on Columns, in every shape of word; linear trimming and heads."""

import random

from pyspark.sql import functions as F

from gazette.functions import lexicon as L
from gazette.functions.annotate import sentences_of, sentences_tokens, tokens_of
from gazette.functions.tagger import arcs_of, tagged_tokens_of
from gazette.operators.sentences import dotted_in_batches, dotted_sentences, trim_tokens

ODD = ("cities Ties gas glass bus buses news NEWS 12 ١٢ ²³ 一 x X _ _a a_ É été İstanbul ΑΣ straße ly fly truly ed bed used TED's "
       "€ £ % ` \" “ ” « — … \U0001F600 漢字 é \x85 \x1c a b a  b　c a​b   tab\t\tnew\n\nline").split(" ")


def _texts():
    rng = random.Random(3)
    words = sorted(L.POS_MAP) + sorted(L.LEMMA_MAP) + ODD + ["plants", "Quickly", "painted", ",", "!", "."]
    texts = [" ".join(words) + ".", "", "  ", "no end", ". . .", "a.b.c!? d", None]
    return texts + ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", ". ", "\n"]) for _ in range(60)) for _ in range(200)]


def test_batches_equal_the_rules_on_columns(spark):
    df = spark.createDataFrame(list(enumerate(_texts())), "k int, text string").repartition(2)
    plain = F.transform(sentences_of(F.col("text")), lambda s, k: F.struct(k.alias("sent"), s.alias("text"), tokens_of(s).alias("tokens")))
    for batches, rules in ((sentences_tokens(F.col("text")), plain), (dotted_in_batches(F.col("text")), dotted_sentences(F.col("text")))):
        got = {r.k: r.x for r in df.select("k", batches.alias("x")).collect()}
        want = {r.k: r.x for r in df.select("k", rules.alias("x")).collect()}
        assert got == want and len(got) > 200


def test_slices_and_word_limit_change_nothing(spark, monkeypatch):
    from gazette.functions import words as W
    df = spark.createDataFrame(list(enumerate(_texts())), "k int, text string").coalesce(1)
    want = df.select("k", sentences_tokens(F.col("text")).alias("x")).orderBy("k").collect()
    monkeypatch.setattr(W, "SLICE_BYTES", 50)
    monkeypatch.setattr(W, "WORDS", 3)
    assert df.select("k", sentences_tokens(F.col("text")).alias("x")).orderBy("k").collect() == want


def test_annotators_run_in_batches_and_trimming_builds_its_lists_once(spark):
    from gazette.plans.queries import queries
    for name in ("tokens", "tagged_tokens", "attached_heads", "relevant_sentences", "trim_sentence", "content_tokens", "polish", "training_text"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan, name
    t = spark.createDataFrame([("Apple grew.",)], "s string").select(trim_tokens(tokens_of(F.col("s"))).alias("t"))
    assert t._jdf.queryExecution().analyzed().toString().count(".lemma,") <= 2  # the annotator's and the list of the trimming


def test_long_sentences_stay_linear(spark):
    n = 20000
    for tags in (["NOUN", "PUNCT"] * n, ["DET", "NOUN", "PUNCT"] * n, ["AUX", "NOUN", "PUNCT"] * n + ["VERB"] * n, ["SCONJ", "PRON", "VERB"] * n):
        dep, head = arcs_of(tags, [False] * len(tags))
        assert len(dep) == len(head) == len(tags)
    df = spark.createDataFrame([(" ".join(["plans", "gas", ","] * n) + ".",)], "s string")
    assert df.select(F.size(tagged_tokens_of(F.col("s")))).first()[0] == 3 * n + 1


def test_title_words_in_batches(spark):
    """Word sets and tokens of titles as the built-in annotator gives them; the annotator runs once a title."""
    from gazette.functions.annotate import tokens_of
    from gazette.operators.similarity import prepare, tokens_in_batches, wordset, wordset_in_batches
    titles = [None, "", "  ", "Bridges opened: the mayor's cities", "\u00c9tudes \u0130stanbul \u039f\u03a3 x1 42 %", "\u2003a\u00a0b  c\t", "running, ran & \"runs\" `q`", "\U0001f525 fire"]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    both = df.select("title", wordset(F.col("title")).alias("a"), wordset_in_batches(F.col("title")).alias("b"),
                     F.coalesce(F.transform(tokens_of(F.col("title"), parse=False), lambda t: F.struct(t["text"], t["ws"], t["lemma"], t["pos"], t["is_stop"])), F.array()).alias("c"),
                     F.transform(tokens_in_batches(F.col("title")), lambda t: F.struct(t["text"], t["ws"], t["lemma"], t["pos"], t["is_stop"])).alias("d"))
    for r in both.collect():
        assert r.a == r.b and [tuple(t) for t in r.c] == [tuple(t) for t in r.d], r.title
    arts = df.select("id", F.current_timestamp().alias("create_time"), "title", F.lit("http://a.example/").alias("uri"))
    plan = prepare(arts).filter(F.size("words") > 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_compact_sentences_equal_the_rules_on_columns(spark, monkeypatch):
    """Relevance, trimming and lemmas decided in the batches; only what the scorers read comes back."""
    from gazette.functions import words as W
    from gazette.operators.sentences import kept_compact, kept_in_batches
    from gazette.operators.summarize import article_sentences, compact
    starts = ["On top of that, ", "That says, ", "However, ", "Very soon, ", "Yes! ", "And ", "Oh, ", "— ", "\" ", ", . ", "On top of that, And ", ""]
    ends = [", says Apple", ", he said", ", they told Apple", ", says Apple, he said", ", he told us, Apple says", ""]
    texts = _texts() + [f"{a}the plants grew {b}{c}." for a in starts for b in ("", "quickly") for c in ends] + [", says it grew.", "And.", "He said."]
    texts.append("  ".join(t for t in texts if t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2)
    s = df.select("doc_id", F.explode(kept_in_batches(F.col("text"))).alias("s")).select("doc_id", "s.sent", "s.text", "s.tokens")
    want = sorted(compact(s).drop("polished").collect())
    assert len(want) > 200 and any(not r.nouns for r in want)

    def got():
        k = df.select("doc_id", F.explode(kept_compact(F.col("text"))).alias("s"))
        return sorted(k.select("doc_id", "s.*").select("doc_id", "sent", "text", "n_tokens", "content", "nouns").collect())
    assert got() == want
    monkeypatch.setattr(W, "SLICE_BYTES", 50)
    monkeypatch.setattr(W, "WORDS", 3)
    assert got() == want
    pages = df.select(F.col("doc_id").alias("id"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    plan = article_sentences(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "is_stop" not in plan
