"""Golden cases for the token rules (hand-annotated tokens, FIXTURES §3.1-3.4)."""

from pyspark.sql import functions as F

from conftest import TOKEN_SCHEMA, toks
from gazette.functions.annotate import span_text
from gazette.functions.text import polish
from gazette.operators.sentences import is_relevant, trim_tokens
from gazette.operators.titles import news_title_tokens

TITLES = [
    ("", False),
    ("Apple/Apple/PROPN", False),
    ("how/how/ADV to/to/PART", True),
    ("How/how/ADV to/to/PART fix/fix/VERB it/-PRON-/PRON", False),
    ("The/the/DET best/good/ADJ new/new/ADJ phones/phone/NOUN", False),
    ("The/the/DET Best/good/ADJ new/new/ADJ phones/phone/NOUN", True),
    ("Save/save/VERB $/$/SYM 50/50/NUM now/now/ADV", False),
    ("Apple/Apple/PROPN deal/deal/NOUN of/of/ADP the/the/DET week/week/NOUN", False),
    ("Phones/phone/NOUN :/:/PUNCT how/how/ADV to/to/PART", False),
    ("Get/get/VERB 20/20/NUM %/%/NOUN discount/discount/NOUN", False),
    ("Great/great/ADJ deal/deal/NOUN $/$/SYM 50/50/NUM", True),
    ("Great/great/ADJ deal/deal/NOUN $/$/SYM 50/50/NUM off/off/ADP", False),
    ("Profit/profit/NOUN of/of/ADP $/$/SYM 50/50/NUM million/million/NUM", True),
]


def test_news_title_golden(spark):
    rows = [(k, toks(spec)) for k, (spec, _) in enumerate(TITLES)]
    df = spark.createDataFrame(rows, f"k int, t {TOKEN_SCHEMA}")
    got = {r.k: r.ok for r in df.select("k", news_title_tokens(F.col("t")).alias("ok")).collect()}
    assert got == {k: exp for k, (_, exp) in enumerate(TITLES)}


def test_null_title_passes(spark):
    from gazette.operators.titles import is_news_title
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(is_news_title(F.col("t"))).first()[0] is True


TRIMS = [
    ("-/-/PUNCT Apple grew ./././PUNCT", "Apple grew ."),
    ('"/"/PUNCT Apple grew ./././PUNCT', '" Apple grew .'),
    ("On top of that ,/,/PUNCT Apple grew .", "Apple grew ."),
    ("However/however/ADV ,/,/PUNCT Apple grew .", "Apple grew ."),
    ("And/and/CCONJ Apple grew .", "Apple grew ."),
    ("-/-/PUNCT And/and/CCONJ Apple grew .", "And Apple grew ."),
    ("Apple grew ,/,/PUNCT said/say/VERB Cook .", "Apple grew"),
    ("However/however/ADV ,/,/PUNCT Apple grew ,/,/PUNCT said/say/VERB Cook .", "Apple grew , said"),
    (",/,/PUNCT said/say/VERB Cook .", ""),
]


def test_trim_golden(spark):
    rows = [(k, toks(spec)) for k, (spec, _) in enumerate(TRIMS)]
    df = spark.createDataFrame(rows, f"k int, t {TOKEN_SCHEMA}")
    got = {r.k: r.s for r in df.select("k", span_text(trim_tokens(F.col("t"))).alias("s")).collect()}
    assert got == {k: exp for k, (_, exp) in enumerate(TRIMS)}


RELEVANCE = [
    ("Apple/apple/NOUN/nsubj>1 grew/grow/VERB/ROOT ./././punct", "Apple grew.", True),
    ("Apple/apple/NOUN/nsubj>1 grew/grow/VERB/ROOT !/!/PUNCT/punct", "Apple grew!", False),
    ("grew/grow/VERB/ROOT Apple/apple/NOUN/nsubj>0 ./././punct", "Grew Apple.", False),
    ("Apple/apple/NOUN/nsubj>1 is/be/AUX/ROOT ./././punct", "Apple is.", False),
    ("Apple/apple/NOUN/nsubj>1 grew/grow/VERB/aux ./././punct", "Apple grew.", False),
]


def test_relevance_golden(spark):
    rows = [(k, txt, toks(spec)) for k, (spec, txt, _) in enumerate(RELEVANCE)]
    df = spark.createDataFrame(rows, f"k int, s string, t {TOKEN_SCHEMA}")
    got = {r.k: r.ok for r in df.select("k", is_relevant(F.col("s"), F.col("t")).alias("ok")).collect()}
    assert got == {k: exp for k, (_, _, exp) in enumerate(RELEVANCE)}


def test_polish_golden(spark):
    cases = [(" apple grew , fast .", "Apple grew, fast."), ("Apple   grew", "Apple grew."),
             ('"quoted text', '"quoted text.'), ("", None)]
    df = spark.createDataFrame([(a,) for a, _ in cases], "s string")
    got = [r[0] for r in df.select(polish(F.col("s"))).collect()]
    assert got == [b for _, b in cases]


def test_annotator_shapes(spark):
    from gazette.functions.annotate import tokens_of
    df = spark.createDataFrame([("He said, \"Apple grew 20%.\"",)], "s string")
    t = df.select(tokens_of(F.col("s")).alias("t")).first().t
    assert [x.text for x in t] == ["He", "said", ",", '"', "Apple", "grew", "20", "%", ".", '"']
    assert t[0].lemma == "-PRON-" and t[0].dep == "nsubj" and t[0].head == 1
    assert t[1].pos == "VERB" and t[1].lemma == "say"
    assert t[4].dep == "nsubj" and t[4].head == 5 and t[5].lemma == "grow"
    assert t[6].pos == "NUM" and t[7].pos == "NOUN" and t[3].is_quote
    assert "".join(x.text + x.ws for x in t) == "He said, \"Apple grew 20%.\""


def test_plugin_annotator_feeds_the_rules(spark):
    def _toy_model():
        """A stand-in for a statistical model: whitespace tokens, fixed tags."""
        def model(text):
            out = []
            for sent in text.split(". "):
                words = sent.rstrip(".").split()
                toks = []
                for j, w in enumerate(words):
                    pos = "VERB" if w.endswith("ed") else "NOUN"
                    dep, head = ("nsubj", j + 1) if pos == "NOUN" and j + 1 < len(words) and words[j + 1].endswith("ed") else ("dep", j)
                    toks.append(dict(text=w, ws=" ", lemma=w.lower(), pos=pos, dep=dep, head=head,
                                     is_stop=False, is_quote=False))
                toks.append(dict(text=".", ws="", lemma=".", pos="PUNCT", dep="punct", head=len(words),
                                 is_stop=False, is_quote=False))
                out.append({"text": sent.rstrip(".") + ".", "tokens": toks})
            return out
        return model

    from gazette.functions.plugin import annotate_with
    from gazette.operators.sentences import kept_from_sentences
    df = spark.createDataFrame([(1, "Apple jumped. Nothing here."), (2, None)], "id long, text string")
    ann = annotate_with(df, _toy_model)
    kept = {r.id: [s.text for s in (r.k or [])] for r in
            ann.select("id", kept_from_sentences(F.col("sentences")).alias("k")).collect()}
    assert kept == {1: ["Apple jumped ."], 2: []}
