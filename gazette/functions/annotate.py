"""Native rule annotator: text -> sentences -> tokens, all as Column expressions.

Output schema (one element per token, ``i`` = 0-based index in its sentence)::

    array<struct<i int, text string, ws string, lemma string, pos string,
                 dep string, head int, is_stop boolean, is_quote boolean>>

Annotation is a narrow (row-local) transformation: no shuffle, and it scales
with the number of rows. Spans (titles, ``tokens_of``) are annotated by built-in
higher-order functions over arrays; the sentences of whole texts
(``sentences_tokens``) by the same rules in ``words``, asked once per distinct
word of an Arrow batch. Neighbour rules look at fixed offsets (i+1, i+2), so a
sentence of n tokens costs O(n).

Operators downstream (title filter, relevance, trimming, scoring) depend only
on this schema, so a different annotator can be swapped in by producing the
same struct.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .words import annotated

# Token pattern: a run of word characters, or one other non-space character,
# with the whitespace that follows it (kept to rebuild the exact span text).
WS_CLASS = r"\t\n\x0B\f\r\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"
BARE_TOKEN_PATTERN = rf"(?:[{WORD_CLASS}]+|[^{WORD_CLASS}{WS_CLASS}])"
TOKEN_PATTERN = BARE_TOKEN_PATTERN + rf"[{WS_CLASS}]*"
TRAILING_WS = rf"[{WS_CLASS}]+$"
SENTENCE_PATTERN = r"[^.!?]+[.!?]+"

SUBJECT_HOSTS = ("NOUN", "PROPN", "PRON")
BRIDGES = ("AUX", "ADV", "PART")

_LEMMA_KEYS = sorted(L.LEMMA_MAP)
_LEMMA_BUCKETS: dict[str, Column] | None = None


def _lemma_lookup(low: Column) -> Column:
    """Listed lemma of ``low``. Map literals are searched linearly, so the
    list is split into one small map per first character (a CASE picks it)."""
    global _LEMMA_BUCKETS
    if _LEMMA_BUCKETS is None:
        groups: dict[str, list[str]] = {}
        for k in _LEMMA_KEYS:
            groups.setdefault(k[0], []).append(k)
        _LEMMA_BUCKETS = {
            ch: F.create_map(*[F.lit(x) for k in keys for x in (k, L.LEMMA_MAP[k])])
            for ch, keys in groups.items()}
    first = F.substring(low, 1, 1)
    out = None
    for ch, m in sorted(_LEMMA_BUCKETS.items()):
        out = (F.when(first == ch, F.try_element_at(m, low)) if out is None
               else out.when(first == ch, F.try_element_at(m, low)))
    return out


_CLOSED = ((L.PRONOUNS, "PRON"), (L.DETERMINERS, "DET"), (L.ADPOSITIONS, "ADP"),
           (L.CONJUNCTIONS, "CCONJ"), (L.SUBORDINATORS, "SCONJ"), (L.AUXILIARIES, "AUX"),
           (L.PARTICLES, "PART"), (L.INTERJECTIONS, "INTJ"), (L.ADVERBS, "ADV"),
           (L.NUMBER_WORDS, "NUM"), (["%"], "NOUN"), (["`"], "PUNCT"))
_VERB_FORMS = sorted(k for k, v in L.POS_MAP.items() if v == "VERB")
_LISTED = sorted({w for words, _ in _CLOSED for w in words} | set(_VERB_FORMS))


def pos_of(text: Column, low: Column) -> Column:
    """Coarse part of speech from closed word lists and token shape.

    One hash lookup decides whether any list applies; unlisted tokens (most
    content words) go straight to the shape rules, and suffix patterns are
    only tried after a cheap ``endswith``.
    """
    listed = None
    for words, tag in _CLOSED:
        cond = low.isin(list(words))
        listed = F.when(cond, tag) if listed is None else listed.when(cond, tag)
    listed = listed.otherwise("VERB")            # the remaining listed forms are verbs
    single = (F.when(text.rlike(r"^\p{P}$"), "PUNCT")
              .when(text.rlike(r"^\p{S}$"), "SYM")
              .when(text.rlike(rf"^[{WORD_CLASS}]$"), F.when(text.rlike(r"^\p{N}$"), "NUM").otherwise("NOUN"))
              .otherwise("X"))
    run = (F.when(text.rlike(r"^\p{N}+$"), "NUM")
           .when(low.endswith("ly") & low.rlike(r"^\p{L}{2,}ly$"), "ADV")
           .when(low.endswith("ed") & low.rlike(r"^\p{L}{3,}ed$"), "VERB")
           .otherwise("NOUN"))
    return (F.when(low.isin(_LISTED), listed)
            .when(F.length(text) == 1, single)
            .otherwise(run))


def lemma_of(low: Column, pos: Column) -> Column:
    """Lemma: pronouns -> -PRON-, listed forms, plural nouns by suffix rule."""
    return (F.when(low.isin(L.PRONOUNS), F.lit("-PRON-"))
            .when(low.isin(_LEMMA_KEYS), _lemma_lookup(low))
            .when((pos != "NOUN") | ~low.endswith("s"), low)
            .when(low.rlike("^[a-z]{2,}ies$"), F.regexp_replace(low, "ies$", "y"))
            .when(low.rlike("^[a-z]{2,}[a-hj-rtv-z]s$"), F.regexp_replace(low, "s$", ""))
            .otherwise(low))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Referencing one Column expression several times copies the expression
    tree each time; binding it through a one-element ``transform`` keeps the
    plan linear in size and evaluates the value once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens_of(text: Column, parse: bool = True) -> Column:
    """Annotate one span of text into the token array described above.

    ``parse=False`` skips the dependency pass (``dep``/``head`` are then
    absent): word sets and the title filter only read text, lemma, POS and
    the stop flag.
    """
    # the same token starts with and without the trailing whitespace, zipped
    raw = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    bare = F.regexp_extract_all(text, F.lit(BARE_TOKEN_PATTERN), F.lit(0))
    base = F.transform(F.arrays_zip(bare.alias("t"), raw.alias("r")), lambda z, i: F.struct(
        i.alias("i"), z["t"].alias("text"), z["r"].alias("raw"), F.lower(z["t"]).alias("low")))
    with_pos = F.transform(base, lambda t: F.struct(
        t["i"].alias("i"), t["text"].alias("text"), t["raw"].alias("raw"),
        t["low"].alias("low"), pos_of(t["text"], t["low"]).alias("pos")))
    tagged = F.transform(with_pos, _tag)
    if not parse:
        return tagged
    return let(tagged, lambda arr: F.transform(arr, lambda t, i: _parse(arr, t, i)))


def _tag(t: Column) -> Column:
    return F.struct(
        t["i"].alias("i"),
        t["text"].alias("text"),
        F.substring(t["raw"], F.length(t["text"]) + 1, 1 << 30).alias("ws"),
        lemma_of(t["low"], t["pos"]).alias("lemma"),
        t["pos"].alias("pos"),
        t["low"].isin(L.STOP_WORDS).alias("is_stop"),
        t["text"].isin(L.QUOTES).alias("is_quote"),
    )


def _parse(arr: Column, t: Column, i: Column) -> Column:
    """Dependency guess: a nominal right before a verb (optionally across one
    auxiliary/adverb/particle) is its ``nsubj``; auxiliaries attach to the
    following verb; verbs are roots."""
    return _attach(t, i, F.get(arr, i + 1)["pos"], F.get(arr, i + 2)["pos"])


def _attach(t: Column, i: Column, p1: Column, p2: Column) -> Column:
    pos = t["pos"]
    nominal = pos.isin(*SUBJECT_HOSTS)
    dep = (F.when(nominal & (p1 == "VERB"), "nsubj")
           .when(nominal & p1.isin(*BRIDGES) & (p2 == "VERB"), "nsubj")
           .when((pos == "AUX") & (p1 == "VERB"), "aux")
           .when((pos == "AUX") & p1.isin("ADV", "PART") & (p2 == "VERB"), "aux")
           .when(pos.isin("VERB", "AUX"), "ROOT")
           .when(pos == "PUNCT", "punct")
           .otherwise("dep"))
    head = (F.when(nominal & (p1 == "VERB"), i + 1)
            .when(nominal & p1.isin(*BRIDGES) & (p2 == "VERB"), i + 2)
            .when((pos == "AUX") & (p1 == "VERB"), i + 1)
            .when((pos == "AUX") & p1.isin("ADV", "PART") & (p2 == "VERB"), i + 2)
            .otherwise(i))
    return F.struct(
        t["i"].alias("i"), t["text"].alias("text"), t["ws"].alias("ws"),
        t["lemma"].alias("lemma"), t["pos"].alias("pos"),
        dep.alias("dep"), head.cast("int").alias("head"),
        t["is_stop"].alias("is_stop"), t["is_quote"].alias("is_quote"))


# Same spans as SENTENCE_PATTERN, but every match attempt succeeds (a trailing
# run without terminal punctuation matches up to the end and is dropped
# afterwards), so the regex never re-scans an unterminated tail from each of
# its positions, which is quadratic in the tail length.
SENTENCE_SCAN_PATTERN = r"[^.!?]+(?:[.!?]+|\z)"


def sentences_of(text: Column) -> Column:
    """Sentence spans: maximal runs ending in terminal punctuation."""
    spans = F.regexp_extract_all(text, F.lit(SENTENCE_SCAN_PATTERN), F.lit(0))
    return F.filter(spans, lambda s: F.substring(s, -1, 1).isin(".", "!", "?"))


def annotate(df, text_col: str = "text", out_col: str = "sentences"):
    """Add ``out_col``: array<struct<sent int, text string, tokens array<token>>>."""
    return df.withColumn(out_col, sentences_tokens(F.col(text_col)))


def sentences_tokens(text: Column) -> Column:
    """array<struct<sent int, text string, tokens array<token>>> of a text."""
    return annotated(numbered_sentences(text))


def numbered_sentences(text: Column) -> Column:
    """array<struct<sent int, text string>> of a text."""
    return F.transform(sentences_of(text), lambda s, k: F.struct(k.alias("sent"), s.alias("text")))


def span_text(tokens: Column) -> Column:
    """Exact text of a token span: each token with its whitespace, except the
    whitespace after the last token."""
    return let(tokens, lambda arr: F.array_join(F.transform(arr, lambda t, k: F.concat(
        t["text"], F.when(k < F.size(arr) - 1, t["ws"]).otherwise(F.lit("")))), ""))
