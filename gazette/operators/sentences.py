"""Sentence operators over the token arrays (row-local, no shuffle)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.annotate import annotated, let, numbered_sentences, span_text, tokens_of
from ..functions.fixed import (AUX_DEPS, DROP_LEMMA_PREFIXES, DROP_LEMMA_SUFFIXES,
                               DROP_POS_PREFIXES, SUBJECT_DEPS)
from ..functions.kept import kept_rows
from ..functions.text import html_to_clean_text
from .similarity import content_tokens

BIG = 1 << 30


def is_relevant(text: Column, tokens: Column) -> Column:
    """Some VERB (dep not aux/auxpass) has a subject child on its left, and
    the stripped text ends with '.'. Heads are looked up by index (O(n))."""
    def body(arr):
        def subj(c):
            h = F.get(arr, c["head"])
            return (c["dep"].isin(*SUBJECT_DEPS) & (c["i"] < c["head"])
                    & (h["pos"] == "VERB") & ~h["dep"].isin(*AUX_DEPS))
        return F.coalesce(F.exists(arr, subj), F.lit(False))
    ends = F.regexp_replace(text, r"(?U)\s+\z", "").endswith(".")
    return let(tokens, body) & ends


def _prefix_len(values: Column, patterns) -> Column:
    """Length of the first pattern (in list order) that ``values`` starts with, else 0."""
    out = F.lit(0)
    for p in reversed(patterns):
        out = F.when(F.slice(values, 1, len(p)) == F.array(*[F.lit(x) for x in p]),
                     F.lit(len(p))).otherwise(out)
    return out


def _first_index(values: Column, pattern) -> Column:
    """0-based first position where ``pattern`` occurs in ``values``, else NULL
    (element-wise comparisons; no sub-array per position)."""
    n = F.size(values)

    def at(i):
        terms = [F.get(values, i + j) == F.lit(x) for j, x in enumerate(pattern)]
        return F.coalesce(reduce(lambda a, b: a & b, terms), F.lit(False))

    hits = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)
    pos = F.array_position(hits, True)
    return F.when((n > 0) & (pos > 0), (pos - 1).cast("int"))


def trim_tokens(tokens: Column) -> Column:
    """Sentence trimming with the reference's quirks kept.

    POS and lemma lists are taken from the untrimmed sentence: (a) leading
    non-quote PUNCT is dropped; (b) the first matching lemma prefix and (c)
    the first matching POS prefix are cut from the current span; (d) the
    first suffix pattern (list order) found anywhere at position i truncates
    the *current* span to its first i tokens.
    """
    def body(x):
        # the lists are bound once: an unbound one would be built again at every position it is read at
        arr, lem, pos = x["arr"], x["lem"], x["pos"]
        keep = F.transform(arr, lambda t: (t["pos"] != "PUNCT") | t["is_quote"])
        first_keep = F.array_position(keep, True)
        lead = F.when(first_keep > 0, first_keep - 1).otherwise(F.size(arr))
        cut = lead + _prefix_len(lem, DROP_LEMMA_PREFIXES) + _prefix_len(pos, DROP_POS_PREFIXES)
        cur = F.slice(arr, (cut + 1).cast("int"), BIG)
        idx = reduce(lambda acc, p: F.coalesce(acc, _first_index(lem, p)),
                     DROP_LEMMA_SUFFIXES[1:], _first_index(lem, DROP_LEMMA_SUFFIXES[0]))
        return F.when(idx.isNull(), cur).otherwise(F.slice(cur, 1, F.coalesce(idx, F.lit(0))))
    return let(let(tokens, lambda arr: F.struct(
        arr.alias("arr"), F.transform(arr, lambda t: t["lemma"]).alias("lem"), F.transform(arr, lambda t: t["pos"]).alias("pos"))), body)


def kept_sentences(text: Column) -> Column:
    """Relevant sentences of a text, trimmed; empty results dropped.

    array<struct<sent int, text string, tokens array<token>>> with ``sent``
    the sentence's position in the text and ``text`` the trimmed span.
    """
    return kept_from_sentences(dotted_sentences(text))


def dotted_sentences(text: Column) -> Column:
    """Annotated sentences that end with '.' (with their original position):
    the others can never be relevant, so they are not annotated at all."""
    return F.transform(dotted_spans(text), lambda s: F.struct(
        s["sent"].alias("sent"), s["text"].alias("text"), tokens_of(s["text"]).alias("tokens")))


def dotted_spans(text: Column) -> Column:
    """array<struct<sent int, text string>> of the sentences that end with '.'."""
    return F.filter(numbered_sentences(text), lambda s: s["text"].endswith("."))  # a sentence ends in its punctuation


def dotted_in_batches(text: Column) -> Column:
    """``dotted_sentences`` of a text column, annotated batch by batch (``functions.words``)."""
    return annotated(dotted_spans(text))


def kept_in_batches(text: Column) -> Column:
    """``kept_sentences`` of a text column, annotated batch by batch."""
    return kept_from_sentences(dotted_in_batches(text))


def kept_compact(text: Column) -> Column:
    """``kept_in_batches`` without the token structs, see ``functions.kept``."""
    return kept_rows(dotted_spans(text))


def with_clean_text(pages: DataFrame, out: str, html_col: str = "html") -> DataFrame:
    """Pages with their clean text as column ``out``. It is exploded from one element, so that
    Spark does not put the expression into the argument of the annotator (``words.per_sentence``)."""
    return pages.select("*", F.explode(F.array(html_to_clean_text(F.col(html_col)))).alias(out))


def kept_from_sentences(sentences: Column) -> Column:
    """``kept_sentences`` on an already annotated sentence array (the native
    annotator's or a plug-in model's, see ``functions.plugin``)."""
    rel = F.filter(sentences, lambda s: is_relevant(s["text"], s["tokens"]))
    trimmed = F.transform(rel, lambda s: let(trim_tokens(s["tokens"]), lambda tt: F.struct(
        s["sent"].alias("sent"), span_text(tt).alias("text"), tt.alias("tokens"))))
    return F.filter(trimmed, lambda s: F.size(s["tokens"]) > 0)


def training_text(kept: Column) -> Column:
    """Space-joined lemmas of the content tokens of the kept sentences."""
    lemmas = F.flatten(F.transform(
        kept, lambda s: F.transform(content_tokens(s["tokens"]), lambda t: t["lemma"])))
    return F.array_join(lemmas, " ")
