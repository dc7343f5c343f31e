"""Tokens of whole batches of sentences: the rules of ``annotate.tokens_of``, asked once per distinct word.

A rule looks at a word alone (its lists, its shape) or at the parts of speech of
the next two tokens. So a batch is cut into tokens, the word rules run once per
distinct token text, and everything else is numpy and Arrow over the batch: a
token costs a dictionary look-up instead of some hundred interpreted expressions.
Batches are taken in slices of SLICE_BYTES of text and a task remembers WORDS
words at most, so memory does not depend on the data.

``[\\p{L}\\p{N}_]`` is Python's ``\\w`` (the same code points in every category).
Characters that entered Unicode after the JVM's tables have the category of Python's.
"""

from __future__ import annotations

import re
import unicodedata
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

SLICE_BYTES = 1 << 20
WORDS = 1 << 18

SPACE = r"\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # WS_CLASS, written out
SPACES = "".join(filter(re.compile(f"[{SPACE}]").match, map(chr, range(0x3001))))
POS = ("NOUN", "PROPN", "VERB", "AUX", "ADJ", "ADV", "PRON", "DET", "ADP", "CCONJ", "SCONJ",
       "PART", "NUM", "INTJ", "PUNCT", "SYM", "X")
DEPS = ("dep", "nsubj", "aux", "ROOT", "punct")

TOKEN_SCHEMA = ("array<struct<i:int,text:string,ws:string,lemma:string,pos:string,dep:string,head:int,"
                "is_stop:boolean,is_quote:boolean>>")
SENTENCES_SCHEMA = f"array<struct<sent:int,text:string,tokens:{TOKEN_SCHEMA}>>"

_CLOSED = {w: tag for words, tag in reversed((
    (L.PRONOUNS, "PRON"), (L.DETERMINERS, "DET"), (L.ADPOSITIONS, "ADP"), (L.CONJUNCTIONS, "CCONJ"),
    (L.SUBORDINATORS, "SCONJ"), (L.AUXILIARIES, "AUX"), (L.PARTICLES, "PART"), (L.INTERJECTIONS, "INTJ"),
    (L.ADVERBS, "ADV"), (L.NUMBER_WORDS, "NUM"), (["%"], "NOUN"), (["`"], "PUNCT"))) for w in words}
LISTED = {w: "VERB" for w, tag in L.POS_MAP.items() if tag == "VERB"} | _CLOSED
PRONOUNS, STOP_WORDS, QUOTES = set(L.PRONOUNS), set(L.STOP_WORDS), set(L.QUOTES)
IES, PLURAL = re.compile("[a-z]{2,}ies"), re.compile("[a-z]{2,}[a-hj-rtv-z]s")


def kind(char: str) -> str:
    return unicodedata.category(char)[0]


def numeric(text: str) -> bool:
    r"""``^\p{N}+$``; most words end at their first letter."""
    return text[0].isnumeric() and all(kind(c) == "N" for c in text)


def letters_and(low: str, ending: str, least: int) -> bool:
    r"""``^\p{L}{least,}<ending>$`` for an ending of letters."""
    return low.endswith(ending) and len(low) >= least + len(ending) and low.isalpha()


def pos_of(text: str, low: str) -> str:
    """As ``annotate.pos_of``."""
    if low in LISTED:
        return LISTED[low]
    if len(text) == 1:
        return {"P": "PUNCT", "S": "SYM", "N": "NUM", "L": "NOUN"}.get(kind(text), "X")
    if numeric(text):
        return "NUM"
    return "ADV" if letters_and(low, "ly", 2) else "VERB" if letters_and(low, "ed", 3) else "NOUN"


def lemma_of(low: str, pos: str) -> str:
    """As ``annotate.lemma_of``."""
    if low in PRONOUNS:
        return "-PRON-"
    if low in L.LEMMA_MAP:
        return L.LEMMA_MAP[low]
    if pos != "NOUN" or not low.endswith("s"):
        return low
    return low[:-3] + "y" if IES.fullmatch(low) else low[:-1] if PLURAL.fullmatch(low) else low


class Numbers(dict):
    """Keys numbered in the order they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Words:
    """Distinct tokens that a task has met, each with what ``facts(text, low)`` says of it."""

    def __init__(self, facts):
        self.find = re.compile(rf"(?:\w+|[^\w{SPACE}])[{SPACE}]*").findall
        self.facts, self.seen = facts, {}

    def look(self, raw: str) -> tuple:
        got = self.seen.get(raw)
        if got is None:
            if len(self.seen) >= WORDS:
                self.seen.clear()
            text = raw.rstrip(SPACES)
            low = text.lower()
            got = self.seen[raw] = (text, raw[len(text):], low, low in STOP_WORDS, text in QUOTES, *self.facts(text, low))
        return got

    def cut(self, sentences: list[str | None]):
        """Numbers of the tokens of all sentences, where each sentence begins, and the columns of the numbered tokens."""
        ids, numbers, begins = Numbers(), [], [0]
        for s in sentences:
            numbers.extend(map(ids.__getitem__, self.find(s or "")))
            begins.append(len(numbers))
        rows = [self.look(r) for r in ids] or [self.look("x")]
        return np.array(numbers, np.int64), np.array(begins, np.int64), list(zip(*rows))


def places(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each token in its sentence, and tokens of the sentence after it."""
    sizes = np.diff(begins)
    i = np.arange(begins[-1]) - np.repeat(begins[:-1], sizes)
    return i, np.repeat(sizes, sizes) - i - 1


def token_lists(begins, i, text, ws, lemma, pos, dep, head, stop, quote) -> pa.Array:
    names = ["i", "text", "ws", "lemma", "pos", "dep", "head", "is_stop", "is_quote"]
    cols = [pa.array(i, pa.int32()), text, ws, lemma, pos, dep, pa.array(head, pa.int32()), stop, quote]
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays(cols, names))


def taken(values, numbers: np.ndarray, kind=None) -> pa.Array:
    return pa.array(values, kind or pa.string()).take(pa.array(numbers))


def _among(p: np.ndarray, *names: str) -> np.ndarray:
    return np.isin(p, [POS.index(x) for x in names])


def arcs(p: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens by their parts of speech (places in POS): whether it is a nominal, and whether its head is the next token or the one after that."""
    at = lambda k: np.where(after >= k, np.concatenate([p[k:], np.full(min(k, len(p)), -1)]), -1)
    p1, p2 = at(1), at(2)
    nominal, verb1, verb2 = _among(p, "NOUN", "PROPN", "PRON"), _among(p1, "VERB"), _among(p2, "VERB")
    near = (nominal | _among(p, "AUX")) & verb1
    far = ~near & verb2 & ((nominal & _among(p1, "AUX", "ADV", "PART")) | (_among(p, "AUX") & _among(p1, "ADV", "PART")))
    return nominal, near, far


def ruled(words: Words, sentences: list[str | None]) -> pa.Array:
    """Tokens of each sentence by the rules; heads as ``annotate._attach``."""
    numbers, begins, (text, ws, low, stop, quote, lemma, tag) = words.cut(sentences)
    i, after = places(begins)
    p = np.array([POS.index(t) for t in tag])[numbers]
    nominal, near, far = arcs(p, after)
    dep = np.select([(near | far) & nominal, near | far, _among(p, "VERB", "AUX"), _among(p, "PUNCT")], [1, 2, 3, 4], 0)
    return token_lists(begins, i, taken(text, numbers), taken(ws, numbers), taken(lemma, numbers), taken(POS, p), taken(DEPS, dep),
                       i + near + 2 * far, taken(stop, numbers, pa.bool_()), taken(quote, numbers, pa.bool_()))


def rule_facts(text: str, low: str) -> tuple[str, str]:
    pos = pos_of(text, low)
    return lemma_of(low, pos), pos


def slices(spans: pa.Array) -> Iterator[pa.Array]:
    """Parts of a batch of some SLICE_BYTES of text, or a row that has more."""
    size = pc.binary_length(spans.values.field(1)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.concatenate(([0], np.cumsum(size)))[spans.offsets.to_numpy()[1:]] // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(spans)]
    return (spans.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def with_tokens(spans: pa.Array, tokens_of) -> pa.Array:
    """array<struct<sent, text>> -> array<struct<sent, text, tokens>>."""
    flat = spans.flatten()
    sent, text = flat.field(0), flat.field(1)
    out = pa.StructArray.from_arrays([sent, text, tokens_of(text.to_pylist())], ["sent", "text", "tokens"])
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out, mask=spans.is_null())


def _by_rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    words = Words(rule_facts)
    for batch in batches:
        for spans in slices(batch):
            yield with_tokens(spans, lambda s: ruled(words, s))


def per_sentence(batches_of, spans: Column) -> Column:
    """``batches_of`` (an Arrow iterator) over sentences (array<struct<sent int, text string>>) of a plain text column.

    Spark 4.1 does not find a UDF whose argument nests lambdas deeply, as ``html_to_text``
    does: give such a text a column of its own first (``sentences.with_clean_text``)."""
    return F.arrow_udf(batches_of, SENTENCES_SCHEMA)(spans)


def annotated(spans: Column) -> Column:
    """Sentences (array<struct<sent int, text string>>) with their tokens."""
    return per_sentence(_by_rules, spans)
