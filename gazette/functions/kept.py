"""Kept sentences of whole batches, in the compact form of the summariser.

``operators.sentences`` states the rules on Columns: a sentence is relevant if a verb has
its subject on the left, and is then trimmed. Here the same rules run on the numbered tokens
of a batch (``words``), so that only what the scorers read goes back to Spark, and only for
the sentences that are kept.
"""

from __future__ import annotations

import re
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CONTENT_LEMMA_PATTERN, DROP_LEMMA_PREFIXES, DROP_LEMMA_SUFFIXES, DROP_POS_PREFIXES
from .words import POS, STOP_WORDS, Words, arcs, places, rule_facts, slices, taken

KEPT_SCHEMA = "array<struct<sent:int,text:string,n_tokens:int,content:array<string>,nouns:array<string>>>"

_LEMMAS = sorted({x for p in DROP_LEMMA_PREFIXES + DROP_LEMMA_SUFFIXES for x in p})
_CONTENT = re.compile(CONTENT_LEMMA_PATTERN)


def _codes(patterns: list[list[str]], names) -> list[list[int]]:
    return [[names.index(x) for x in p] for p in patterns]


def _starting(codes: np.ndarray, after: np.ndarray, pattern: list[int]) -> np.ndarray:
    """Whether ``pattern`` stands at each token, within its sentence."""
    out = after >= len(pattern) - 1
    for j, x in enumerate(pattern):
        out[:len(codes) - j] &= codes[j:] == x
    return out


def _first(hits: np.ndarray, i: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Place in its sentence of each of ``n`` sentences' first hit, else -1."""
    at, out = np.flatnonzero(hits)[::-1], np.full(n, -1)
    out[of[at]] = i[at]
    return out


def _prefix_len(codes, after, i, of, n: int, patterns) -> np.ndarray:
    """Length of the first pattern (in list order) that each sentence starts with, else 0."""
    out = np.zeros(n, np.int64)
    for p in reversed(patterns):
        out[of[_starting(codes, after, p) & (i == 0)]] = len(p)
    return out


def trimmed(pos: np.ndarray, lemma: np.ndarray, quote: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of each sentence's trimmed span, and its number of tokens; as ``sentences.trim_tokens``."""
    sizes = np.diff(begins)
    n, of, (i, after) = len(sizes), np.repeat(np.arange(len(sizes)), sizes), places(begins)
    lead = _first((pos != POS.index("PUNCT")) | quote, i, of, n)
    cut = np.where(lead < 0, sizes, lead) \
        + _prefix_len(lemma, after, i, of, n, _codes(DROP_LEMMA_PREFIXES, _LEMMAS)) + _prefix_len(pos, after, i, of, n, _codes(DROP_POS_PREFIXES, POS))
    ends = np.full(n, -1)
    for p in _codes(DROP_LEMMA_SUFFIXES, _LEMMAS):
        ends = np.where(ends < 0, _first(_starting(lemma, after, p), i, of, n), ends)
    left = np.maximum(sizes - cut, 0)
    return begins[:-1] + cut, np.where(ends < 0, left, np.minimum(left, ends))


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def kept_facts(text: str, low: str) -> tuple[str, int, int, bool]:
    """Lemma of a word, place of its part of speech in POS and of its lemma in _LEMMAS (else -1), and whether it is a content word."""
    lemma, pos = rule_facts(text, low)
    return lemma, POS.index(pos), _LEMMAS.index(lemma) if lemma in _LEMMAS else -1, low not in STOP_WORDS and _CONTENT.match(lemma) is not None


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _of_slice(words: Words, spans: pa.Array) -> pa.Array:
    flat = spans.flatten()
    numbers, begins, (text, ws, low, stop, quote, lemma, pos, cue, content) = words.cut(flat.field(1).to_pylist())
    p = np.array(pos)[numbers]
    nominal, near, far = arcs(p, places(begins)[1])
    subjects = np.concatenate(([0], np.cumsum(nominal & (near | far))))
    relevant = np.flatnonzero(subjects[begins[1:]] > subjects[begins[:-1]])
    sizes = np.diff(begins)[relevant]
    numbers = numbers[_ranges(begins[relevant], sizes)]
    start, size = trimmed(np.array(pos)[numbers], np.array(cue)[numbers], np.array(quote)[numbers], np.concatenate(([0], np.cumsum(sizes))))
    kept, start, size = relevant[size > 0], start[size > 0], size[size > 0]
    # words of the kept spans, and each span's tokens as places among them
    met, tokens = np.unique(numbers[_ranges(start, size)], return_inverse=True)
    met, row = met.tolist(), np.repeat(np.arange(len(kept)), size)
    of = lambda values: [values[k] for k in met]
    # a span's text: its tokens with their whitespace, the last one without
    shown = tokens.copy()
    shown[np.cumsum(size) - 1] += len(met)
    texts = pc.binary_join(_lists(taken([text[k] + ws[k] for k in met] + of(text), shown), size), "")

    def lemmas(wanted: list[bool]) -> pa.ListArray:
        at = np.array(wanted, bool)[tokens]
        return _lists(taken(of(lemma), tokens[at]), np.bincount(row[at], minlength=len(kept)))

    out = pa.StructArray.from_arrays(
        [flat.field(0).take(pa.array(kept)), texts, pa.array(size, pa.int32()), lemmas(of(content)), lemmas([x == POS.index("NOUN") for x in of(pos)])],
        ["sent", "text", "n_tokens", "content", "nouns"])
    per_text = np.concatenate(([0], np.cumsum(pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, per_text), pa.int32()), out, mask=spans.is_null())


def _by_rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    words = Words(kept_facts)
    for batch in batches:
        for spans in slices(batch):
            yield _of_slice(words, spans)


def kept_rows(spans: Column) -> Column:
    """Kept sentences (sent, text, n_tokens, content, nouns) of sentences that end with '.' (array<struct<sent int, text string>>)
    of a plain text column: ``content`` and ``nouns`` are the lemmas of the content tokens and of the NOUN tokens."""
    return F.arrow_udf(_by_rules, KEPT_SCHEMA)(spans)
