"""Tagger with Viterbi decoding and a stack of open heads.

A second native annotator beside ``annotate.tokens_of``, with the same token
schema. Every token has a few candidate tags with a cost each (``CANDIDATES``,
by the class of its word); ``TRANSITIONS`` holds the cost of a tag after
another. ``decode`` finds the cheapest sequence by dynamic programming; of
equal ones it takes the one whose tags, read from the end, come first in
``TAGS``. A token with one candidate cuts the sentence, since the best sequence
on its left does not depend on its right: every piece is decoded by itself, so
the work is linear in the tokens. A piece is a short string of word classes, and
the same ones come again and again: a task decodes each once.

``attach`` reads the tags once, keeping open heads on a stack: a nominal waits
for its verb at any distance, a subordinate clause is closed by its own verb,
prepositions and modifiers take the next nominal. Each token gets one arc, written
at its own place. The stack is only searched while it holds a head that the token
may take, and from its top.

Row-local: no shuffle. Both steps run in Arrow batches over the words of ``words``,
sentence by sentence. Defined cases: a null text gives null, a text without tokens
an empty array.
"""

from __future__ import annotations

import re
import string
import unicodedata
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from . import words as W
from .annotate import numbered_sentences

# Tags in the order that breaks ties; a sequence of tags is a string of LETTERS.
TAGS = ("NOUN", "PROPN", "VERB", "AUX", "ADJ", "ADV", "PRON", "DET", "ADP", "CCONJ", "SCONJ",
        "PART", "NUM", "INTJ", "PUNCT", "SYM", "X")
LETTERS = "".join(chr(ord("a") + k) for k in range(len(TAGS)))
START = len(TAGS)          # the state before the first token

ADJECTIVES = (
    "new good best better great big small high low early late old young long short strong weak "
    "large major key top free full open public global local final first last next other many few "
    "more most own same several much bad worse worst red black white blue green cheap easy hard"
).split()
RELATIVES = "that which who whom whose".split()
PREPOSITION_OR_CLAUSE = "after before since until as".split()
PREPOSITION_OR_ADVERB = "up down out off over about around along".split()
MAIN_OR_AUXILIARY = "have has had having do does did".split()
ADJECTIVE_ENDINGS = ("al", "ous", "ive", "ful", "ic", "able", "ible", "less")
ADJECTIVE_SUFFIXES = rf"^\p{{L}}{{2,}}(?:{'|'.join(ADJECTIVE_ENDINGS)})$"

# Candidate tags of a word class and what each costs.
CANDIDATES = {
    "relative": {"SCONJ": 0, "DET": 1, "PRON": 2},
    "to": {"PART": 0, "ADP": 0},
    "adp_sconj": {"ADP": 0, "SCONJ": 0},
    "adp_adv": {"ADP": 0, "ADV": 1},
    "have_do": {"AUX": 0, "VERB": 2},
    "pronoun": {"PRON": 0}, "determiner": {"DET": 0}, "adposition": {"ADP": 0},
    "conjunction": {"CCONJ": 0}, "subordinator": {"SCONJ": 0}, "auxiliary": {"AUX": 0},
    "particle": {"PART": 0}, "interjection": {"INTJ": 0}, "adverb": {"ADV": 0}, "number": {"NUM": 0},
    "noun": {"NOUN": 0}, "punctuation": {"PUNCT": 0}, "symbol": {"SYM": 0}, "other": {"X": 0},
    "adjective": {"ADJ": 0, "NOUN": 5, "ADV": 5},
    "verb_past": {"VERB": 0, "ADJ": 4},
    "verb_ing": {"VERB": 0, "NOUN": 3, "ADJ": 4},
    "verb": {"VERB": 0, "NOUN": 2},
    "ly": {"ADV": 0, "ADJ": 4},
    "ed": {"VERB": 0, "ADJ": 3},
    "ing": {"VERB": 1, "NOUN": 2, "ADJ": 3},
    "adjectival": {"ADJ": 0, "NOUN": 2},
    "capital_inside": {"PROPN": 0, "NOUN": 4},
    "capital_plural": {"NOUN": 0, "PROPN": 2},
    "capital_first": {"PROPN": 1, "NOUN": 2, "ADJ": 5, "VERB": 6},
    "plural": {"NOUN": 0, "VERB": 4},
    "lower": {"NOUN": 0, "ADJ": 4, "VERB": 5},
}

# What a tag costs after another; pairs not named cost OTHER.
OTHER = 6
TRANSITIONS = {
    "START": {"NOUN": 2, "PROPN": 2, "PRON": 1, "DET": 1, "ADP": 2, "ADJ": 3, "ADV": 2, "SCONJ": 2, "VERB": 4,
              "NUM": 3, "PUNCT": 2, "CCONJ": 2, "INTJ": 1, "AUX": 4, "PART": 3},
    "NOUN": {"VERB": 2, "AUX": 1, "ADP": 1, "PUNCT": 1, "NOUN": 3, "CCONJ": 2, "SCONJ": 2, "ADV": 3, "PART": 3, "PROPN": 4},
    "PROPN": {"VERB": 2, "AUX": 1, "ADP": 2, "PUNCT": 1, "PROPN": 1, "NOUN": 2, "CCONJ": 2, "SCONJ": 3, "ADV": 3, "PART": 3, "NUM": 3},
    "VERB": {"DET": 1, "ADP": 2, "NOUN": 2, "PROPN": 2, "PRON": 2, "ADJ": 3, "ADV": 2, "PUNCT": 2, "PART": 2, "NUM": 2, "SCONJ": 2, "SYM": 3, "CCONJ": 3},
    "AUX": {"VERB": 1, "ADV": 2, "PART": 2, "DET": 2, "ADJ": 2, "AUX": 2, "PRON": 3, "NOUN": 4, "PROPN": 4},
    "ADJ": {"NOUN": 0, "ADJ": 3, "PROPN": 2, "PUNCT": 3, "ADP": 3, "CCONJ": 3, "PART": 3},
    "ADV": {"VERB": 2, "ADJ": 2, "ADV": 3, "PUNCT": 2, "ADP": 3, "DET": 3, "PART": 2, "NUM": 3, "AUX": 3, "PRON": 3},
    "PRON": {"VERB": 1, "AUX": 1, "NOUN": 2, "ADJ": 3, "PUNCT": 2, "ADP": 3, "ADV": 3, "PART": 3},
    "DET": {"NOUN": 1, "PROPN": 2, "ADJ": 1, "NUM": 2, "ADV": 4},
    "ADP": {"DET": 1, "NOUN": 1, "PROPN": 1, "PRON": 2, "ADJ": 2, "NUM": 1, "SYM": 2},
    "CCONJ": {"NOUN": 2, "PROPN": 2, "VERB": 2, "DET": 2, "ADJ": 3, "PRON": 2, "ADV": 3, "ADP": 3, "AUX": 3, "PUNCT": 3},
    "SCONJ": {"PRON": 1, "DET": 1, "NOUN": 2, "PROPN": 2, "VERB": 2, "AUX": 2, "ADJ": 3, "ADV": 3},
    "PART": {"VERB": 0, "ADV": 3, "AUX": 2},
    "NUM": {"NOUN": 1, "NUM": 1, "PUNCT": 2, "ADP": 2, "SYM": 2},
    "INTJ": {"PUNCT": 0, "PRON": 3},
    "PUNCT": {"NOUN": 2, "PROPN": 2, "PRON": 2, "DET": 2, "ADP": 2, "CCONJ": 1, "SCONJ": 1, "ADV": 2, "ADJ": 3, "NUM": 2,
              "PUNCT": 1, "VERB": 3, "AUX": 3},
    "SYM": {"NUM": 0},
}


def cost(before: str, tag: str) -> int:
    return TRANSITIONS.get(before, {}).get(tag, OTHER)


_STATES = TAGS + ("START",)
_VERB_KINDS = {
    "verb_ing": sorted(w for w, t in L.POS_MAP.items() if t == "VERB" and w.endswith("ing") and w not in L.VERB_BASES),
    "verb": sorted(w for w, t in L.POS_MAP.items() if t == "VERB" and (w in L.VERB_BASES or w.endswith("s"))),
}
_VERB_KINDS["verb_past"] = sorted(w for w, t in L.POS_MAP.items()
                                  if t == "VERB" and w not in _VERB_KINDS["verb_ing"] and w not in _VERB_KINDS["verb"])

# Word lists by class, the first that holds a word counts.
LISTS = {
    "relative": RELATIVES, "to": ["to"], "adp_sconj": PREPOSITION_OR_CLAUSE, "adp_adv": PREPOSITION_OR_ADVERB,
    "have_do": MAIN_OR_AUXILIARY, "pronoun": L.PRONOUNS, "determiner": L.DETERMINERS, "adposition": L.ADPOSITIONS,
    "conjunction": L.CONJUNCTIONS, "subordinator": L.SUBORDINATORS, "auxiliary": L.AUXILIARIES, "particle": L.PARTICLES,
    "interjection": L.INTERJECTIONS, "adverb": L.ADVERBS, "number": L.NUMBER_WORDS, "adjective": ADJECTIVES,
    "noun": ["%"], "punctuation": ["`"], **_VERB_KINDS,
}


LISTED = {w: name for name, words in reversed(LISTS.items()) for w in words}
CLASS_LETTERS = dict(zip(CANDIDATES, string.ascii_letters))
CHOICES = {CLASS_LETTERS[name]: [(c, TAGS.index(t)) for t, c in tags.items()] for name, tags in CANDIDATES.items()}
MOVES = [[cost(a, b) for b in TAGS] for a in _STATES]
PIECES = 1 << 16           # decoded pieces that a task remembers at most
PIECE_LENGTH = 32          # of this many tokens at most


def word_class(text: str, low: str, first: bool) -> str:
    """Class of a token (a key of CANDIDATES): word lists, then its shape and place."""
    if low in LISTED:
        return LISTED[low]
    if len(text) == 1:
        return {"P": "punctuation", "S": "symbol", "N": "number", "L": "noun"}.get(W.kind(text), "other")
    if W.numeric(text):
        return "number"
    capital = unicodedata.category(text[0]) == "Lu"
    if capital and not first:
        return "capital_inside"
    for ending, least in (("ly", 2), ("ed", 3), ("ing", 3)):
        if W.letters_and(low, ending, least):
            return ending
    if any(W.letters_and(low, ending, 2) for ending in ADJECTIVE_ENDINGS):
        return "adjectival"
    plural = W.letters_and(low, "s", 3) and low[-2] != "s"
    return ("capital_plural" if plural else "capital_first") if capital else "plural" if plural else "lower"


def cheapest(piece: list) -> str:
    """The cheapest sequence of letters through the candidates (cost, tag) of a piece."""
    last = [(MOVES[START][t] + c, t) for c, t in piece[0]]
    steps = []
    for choices in piece[1:]:
        best = [min((a + MOVES[u][t], u, k) for k, (a, u) in enumerate(last)) for _, t in choices]
        steps.append([k for _, _, k in best])
        last = [(b[0] + c, t) for b, (c, t) in zip(best, choices)]
    k = last.index(min(last))
    path = []
    for choices, back in zip(reversed(piece), [*reversed(steps), None]):
        path.append(LETTERS[choices[k][1]])
        k = back[k] if back else 0
    return "".join(reversed(path))


def best_path(choices: list) -> str:
    """Letters of an array of candidate arrays, piece by piece."""
    at = [k for k, c in enumerate(choices) if k == 0 or len(c) == 1]
    ends = at[1:] + [len(choices)]
    # the token at a cut belongs to the piece that it begins
    return "".join(cheapest(choices[a:b + 1])[:b - a] for a, b in zip(at, ends))


class Decoder:
    """Letters of the tags of a string of word classes; the pieces met are remembered."""

    def __init__(self):
        many = "".join(c for c, tags in CHOICES.items() if len(tags) > 1)
        self.cut = re.compile(rf"(.[{many}]*)(?=(.?))").findall
        self.seen = {}

    def piece(self, pair: tuple[str, str]) -> str:
        got = self.seen.get(pair)
        if got is None:
            piece, after = pair
            got = cheapest([CHOICES[c] for c in piece + after])[:len(piece)]
            if len(piece) <= PIECE_LENGTH:
                if len(self.seen) >= PIECES:
                    self.seen.clear()
                self.seen[pair] = got
        return got

    def path(self, classes: str) -> str:
        return "".join(map(self.piece, self.cut(classes)))


# --- heads ---------------------------------------------------------------------------
# Kinds of open heads: N nominal, W verb, U verb of a subordinate or infinitive clause, X auxiliary,
# T infinitive particle, A preposition, M modifier, S subordinator, C conjunction.

OPENS = {"DET": "M", "ADJ": "M", "NUM": "M", "ADP": "A", "AUX": "X"}
ALONE = {"X": "ROOT", "A": "prep", "S": "mark"}


class Heads:
    """The stack of open heads of one sentence, and the arcs so far."""

    def __init__(self, n: int):
        self.at, self.kinds = [], []
        self.dep, self.head = ["dep"] * n, list(range(n))
        self.loose = dict.fromkeys("MCXT", 0)

    def arc(self, i: int, dep: str, head: int) -> None:
        self.dep[i], self.head[i] = dep, head

    def push(self, i: int, kind: str) -> None:
        self.at.append(i)
        self.kinds.append(kind)
        if kind in self.loose:
            self.loose[kind] += 1

    def pop(self, n: int = 1) -> None:
        """The heads on top go (none of them loose, but for a conjunction that a nominal joins)."""
        for kind in self.kinds[-n:]:
            if kind in self.loose:
                self.loose[kind] -= 1
        del self.at[-n:], self.kinds[-n:]

    def top(self, k: int) -> str:
        return self.kinds[-k] if len(self.kinds) >= k else ""

    def take(self, wanted: str, above: str = "") -> list[tuple[int, str]]:
        """Takes out the heads of the wanted kinds, and those of the kinds ``above`` that lie above the last subordinator.

        Read from the top, as far as there are any."""
        left = sum(self.loose[k] for k in wanted + above)
        out, k, open_ = [], len(self.kinds) - 1, True
        while left and k >= 0:
            kind = self.kinds[k]
            if kind == "S" and open_:
                open_ = False
                left = sum(self.loose[w] for w in wanted)
            if kind in wanted or (open_ and kind in above):
                out.append((self.at.pop(k), self.kinds.pop(k)))
                self.loose[kind] -= 1
                left -= 1
            k -= 1
        return out

    def roots(self) -> None:
        """Auxiliaries that met no verb before a new clause are heads of their own."""
        for i, _ in self.take("X"):
            self.arc(i, "ROOT", i)

    def object(self) -> None:
        """A nominal above a verb is its object."""
        if self.top(1) == "N" and self.top(2) in ("W", "U"):
            self.arc(self.at[-1], "obj", self.at[-2])
            self.pop()

    def close(self, i: int, pos: str) -> None:
        """A preposition takes the nominal above it, unless the token goes on with that nominal."""
        if self.top(1) == "N" and self.top(2) == "A" and not (pos in ("NOUN", "PROPN") and self.at[-1] == i - 1):
            noun, prep = self.at[-1], self.at[-2]
            self.arc(noun, "pobj", prep)
            self.arc(prep, "prep", self.at[-3] if self.top(3) in ("N", "W", "U") else prep)
            self.pop(2)

    def nominal(self, i: int, pos: str) -> None:
        for j, _ in self.take("M"):
            self.arc(j, "mod", i)
        if self.top(1) == "N" and self.at[-1] == i - 1 and pos != "PRON":
            self.arc(i - 1, "compound", i)
            self.at[-1] = i
        elif self.top(1) == "C" and self.top(2) == "N":
            self.arc(i, "conj", self.at[-2])
            self.pop()
        else:
            self.push(i, "N")

    def verb(self, i: int) -> None:
        infinitive = False
        for j, kind in self.take("MC", above="XT"):
            if kind in "XT":
                self.arc(j, "aux", i)
                infinitive |= kind == "T"
        if infinitive:
            self.object()
            k = self.top(1)
            self.arc(i, *(("xcomp", self.at[-1]) if k in ("W", "U") else ("acl", self.at[-1]) if k == "N" else ("ROOT", i)))
            self.push(i, "U")
            return
        k1, k2 = self.top(1), self.top(2)
        subject = k1 == "N" or (k1 == "U" and k2 == "N")
        if k1 == "N" and k2 == "U" and self.top(3) == "N":
            self.arc(self.at[-1], "obj", self.at[-2])
            self.arc(self.at[-3], "nsubj", i)
            self.pop(3)
        elif k1 == "N":
            self.arc(self.at[-1], "nsubj", i)
            self.pop()
        elif subject:
            self.arc(self.at[-2], "nsubj", i)
            self.pop(2)
        sub = self.top(1) == "S"
        if sub:
            self.arc(self.at[-1], "nsubj" if not subject and self.top(2) == "N" else "mark", i)
            self.pop()
        k = self.top(1)
        verb = k in ("W", "U")
        if sub and k == "N":
            self.arc(i, "relcl", self.at[-1])
        elif verb and (sub or subject):
            self.arc(i, "ccomp", self.at[-1])
        elif sub:
            self.arc(i, "advcl", i)
        else:
            self.arc(i, *(("conj", self.at[-1]) if verb else ("ROOT", i)))
        if not sub and k == "W":
            self.pop()
        self.push(i, "U" if sub else "W")

    def read(self, i: int, pos: str, to: bool) -> None:
        self.close(i, pos)
        if pos in ("NOUN", "PROPN", "PRON"):
            self.nominal(i, pos)
        elif pos in OPENS:
            self.push(i, OPENS[pos])
        elif pos == "VERB":
            self.verb(i)
        elif pos == "SCONJ":
            self.roots()
            self.push(i, "S")
        elif pos == "PART" and to:
            self.push(i, "T")
        elif pos == "CCONJ":
            self.roots()
            self.object()
            if self.top(1) == "N":
                self.push(i, "C")
            self.arc(i, "cc", i)
        elif pos == "PUNCT":
            self.object()
            self.arc(i, "punct", i)
        elif pos == "ADV":
            self.arc(i, "advmod", i)

    def end(self) -> None:
        """Heads that nothing took."""
        for i, kind in zip(self.at, self.kinds):
            if kind not in "WUC":
                self.arc(i, ALONE.get(kind, "dep"), i)


def arcs_of(tags: list[str], to: list[bool]) -> tuple[list[str], list[int]]:
    """Label and head of every token of a sentence; ``to`` marks the lemma "to"."""
    heads = Heads(len(tags))
    for i, pos in enumerate(tags):
        heads.read(i, pos, to[i])
    heads.end()
    return heads.dep, heads.head


# --- Columns -------------------------------------------------------------------------

def _decoded(choices: pa.Array) -> pa.Array:
    return pa.array([best_path([[(x["c"], x["t"]) for x in c] for c in row]) for row in choices.to_pylist()], pa.string())


def decode(choices: Column) -> Column:
    """String of tag letters, one per token, of an array of candidate arrays (array<array<struct<c int, t int>>>)."""
    return F.when(choices.isNotNull(), F.arrow_udf(_decoded, "string")(F.coalesce(choices, F.array().cast("array<array<struct<c:int,t:int>>>"))))


def _attached(tokens: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("c", pa.int32()), ("d", pa.string()), ("h", pa.int32())]))
    out = []
    for row in tokens.to_pylist():
        arcs = row and zip(*arcs_of([t["pos"] for t in row], [t["lemma"] == "to" for t in row]))
        out.append(row and [{"c": i, "d": d, "h": h} for i, (d, h) in enumerate(arcs)])
    return pa.array(out, kind)


def attach(tokens: Column) -> Column:
    """array<struct<c int, d string, h int>>: one arc per token, in their order.

    ``tokens`` is an array of structs with ``i``, ``pos`` and ``lemma``.
    """
    return F.arrow_udf(_attached, "array<struct<c:int,d:string,h:int>>")(tokens)


def class_facts(text: str, low: str) -> tuple[str, str, bool]:
    """Letters of the class of a word that may begin the sentence, and of one inside; whether it is of word characters."""
    at = lambda first: CLASS_LETTERS[word_class(text, low, first)]
    return at(True), at(False), text[0].isalnum() or text[0] == "_"


def tagged(words: W.Words, decoder: Decoder, sentences: list[str | None]) -> pa.Array:
    """Tokens of each sentence with their tags and heads."""
    numbers, begins, (text, ws, low, stop, quote, opening, inside, wordlike) = words.cut(sentences)
    i, _ = W.places(begins)
    sequence, tags, deps, heads = numbers.tolist(), [], [], []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        mine = sequence[a:b]
        first = next((k for k, n in enumerate(mine) if wordlike[n]), -1) + 1
        path = decoder.path("".join([opening[n] for n in mine[:first]] + [inside[n] for n in mine[first:]]))
        names = [TAGS[ord(c) - ord(LETTERS[0])] for c in path]
        dep, head = arcs_of(names, [low[n] == "to" for n in mine])
        tags += names
        deps += dep
        heads += head
    lemmas: dict[tuple[int, str], str] = {}
    lemma = []
    for key in zip(sequence, tags):
        got = lemmas.get(key)
        if got is None:
            got = lemmas[key] = W.lemma_of(low[key[0]], key[1])
        lemma.append(got)
    return W.token_lists(begins, i, W.taken(text, numbers), W.taken(ws, numbers), pa.array(lemma, pa.string()), pa.array(tags, pa.string()),
                         pa.array(deps, pa.string()), np.array(heads, np.int32), W.taken(stop, numbers, pa.bool_()), W.taken(quote, numbers, pa.bool_()))


def _by_tags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    words, decoder = W.Words(class_facts), Decoder()
    for batch in batches:
        for spans in W.slices(batch):
            yield W.with_tokens(spans, lambda s: tagged(words, decoder, s))


def _tagged(spans: Column) -> Column:
    return W.per_sentence(_by_tags, spans)


def tagged_tokens_of(text: Column) -> Column:
    """The token array of a span: tags by ``decode``, heads by ``attach``."""
    return F.when(text.isNotNull(), F.get(_tagged(F.array(F.struct(F.lit(0).alias("sent"), text.alias("text")))), F.lit(0))["tokens"])


def tagged_sentences(text: Column) -> Column:
    """array<struct<sent int, text string, tokens array<token>>>, as ``annotate.sentences_tokens``."""
    return _tagged(numbered_sentences(text))
