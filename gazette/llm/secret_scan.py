"""Secret scan: named patterns, and stretches of text whose characters look random.

Base spans come from three patterns over the whole text. The method adds
`entropy` spans: in every candidate string (a run of characters that keys are
made of, WINDOW or longer) a window of WINDOW characters slides along while the
counts of its characters are kept up to date, one in and one out, so the Shannon
entropy of every window costs two updates. Hex and base64 runs have thresholds
of their own; overlapping windows above it join into one span. So have keys of
other alphabets (KEYS: lower or upper case, with or without digits, both, base64
with its signs), by the characters a window holds; runs of SHORTEST to WINDOW
characters are one window. As smaller alphabets reach the entropy of long words,
such a window's letters and changes of case must also be nearer to chance than to
text (`_ODDS`, `_TURN`, `_STAY`, in bits). An allow-list cuts out of a span what is
random-looking but public (UUIDs, placeholders, alphabets, checksums of
subresources); what is left on either side is a span if it reaches the entropy
by itself. Words beside a span do not matter. Both thresholds are low quantiles of random strings, so a few keys
in a hundred of the least length are still missed, and a rare long word is found.

Spans are code points, end exclusive. Defined cases: null text is empty and has
no spans; repeated rows are scanned each; an empty table gives an empty result;
all other columns pass through. Scale: row by row, no shuffle; memory is one
Arrow batch of texts.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.util import free_name, load, python_column

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_LONG = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "entropy"]

#: Characters of the sliding window.
WINDOW = 20
#: Class: its runs, least bits a character, least digits and letters in a window.
CLASSES = [(re.compile(r"[0-9A-Fa-f]{20,}"), 3.0, 3), (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.8, 2)]
#: What looks random but is no secret: UUIDs, placeholders, alphabets, subresource checksums.
ALLOW = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?i:example|placeholder|changeme|dummy|sample|xxxx|your[_-])"
                   r"|(?i:abcdefgh|ijklmnop|qrstuvwx)|0123456789|1234567890|sha(?:256|384|512)-[A-Za-z0-9+/=]*")
#: Characters by which an allowed value may reach beyond a span.
_LONGEST = 40
_TERM = [n * math.log2(n) if n else 0.0 for n in range(WINDOW + 1)]

#: Least length of a key; shorter than WINDOW, the whole run is its window.
SHORTEST = 16
_SHORT_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,19}(?![0-9A-Za-z])")
_PLAIN, _SIGNED = re.compile(r"[A-Za-z0-9]{16,}"), re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Bits by which a letter speaks for chance: its share in (Western European) text against 1 / 26.
_SHARES = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.0, 1.6, 3.4, 4.5, 14.5, 1.5, 1.9, 3.2, 7.3, 0.4, 0.7, 4.7, 2.9, 7.8, 6.0, 2.4, 0.6, 6.6, 7.0, 7.0,
                                                  4.8, 1.4, 1.2, 0.3, 0.9, 0.6)))
_ODDS = {k: math.log2(sum(_SHARES.values()) / 26 / v) for c, v in _SHARES.items() for k in (c, c.upper())}
#: The same of two neighbours: of different kinds, of one kind, one of them a sign.
_TURN, _STAY, _SIGN = 2.0, -0.85, -1.0
#: Kinds of characters as bits: lower case, upper case, digit, sign.
_KIND = {chr(c): 1 if c >= 97 else 2 if c >= 65 else 4 for c in [*range(48, 58), *range(65, 91), *range(97, 123)]} | dict.fromkeys("+/_=-", 8)
#: By the kinds in a window, for SHORTEST to WINDOW characters: least entropy (lowest 1 % of random strings, 8,000 each) and least bits
#: for chance (lowest 2 %, of one case alone 5 %). Upper case with digits is fitted to base32.
KEYS = {
    1: [(2.98, -12.0), (3.05, -12.9), (3.08, -13.1), (3.14, -13.8), (3.2, -14.1)],
    2: [(2.98, -12.4), (3.05, -12.7), (3.08, -13.4), (3.17, -13.7), (3.24, -14.4)],
    3: [(3.28, 2.7), (3.38, 2.8), (3.41, 3.9), (3.51, 4.5), (3.58, 5.3)],
    5: [(3.14, -3.0), (3.21, -3.1), (3.28, -2.9), (3.32, -2.6), (3.38, -2.2)],
    6: [(3.07, -5.7), (3.17, -5.7), (3.23, -5.9), (3.28, -5.7), (3.34, -6.4)],
    7: [(3.37, 7.4), (3.45, 8.4), (3.5, 9.2), (3.57, 10.0), (3.64, 11.1)],
    15: [(3.4, 2.5), (3.45, 3.1), (3.57, 4.0), (3.57, 4.8), (3.64, 6.1)],
}
#: Least entropy of hex runs of SHORTEST to WINDOW - 1 characters.
SHORT_HEX = [2.68, 2.72, 2.81, 2.83]


def _pair(a: str, b: str) -> float:
    x, y = _KIND[a], _KIND[b]
    return _SIGN if 8 in (x, y) else _TURN if x != y else _STAY


def _key_windows(run: str, signed: bool) -> list[list[int]]:
    """Joined windows of `run` that look like keys of their alphabet; only those with a sign, or only those without."""
    w = min(WINDOW, len(run))
    limits = {k: ((math.log2(w) - e) * w, least) for k, v in KEYS.items() if (k >= 8) == signed for e, least in [v[w - SHORTEST]]}
    counts, kinds = dict.fromkeys(run, 0), {1: 0, 2: 0, 4: 0, 8: 0}
    total, bits, out = 0.0, 0.0, []
    for i, c in enumerate(run):
        if i >= w:
            gone = run[i - w]
            n = counts[gone]
            total += _TERM[n - 1] - _TERM[n]
            counts[gone] = n - 1
            kinds[_KIND[gone]] -= 1
            bits -= _ODDS.get(gone, 0.0) + _pair(gone, run[i - w + 1])
        n = counts[c]
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        kinds[_KIND[c]] += 1
        bits += _ODDS.get(c, 0.0) + (_pair(run[i - 1], c) if i else 0.0)
        if i >= w - 1:
            most, least = limits.get(sum(k for k, n in kinds.items() if n), (-1.0, 0.0))
            if total <= most and bits >= least:
                a = i - w + 1
                if out and a < out[-1][1]:
                    out[-1][1] = i + 1
                else:
                    out.append([a, i + 1])
    return out


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Stretches of candidate strings whose windows reach their class's entropy, without what is allowed in them."""
    spans = []
    for a, z in _dense_spans(text):
        at = a
        # an allowed value may begin before the span (a UUID's first digits, a checksum's name)
        for m in ALLOW.finditer(text, max(0, a - _LONGEST), min(len(text), z + _LONGEST)):
            if m.end() > at and m.start() < z:
                if m.start() > at:
                    spans.append((at, m.start(), True))
                at = m.end()
        if at < z:
            spans.append((at, z, at > a))
    out = []
    for a, z, cut in spans:
        out += [(a + x, a + y) for x, y in _dense_spans(text[a:z])] if cut else [(a, z)]
    return out


def _dense_spans(text: str) -> list[tuple[int, int]]:
    """Joined stretches of candidate strings whose windows reach their class's entropy."""
    out = []
    for runs, least, few in CLASSES:
        for run in runs.finditer(text):
            out += [(run.start() + a, run.start() + z) for a, z in _windows(run.group(), least, few)]
    for runs, signed in ((_PLAIN, False), (_SIGNED, True)):
        for run in runs.finditer(text):
            out += [(run.start() + a, run.start() + z) for a, z in _key_windows(run.group(), signed)]
    for run in _SHORT_HEX.finditer(text):
        if _short_hex(run.group()):
            out.append(run.span())
    spans = []
    for a, z in sorted(out):
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(z, spans[-1][1])
        else:
            spans.append([a, z])
    return [(a, z) for a, z in spans]


def _short_hex(run: str) -> bool:
    """Whether a hex run shorter than WINDOW looks random: SHORT_HEX bits, and digits and letters as in a window."""
    entropy = math.log2(len(run)) - sum(_TERM[run.count(c)] for c in set(run)) / len(run)
    digits = sum(c.isdigit() for c in run)
    return entropy >= SHORT_HEX[len(run) - SHORTEST] and min(digits, len(run) - digits) >= CLASSES[0][2]


def _windows(run: str, least: float, few: int) -> list[list[int]]:
    """Joined windows of `run` with `least` bits a character, and `few` digits and letters at least."""
    counts: dict[str, int] = {}
    total, digits, letters, out = 0.0, 0, 0, []
    limit = (math.log2(WINDOW) - least) * WINDOW + 1e-9
    for i, c in enumerate(run):
        if i >= WINDOW:
            gone = run[i - WINDOW]
            n = counts[gone]
            total += _TERM[n - 1] - _TERM[n]
            counts[gone] = n - 1
            digits, letters = digits - gone.isdigit(), letters - gone.isalpha()
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        digits, letters = digits + c.isdigit(), letters + c.isalpha()
        if i >= WINDOW - 1 and total <= limit and digits >= few and letters >= few:
            a = i - WINDOW + 1
            if out and a < out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([a, i + 1])
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then kind."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    # a run of 32 or more is the leftmost match of the open pattern wherever it begins
    spans += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    base = [(a, z) for a, _, z in spans]
    spans += [(a, 3, z) for a, z in entropy_spans(text) if not any(b <= a and z <= y for b, y in base)]
    return [(KINDS[k], a, z) for a, k, z in sorted(spans)]


def with_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """`docs` with a struct: kinds, starts and ends of the secrets in the text."""
    def scan(b):
        found = [find_secrets(t) for t in b.column(0).to_pylist()]
        return {k: [[s[i] for s in f] for f in found] for i, k in enumerate(("kinds", "starts", "ends"))}

    fields = T.StructType([T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("starts", T.ArrayType(T.LongType())),
                           T.StructField("ends", T.ArrayType(T.LongType()))])
    return python_column(docs, [text], name, fields, scan)


def masked(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every secret replaced; overlapping spans get one mask."""
    out, at, end = [], 0, -1
    for _, a, z in find_secrets(text):
        if a >= end:
            out += [text[at:a], mask]
        end = max(z, end)
        at = end
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(docs: DataFrame, text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """`docs` with secrets masked in the text, and the character count (if there is such a column) kept true."""
    c = free_name(docs, "masked")
    out = python_column(docs, [text], c, T.StructType([T.StructField("text", T.StringType())]),
                        lambda b: {"text": [masked(t) for t in b.column(0).to_pylist()]})
    new = {text: F.col(f"{c}.text")}
    if chars in docs.columns:
        new[chars] = F.when(F.col(f"{c}.text") == F.col(text), F.col(chars)) \
            .otherwise(F.length(f"{c}.text").cast(docs.schema[chars].dataType))
    return out.select(*[new.get(x, F.col(f"`{x}`")).alias(x) for x in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of the secrets of every document."""
    s = with_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform(F.arrays_zip("secrets.kinds", "secrets.starts", "secrets.ends"),
                        lambda x: F.struct(x["kinds"].alias("kind"), F.concat_ws(":", x["kinds"], x["starts"], x["ends"]).alias("span")))
    out = s.select("doc_id", spans.alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["span"]), ",")
    return out.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.filter("s", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256"),
                      joined("s").alias("spans"), count(KINDS[3]))
