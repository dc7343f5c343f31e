"""HTML to text with built-in functions: markup tokens, dropped subtrees, references decoded in one pass.

A page becomes an array of tokens: comments, declarations, script / style /
template elements, tags, and runs of text. Its text is the text tokens, joined by
one space. On pages that may hold an element to drop, a pass over the tokens keeps
the stack of open elements (void elements, ``p`` closed by block elements, end tags
that close what is still open inside) and gives the token intervals of the dropped
subtrees; their text is left out.

Character references are decoded from left to right, once, so that decoded text is
never decoded again: decimal and hexadecimal numbers of any length, the names of
the HTML standard, and the older names that need no semicolon. As in the standard,
numbers of the C1 range stand for windows-1252 characters, and 0, surrogates and
numbers beyond Unicode for U+FFFD.
"""

from __future__ import annotations

import html.entities
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .annotate import let
from .fixed import DROP_SELECTORS

VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Start tags that close an open ``p``.
BLOCKS = ("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
          "header hgroup hr main menu nav ol p pre search section summary table ul").split()
#: Elements whose text is not page text.
SILENT = ["script", "style", "template"]

# Quotes count in a tag only after '='. Every repetition is possessive, and the
# one group among them repeats once per attribute, so long texts and tags take no
# stack. What is not closed reaches to the end.
_TAG = r"""</?[A-Za-z][^>=]*+(?:=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+[^>=]*+)*+>"""
TOKEN = (r"(?is)<!--(?:.*?-->|.*+)"
         rf"|<({'|'.join(SILENT)})\b(?:.*?</\1\s*+>|.*+)"
         rf"|{_TAG}|<[!?/][^>]*+>|<.*+|[^<]++")
#: '<' that begins no markup.
STRAY = r"<(?![A-Za-z!?/])"

_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]*+;?)"
PIECE = rf"{_REFERENCE}|&|[^&]++"

# windows-1252 characters of 0x80 to 0x9F; five numbers name no character there and stay
_C1 = "".join(chr(c) for c in range(0x80, 0xA0))
_CP1252 = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&apos;": "'"}
#: Names that need no semicolon, longest first.
_OLD = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _named(ref: Column) -> Column:
    """The characters of a named reference, else NULL. The table is one folded map literal."""
    items = "\u0001".join(f"&{n}\u0002{c}" for n, c in html.entities.html5.items())
    table = F.str_to_map(F.lit(items), F.lit("\u0001"), F.lit("\u0002"))
    out = F.try_element_at(table, ref)
    for name, char in reversed(_COMMON.items()):
        out = F.when(ref == name, F.lit(char)).otherwise(out)
    return out


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*+([0-9a-fA-F]*+);?$", 1)
    wide = F.length(digits) > 7
    short = F.when(wide | (digits == ""), F.lit("0")).otherwise(digits)
    code = F.when(ref.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(short).cast("long")
    bad = wide | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(code)), 8, "0")), "UTF-32")
    return F.translate(char, _C1, _CP1252)


def decode_references(text: Column) -> Column:
    """Text with its character references decoded, left to right and once."""
    def piece(p: Column) -> Column:
        old = F.regexp_extract(p, rf"^&(?:{'|'.join(_OLD)})", 0)
        return (F.when(~p.startswith("&") | (F.length(p) == 1), p)
                .when(p.startswith("&#"), _numbered(p))
                .otherwise(F.coalesce(_named(p), F.when(old != "", F.concat(_named(old), F.substring(p, F.length(old) + 1, F.length(p)))), p)))

    # bound once: the text is an expression over the whole page, which would be computed at each place that reads it
    return let(text, lambda t: F.when(F.instr(t, "&") > 0, F.array_join(
        F.transform(F.regexp_extract_all(t, F.lit(PIECE), F.lit(0)), piece), "")).otherwise(t))


def _selects(tag: Column, selector: str) -> Column:
    """Whether a start tag has the id (``#id``) or the class (``.class``)."""
    v = re.escape(selector[1:])
    if selector.startswith("#"):
        return tag.rlike(rf"""(?is)\sid\s*=\s*(?:"{v}"|'{v}'|{v}(?=[\s/>]))""")
    return tag.rlike(rf"""(?is)\sclass\s*=\s*(?:"(?:[^"]*\s)?{v}(?:\s[^"]*)?"|'(?:[^']*\s)?{v}(?:\s[^']*)?'|{v}(?=[\s/>]))""")


def dropped(tokens: Column, selectors: list[str]) -> Column:
    """array<struct<a int, b int>>: token intervals of the subtrees of elements that a selector names."""
    names = F.array().cast("array<string>")
    cuts = F.array().cast("array<struct<a:int,b:int>>")
    state = F.struct(names.alias("open"), F.lit(0).alias("level"), F.lit(-1).alias("start"), F.lit(0).alias("i"), cuts.alias("cuts"))
    silent = rf"(?is)^<(?:{'|'.join(SILENT)})\b"

    def event(t: Column) -> Column:
        """What a tag opens, which open element it closes (its own, or a paragraph before a block), and if a selector names it."""
        def of(name):
            ends = t.startswith("</")
            opens = (name != "") & ~ends & ~name.isin(VOID) & ~t.rlike(silent)
            return let(F.struct(name.alias("name"), ends.alias("ends"), opens.alias("opens")), lambda e: F.struct(
                e["name"].alias("name"), e["ends"].alias("ends"), e["opens"].alias("opens"),
                F.when(e["ends"], e["name"]).when(e["opens"] & e["name"].isin(BLOCKS), F.lit("p")).otherwise(F.lit("")).alias("closes"),
                (e["opens"] & reduce(lambda x, y: x | y, [_selects(t, x) for x in selectors])).alias("hit")))
        return let(F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1)), of)

    def step(s: Column, e: Column) -> Column:
        from_top = F.when(e["closes"] != "", F.array_position(F.reverse(s["open"]), e["closes"]).cast("int")).otherwise(F.lit(0))
        left = let(from_top, lambda n: F.when(n > 0, F.slice(s["open"], F.lit(1), F.size(s["open"]) - n)).otherwise(s["open"]))

        def after(v: Column) -> Column:
            cut = F.when(v["cut"], F.concat(s["cuts"], F.array(F.struct(
                s["start"].alias("a"), F.when(e["ends"], s["i"]).otherwise(s["i"] - 1).alias("b"))))).otherwise(s["cuts"])
            level = F.when(v["starts"], F.size(v["open"]) + 1).when(v["cut"], F.lit(0)).otherwise(s["level"])
            return F.struct(F.when(e["opens"], F.concat(v["open"], F.array(e["name"]))).otherwise(v["open"]).alias("open"), level.cast("int").alias("level"),
                            F.when(v["starts"], s["i"]).otherwise(s["start"]).alias("start"), (s["i"] + 1).alias("i"), cut.alias("cuts"))

        return let(left, lambda k: let((s["level"] > 0) & (F.size(k) < s["level"]), lambda cut: let(F.struct(
            k.alias("open"), cut.alias("cut"), (e["hit"] & (cut | (s["level"] == 0))).alias("starts")), after)))

    # an element that is not closed reaches to the end
    def finish(s: Column) -> Column:
        return F.when(s["level"] > 0, F.concat(s["cuts"], F.array(F.struct(s["start"].alias("a"), s["i"].alias("b"))))).otherwise(s["cuts"])

    return F.aggregate(F.transform(tokens, event), state, step, finish)


def html_to_text(page: Column, drop: list[str] | tuple[str, ...] = tuple(DROP_SELECTORS)) -> Column:
    """Text of an HTML page: its text nodes joined by one space, without the subtrees of ``drop`` (``#id``, ``.class``).

    NULL stays NULL; a page without text gives an empty string."""
    tokens = F.regexp_extract_all(F.regexp_replace(page, STRAY, "&lt;"), F.lit(TOKEN), F.lit(0))
    text = lambda t: F.filter(t, lambda x: ~x.startswith("<"))
    nodes = text(tokens)
    if drop:
        def kept(t):
            return let(dropped(t, list(drop)), lambda cuts: F.filter(
                t, lambda x, i: ~x.startswith("<") & ~F.exists(cuts, lambda c: i.between(c["a"], c["b"]))))
        may = page.rlike("|".join(re.escape(s[1:]) for s in drop))
        nodes = F.when(may, let(tokens, kept)).otherwise(nodes)
    return decode_references(F.array_join(nodes, " "))
