"""Text scalar functions: line filter, title cleanup, polish."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import READER_TITLE_SEPARATOR
from .html import html_to_text

def keep_sentence_lines(text: Column) -> Column:
    """Keep non-empty lines containing a '.', joined by one space."""
    lines = F.split(text, "\n")
    return F.array_join(
        F.filter(lines, lambda l: (F.length(l) > 0) & (F.instr(l, ".") > 0)), " ")


def html_to_clean_text(html: Column) -> Column:
    return keep_sentence_lines(html_to_text(html))


def reader_title(title: Column) -> Column:
    """Text before the first separator, trailing whitespace removed."""
    return F.regexp_replace(F.substring_index(title, READER_TITLE_SEPARATOR, 1), r"(?U)\s+\z", "")


def fill(template: str, **values: Column) -> Column:
    """``'a {x} b'`` with Column values -> concat of literals and columns."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            parts.append(values[piece[1:-1]])
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def polish(text: Column) -> Column:
    """Result text: trimmed, first char upper-cased, no space before , ! .,
    runs of whitespace collapsed, final '.' ensured. Empty -> NULL (dropped)."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    t = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))
    t = F.regexp_replace(t, r"(?U)\s+([,!.])", "$1")
    t = F.regexp_replace(t, r"(?U)\s\s+", " ")
    t = F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))
    return F.when(F.length(F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")) > 0, t)
