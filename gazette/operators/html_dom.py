"""HTML -> text with a DOM walk, for subtree removal by CSS selector.

The native tier (``functions.text.html_to_text``) strips markup with
patterns; dropping a nested subtree such as ``.reader-header`` needs element
nesting, so this tier parses each page with the standard library's
``html.parser`` inside ``mapInPandas`` (Arrow batches, one parser per batch,
pages spread over all partitions). Supported selectors: ``#id`` and ``.class``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.fixed import DROP_SELECTORS

DEFAULT_DROP = tuple(DROP_SELECTORS)
_SKIP_TAGS = {"script", "style", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "param", "source", "track", "wbr"}


def page_text(html: str | None, drop=DEFAULT_DROP) -> str | None:
    """Text nodes joined by one space; dropped subtrees, scripts, styles and
    comments contribute nothing; entities are decoded."""
    if html is None:
        return None
    from html.parser import HTMLParser

    ids = {s[1:] for s in drop if s.startswith("#")}
    classes = {s[1:] for s in drop if s.startswith(".")}

    class Walker(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack: list[tuple[str, bool]] = []
            self.skip = 0
            self.parts: list[str] = []

        def handle_starttag(self, tag, attrs):
            if tag in _VOID:
                return
            a = dict(attrs)
            hit = (tag in _SKIP_TAGS or (a.get("id") in ids)
                   or bool(classes.intersection((a.get("class") or "").split())))
            self.stack.append((tag, hit))
            self.skip += hit

        def handle_endtag(self, tag):
            if not any(t == tag for t, _ in self.stack):
                return
            while self.stack:
                t, hit = self.stack.pop()
                self.skip -= hit
                if t == tag:
                    break

        def handle_data(self, data):
            if self.skip == 0:
                self.parts.append(data)

    w = Walker()
    w.feed(html)
    w.close()
    return " ".join(w.parts)


def html_text_dom(df: DataFrame, id_col: str = "id", html_col: str = "html",
                  drop=DEFAULT_DROP) -> DataFrame:
    """(id, text) through the DOM tier."""
    from .common import spread
    drop = tuple(drop)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            pdf["text"] = [page_text(h, drop) for h in pdf[html_col]]
            yield pdf[[id_col, "text"]]

    return spread(df.select(id_col, html_col)).mapInPandas(run, f"{id_col} {id_type}, text string")
