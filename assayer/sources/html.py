"""HTML to paragraphs."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAKS = frozenset(("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "nav", "title"))
HIDDEN = frozenset(("script", "style"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BREAKS:
            self.out.append("\n")
        elif tag == "img" and (src := dict(attrs).get("src")):
            self.out.append(f"<img src={src}>")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def paragraphs_of(html: str | None) -> str:
    """Text by paragraphs, image sources kept; scripts and styles are left out."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def paragraphs(s: pd.Series) -> pd.Series:
    return s.map(paragraphs_of)


def paragraphs_native(c: Column) -> Column:
    """An approximation without Python: hidden parts out, block tags to line ends, other tags out, common entities read."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, r'(?i)<img[^>]*src="([^"]*)"[^>]*>', "\u0001$1\u0002")
    t = F.regexp_replace(t, r"(?i)</?(" + "|".join(sorted(BREAKS)) + r")(\s[^>]*)?/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.replace(F.replace(t, F.lit("\u0001"), F.lit("<img src=")), F.lit("\u0002"), F.lit(">"))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")
