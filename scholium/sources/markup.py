"""Text of HTML and XML full texts, as an Arrow function over the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: elements whose text is no part of the article
SKIPPED = {"html": ("script", "style", "nav", "header", "footer"), "jats": ("fig", "table-wrap", "supplementary-material"), "elsevier": ()}
BODIES = {"html": (), "jats": ("body",), "elsevier": ("ce:sections", "body", "rawtext")}
PARAGRAPHS = {"html": None, "jats": "p", "elsevier": "ce:para"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MOST_CHARS, LEAST_CHARS = 200_000, 100


class _Texts(HTMLParser):
    """Text nodes outside the skipped elements, with the elements that hold them."""

    def __init__(self, skipped: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.skipped, self.open, self.found = skipped, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not any(t in self.skipped for t in self.open):
            self.found.append((frozenset(self.open), data.strip()))


def text_of(markup: str | None, kind: str) -> str | None:
    """Text nodes joined by newlines; of XML, the first kind of body with over 100 characters, else the paragraphs."""
    if not markup:
        return None
    parser = _Texts(SKIPPED[kind])
    parser.feed(markup)
    parser.close()
    if kind == "html":
        return "\n".join(t for _, t in parser.found) or None
    for part in (*BODIES[kind], PARAGRAPHS[kind]):
        text = "\n".join(t for tags, t in parser.found if part in tags)
        if len(text) > LEAST_CHARS:
            return text[:MOST_CHARS]
    return None


def extractor(kind: str):
    """Column function: markup to text."""

    @F.pandas_udf(StringType())
    def extract(markup: pd.Series) -> pd.Series:
        return markup.map(lambda m: text_of(m, kind), na_action="ignore")

    return extract
