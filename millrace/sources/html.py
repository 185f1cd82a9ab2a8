"""Visible text of pages through the standard library's HTML parser, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is not shown, and those that hold the main text.
HIDDEN = frozenset("script style nav footer header aside noscript iframe form template".split())
MAIN = frozenset("main article section p h1 h2".split())
VOID = frozenset("br img meta link input hr area base col embed source track wbr".split())


class _Text(HTMLParser):
    def __init__(self, only_main: bool):
        super().__init__(convert_charrefs=True)
        self.only_main, self.hidden, self.main, self.parts = only_main, 0, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.hidden += tag in HIDDEN
        self.main += tag in MAIN

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN and self.hidden > 0
        self.main -= tag in MAIN and self.main > 0

    def handle_data(self, data):
        if not self.hidden and (self.main or not self.only_main):
            self.parts.append(data)


def text_of(page: str | None, only_main: bool = False, least: int = 3) -> str | None:
    """The shown pieces of a page with at least ``least`` characters, white space squeezed, joined by spaces."""
    if page is None:
        return None
    p = _Text(only_main)
    p.feed(page)
    p.close()
    pieces = (" ".join(x.split()) for x in p.parts)
    return " ".join(x for x in pieces if len(x) >= least)


def main_lines(page: str | None) -> str | None:
    """The main text as the crawler keeps it: no short lines, none with addresses."""
    if page is None:
        return None
    p = _Text(True)
    p.feed(page)
    p.close()
    lines = (" ".join(x.split()) for x in p.parts)
    return "\n".join(x for x in lines if len(x) >= 20 and "http" not in x and "advert" not in x.lower())


def _shown(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)


def _main(pages: pd.Series) -> pd.Series:
    return pages.map(main_lines)


def visible_text(page: Column) -> Column:
    return F.pandas_udf(_shown, "string")(page)


def main_text(page: Column) -> Column:
    return F.pandas_udf(_main, "string")(page)
