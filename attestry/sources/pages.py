"""Raw pages to title, text and links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

LEFT_OUT = {"nav", "footer", "header", "aside", "script", "style"}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
EXTRACT_SCHEMA = "title string, text string, links array<struct<label:string,target:string>>"
NO_TEXT = "page has no text to extract"


class _Reader(HTMLParser):
    """Collects block text by line, links as ``[label](target)``, and the title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.links: list[dict] = []
        self.title: str | None = None
        self._skip = 0
        self._in_title = self._named = False
        self._link: tuple[str, int] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in LEFT_OUT:
            self._skip += 1
        elif tag == "title":
            # Only the first title is the page's.
            self._in_title, self._named = True, self.title is not None
            self.title = self.title or ""
        elif not self._skip:
            if tag in BLOCKS:
                self.lines.append("")
            elif tag == "a" and dict(attrs).get("href"):
                self._link = (dict(attrs)["href"], len(self.lines[-1]))

    def handle_endtag(self, tag):
        if tag in LEFT_OUT:
            self._skip = max(0, self._skip - 1)
        elif tag == "title":
            self._in_title = False
        elif not self._skip:
            if tag in BLOCKS:
                self.lines.append("")
                self._link = None
            elif tag == "a" and self._link:
                target, start = self._link
                self._link = None
                label = self.lines[-1][start:].strip()
                if label:
                    self.links.append({"label": label, "target": target})
                    self.lines[-1] = f"{self.lines[-1][:start]}[{label}]({target})"

    def handle_data(self, data):
        if self._in_title:
            self.title += "" if self._named else data
        elif not self._skip:
            self.lines[-1] += data


def _extract(html: str | None) -> tuple[str, str, list[dict]]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    tidy = lambda s: re.sub(r"\s+", " ", s).strip()
    lines = [line for line in map(tidy, reader.lines) if line]
    return tidy(reader.title or ""), "\n".join(lines), reader.links


def extract_html(html: Column) -> Column:
    """Struct (title, text, links) of a raw page; only the page itself goes to Python."""

    @F.pandas_udf(EXTRACT_SCHEMA)
    def extract(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_extract(p) for p in pages], columns=["title", "text", "links"])

    return extract.asNondeterministic()(html)


def page_extract(pages: DataFrame, *, html: str = "html", url: str = "url") -> DataFrame:
    """Add title (or host, or URL), text, links, success and error; drops the raw page."""
    read = pages.withColumn("_x", extract_html(F.col(html))).drop(html)
    host = F.regexp_extract(F.lower(F.col(url)), r"\A[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    title = F.coalesce(F.nullif(F.col("_x.title"), F.lit("")), F.nullif(host, F.lit("")), F.col(url))
    blank = is_blank(F.col("_x.text"))
    return read.select(
        *[c for c in read.columns if c != "_x"],
        title.alias("title"), F.col("_x.text").alias("text"), F.col("_x.links").alias("links"),
        (~blank).alias("success"), F.when(blank, NO_TEXT).otherwise("").alias("error"),
    )
