"""Links and metadata from web pages: one Arrow-batched parse gives all of them."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = T.StringType()
FACTS = T.StructType(
    [T.StructField(n, _TEXT) for n in ("title", "lang", "pdf_url")]
    + [T.StructField("meta", T.MapType(_TEXT, T.ArrayType(_TEXT))), T.StructField("links", T.ArrayType(T.StructType([T.StructField("href", _TEXT), T.StructField("text", _TEXT)])))]
)


class _Collector(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.meta, self.links, self.title, self.lang = base, {}, [], None, None
        self.open: list[str] | None = None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang")
        elif tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name.lower(), []).append(a.get("content", ""))
        elif tag == "a" and a.get("href"):
            self.open = []
            self.links.append([self.join(a["href"]), self.open])
        elif tag == "title":
            self.in_title = True

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        if self.open is not None:
            self.open.append(data)

    def join(self, href: str) -> str:
        try:
            return urljoin(self.base, href)
        except ValueError:
            return href


def parse(url: str | None, html: str | None) -> dict:
    found = _Collector(url or "")
    try:
        found.feed(html or "")
        found.close()
    except AssertionError:  # malformed declarations end the parse; what was read stays
        pass
    links = [{"href": h, "text": " ".join("".join(t).split())} for h, t in found.links]
    pdf = next(filter(None, found.meta.get("citation_pdf_url", [])), None) or next((x["href"] for x in links if x["href"].split("?")[0].lower().endswith(".pdf")), None)
    return {"title": found.title.strip() if found.title else None, "lang": found.lang, "pdf_url": found.join(pdf) if pdf else None, "meta": found.meta, "links": links}


@F.pandas_udf(FACTS)
def page_facts(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(u, h) for u, h in zip(url, html, strict=True)], columns=["title", "lang", "pdf_url", "meta", "links"])


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, text): links of each page in order, made absolute."""
    facts = pages.select("page_id", page_facts("url", "html").alias("f"))
    return facts.select("page_id", F.posexplode("f.links").alias("pos", "x")).select("page_id", "pos", "x.href", "x.text")


def page_meta(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, pdf_url, name, pos, content): a page's facts, a row for every value of its meta tags, in order within a name; one with a null name for a page without."""
    facts = pages.select("page_id", page_facts("url", "html").alias("f"))
    named = facts.select("page_id", "f.title", "f.lang", "f.pdf_url", F.explode_outer("f.meta").alias("name", "contents"))
    return named.select("page_id", "title", "lang", "pdf_url", "name", F.posexplode_outer("contents").alias("pos", "content"))
