"""Catalogues and notices from web pages and list responses, by Arrow batches; a page is the unit of work."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import columns as C

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What names a consent banner, and headings that belong to one.
BANNER, BANNER_HEADING = re.compile("onetrust|ot-pc|ot-sdk|cookie|consent", re.I), re.compile("クッキー|Cookie")
LIST_PAGE = "noticeAnnouncementsList array<struct<id:string,title:string,releaseDate:string,url:string,category:string,competition:string,classification:string>>, totalCount bigint"


class Page(HTMLParser):
    """Headings, list links with what they stand under, all links and the text of a page, in its order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, str]] = []  # tag, id and classes
        self.section, self.group = "", ""
        self.held: list[tuple[str, list[str]]] = []  # what is being read
        self.links: list[dict] = []
        self.link: dict | None = None
        self.words: list[tuple[bool, str]] = []

    def classes(self, name: str) -> bool:
        return any(tag == "div" and name in classes.split() for tag, _, classes in self.open)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in VOID:
            return
        self.open.append((tag, a.get("id", ""), a.get("class", "")))
        own = a.get("class", "").split()
        if tag in ("h1", "h2"):
            self.held.append(("section", []))
        elif tag == "div" and "toggle-accordion" in own:
            self.group = ""
        elif tag == "div" and "_header" in own and not self.group:
            self.held.append(("group", []))
        elif tag == "a" and "href" in a:
            banner = any(BANNER.search(f"{i} {c}") for _, i, c in self.open)
            self.link = {"href": a["href"], "section": self.section, "group": self.group, "listed": self.classes("toggle-accordion") and not banner, "main": any(t == "main" for t, _, _ in self.open), "text": [], "_title": None, "_date": None}
        elif tag == "p" and self.link is not None:
            for name in {"_title", "_date"} & set(own):
                if self.link[name] is None:
                    self.link[name] = []
                    self.held.append((name, self.link[name]))

    def handle_data(self, data):
        self.words.append((any(t == "main" for t, _, _ in self.open), data))
        if self.held:
            self.held[-1][1].append(data)
        if self.link is not None:
            self.link["text"].append(data)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        del self.open[at:]
        text = lambda parts: " ".join("".join(parts).split())
        if self.held and (self.held[-1][0] == {"h1": "section", "h2": "section", "div": "group"}.get(tag) or tag == "p" and self.held[-1][0] in ("_title", "_date")):
            name, parts = self.held.pop()
            if name == "section" and text(parts) and not BANNER_HEADING.search(text(parts)):
                self.section = text(parts)
            elif name == "group":
                self.group = text(parts)
        if tag == "a" and self.link is not None:
            self.links.append(self.link)
            self.link = None

    @classmethod
    def read(cls, html: str | None) -> Page:
        page = cls()
        page.feed(html or "")
        page.close()
        return page


def _parsed(pages: DataFrame, schema: str, rows) -> DataFrame:
    """rows(url, page): tuples of the schema's columns after the first, which is the page's address."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(u, *r) for u, h in zip(batch["url"], batch["html"], strict=True) for r in rows(u, Page.read(h))], columns=names)

    return pages.select("url", "html").mapInPandas(run, schema)


def listing(pages: DataFrame) -> DataFrame:
    """Catalogue entries of pages (url, html): page_url, place, section, group, title, size, pdf_url, upload_date, doc_id. Links to
    files inside accordions count, each address once a page, a consent banner's not."""

    def rows(url, page):
        seen, out = set(), []
        for x in page.links:
            address = urljoin(url or "", x["href"])
            if x["listed"] and ".pdf" in x["href"].lower() and address not in seen:
                seen.add(address)
                one = lambda parts: " ".join("".join(parts).split())
                out.append((len(out), x["section"], x["group"], one(x["text"] if x["_title"] is None else x["_title"]), one(x["_date"] or []), address))
        return out

    own = _parsed(pages, "page_url string, place int, section string, group string, raw string, date string, pdf_url string", rows)
    parts = C.title_and_size(F.col("raw"))
    return own.select("page_url", "place", "section", "group", parts["title"].alias("title"), parts["size"].alias("size"), "pdf_url", C.japanese_date(F.col("date")).alias("upload_date"), C.document_id(F.col("pdf_url")).alias("doc_id"))


def updates(pages: DataFrame) -> DataFrame:
    """pdf_url, upload_date of file links with a date that stand outside accordions; the first of an address counts."""

    def rows(url, page):
        return [(k, urljoin(url or "", x["href"]), "".join(x["_date"])) for k, x in enumerate(page.links) if not x["listed"] and x["_date"] and ".pdf" in x["href"].lower()]

    own = _parsed(pages, "page_url string, place int, pdf_url string, date string", rows).withColumn("upload_date", C.japanese_date(F.col("date"))).where("upload_date is not null")
    return own.groupBy("pdf_url").agg(F.min_by("upload_date", F.struct("page_url", "place")).alias("upload_date"))


def notices(responses: DataFrame, base: str, json_col: str = "value") -> DataFrame:
    """Entries of list responses (JSON text): id, title, date, url, category, competitions, classifications, rule_change, total."""
    own = responses.select(F.from_json(json_col, LIST_PAGE).alias("r")).select(F.coalesce("r.totalCount", F.lit(0)).alias("total"), F.explode("r.noticeAnnouncementsList").alias("n"))
    text = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    address = F.coalesce("n.url", F.lit(""))
    whole = F.when(address.rlike("^[A-Za-z]+://"), address).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(address, F.lit("/"))))
    kinds = C.comma_list(F.col("n.classification"))
    return own.select(F.coalesce(F.nullif("n.id", F.lit("")), address).alias("id"), text("n.title").alias("title"), C.japanese_date(F.col("n.releaseDate")).alias("date"), whole.alias("url"), text("n.category").alias("category"), C.comma_list(F.col("n.competition")).alias("competitions"), kinds.alias("classifications"), C.is_rule_change(kinds).alias("rule_change"), "total")


def details(pages: DataFrame) -> DataFrame:
    """url, notice_no, attachments (text, url, comparison) of notices: from the page's main part, or all of it without one."""

    def rows(url, page):
        main = any(x["main"] for x in page.links) or any(m for m, _ in page.words)
        seen, files = set(), []
        for x in page.links:
            address = urljoin(url or "", x["href"])
            if (x["main"] or not main) and ".pdf" in x["href"].lower() and address not in seen:
                seen.add(address)
                files.append({"text": " ".join(" ".join(x["text"]).split()), "url": address})
        return [(" ".join(" ".join(w for m, w in page.words if m or not main).split()), files)]

    own = _parsed(pages, "url string, text string, files array<struct<text:string,url:string>>", rows)
    files = F.transform("files", lambda f: F.struct(f["text"].alias("text"), f["url"].alias("url"), C.is_comparison(f["text"]).alias("comparison")))
    return own.select("url", C.notice_number(F.col("text")).alias("notice_no"), files.alias("attachments"))


def links(pages: DataFrame) -> DataFrame:
    """page_url, place, href, text of every link, in order."""
    return _parsed(pages, "page_url string, place int, href string, text string", lambda url, page: [(k, x["href"], " ".join("".join(x["text"]).split())) for k, x in enumerate(page.links)])


def downloads(files: DataFrame) -> DataFrame:
    """path, sha256, bytes, is_pdf of binary files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"), (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))
