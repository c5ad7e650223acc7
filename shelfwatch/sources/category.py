"""Landed category pages as product addresses: what a shop's own JSON says counts before what its links show."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import url_key
from . import nested

# Strategies from the most to the least trusted, and what pages say that load more or are empty.
STRATEGIES = ("shopify_json", "embedded_json", "json_ld", "html_links")
LOADS_MORE = re.compile("infinite|load more|data-next-url", re.I)
EMPTY = re.compile("no products|nothing found|empty", re.I)
PAGE_FIELDS = [("strategy", pa.int32()), ("urls", pa.list_(pa.string())), ("reported", pa.int64()), ("has_next", pa.bool_()), ("loads_more", pa.bool_()), ("says_empty", pa.bool_())]


class _Category(HTMLParser):
    def __init__(self):
        super().__init__()
        self.links: list[str] = []
        self.scripts: list[tuple[str, list[str]]] = []
        self.has_next = self._in = False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in ("a", "link") and "next" in a.get("rel", "").lower().split() and a.get("href"):
            self.has_next = True
        if tag == "a" and "/products/" in a.get("href", ""):
            self.links.append(a["href"])
        if tag == "script":
            self._in = a.get("type", "").strip().lower() in ("application/json", "application/ld+json")
            if self._in:
                self.scripts.append((a["type"].strip().lower(), []))

    def handle_endtag(self, tag):
        if tag == "script":
            self._in = False

    def handle_data(self, data):
        if self._in:
            self.scripts[-1][1].append(data)


def _loaded(text: str):
    try:
        return nested.loads(text)
    except ValueError:
        return None


def _address(product, base: str) -> str | None:
    if not isinstance(product, dict):
        return None
    for name, shape in (("url", "{}"), ("link", "{}"), ("handle", "/products/{}")):
        said = product.get(name)
        if isinstance(said, str) and said.strip():
            try:
                return urljoin(base, shape.format(said.strip()))
            except ValueError:
                return None
    return None


def _total(node: dict) -> int | None:
    said = (node.get(n) for n in ("products_count", "total"))
    return next((int(x) for x in said if isinstance(x, (int, float)) and not isinstance(x, bool) and 0 <= x < 1 << 53), None)


def parse_category(body: str | None, base: str | None) -> tuple:
    """The values of PAGE_FIELDS of a landed page; strategy is an index of STRATEGIES."""
    body, base = body or "", base or ""
    whole = _loaded(body) if body.lstrip()[:1] == "{" else None
    if isinstance(whole, dict) and isinstance(whole.get("products"), list):
        return 0, [u for u in (_address(p, base) for p in whole["products"]) if u], _total(whole), False, False, False
    page = _Category()
    page.feed(body)
    page.close()
    flags = page.has_next, bool(LOADS_MORE.search(body)), bool(EMPTY.search(body))
    parsed = [(kind, _loaded("".join(text))) for kind, text in page.scripts]
    for kind, value in parsed:
        for node in nested.objects(value) if kind == "application/json" else ():
            products = next((node[n] for n in ("products", "items") if isinstance(node.get(n), list)), None)
            if products is not None:
                return 1, [u for u in (_address(p, base) for p in products) if u], _total(node), *flags
    for kind, value in parsed:
        found = [_address(n, base) for n in nested.objects(value) if "Product" in (n.get("@type"), n.get("type"))] if kind != "application/json" else []
        if any(found):
            return 2, [u for u in found if u], None, *flags
    links = []
    for link in page.links:
        try:
            links.append(urljoin(base, link.strip()))
        except ValueError:
            continue
    return 3, links, None, *flags


def category_pages(pages: DataFrame) -> DataFrame:
    """(category, page) and PAGE_FIELDS of landed pages (category, page, url, body)."""
    pages = pages.select("category", "page", "url", "body")
    types = [t for _, t in PAGE_FIELDS]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                rows = [parse_category(b, u) for u, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]],
                                                 names=["category", "page", *[n for n, _ in PAGE_FIELDS]])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("category", "page"))
    return pages.mapInArrow(run, f"{kinds}, strategy int, urls array<string>, reported long, has_next boolean, loads_more boolean, says_empty boolean")


def category_products(parsed: DataFrame) -> DataFrame:
    """(category, url): the distinct product addresses of each category by its best strategy.

    The best strategy is that of the most trusted page; links are taken from all pages, anything else from the first
    page that has it.
    """
    best = parsed.groupBy("category").agg(F.min(F.struct("strategy", "page")).alias("best"))
    rows = parsed.join(best, "category").where("strategy = best.strategy and (strategy = 3 or page = best.page)")
    return rows.select("category", F.explode("urls").alias("said")).select("category", url_key(F.col("said")).alias("url")).where("url is not null").distinct()


def category_observations(parsed: DataFrame) -> DataFrame:
    """(category, strategy, discovered, reported_total, complete, truncated, confidence), a row a category.

    Links are complete if the last landed page has no next one and no page loads more, or if nothing is there and the
    first page says so; truncated if the last landed page has a next one. What JSON reports is complete if no more than
    that was found missing; linked data never is.
    """
    counts = category_products(parsed).groupBy("category").agg(F.count("*").alias("discovered"))
    got = parsed.groupBy("category").agg(F.min(F.struct("strategy", "page", "reported")).alias("best"), F.max_by("has_next", "page").alias("more"), F.bool_or("loads_more").alias("loads"),
                                         F.min_by("says_empty", "page").alias("empty"))
    got = got.join(counts, "category", "left").withColumn("discovered", F.coalesce("discovered", F.lit(0).cast("long")))
    kind, reported = F.col("best.strategy"), F.col("best.reported")
    links = (~F.col("more") & ~F.col("loads")) | ((F.col("discovered") == 0) & F.col("empty"))
    complete = F.when(kind == 3, links).when(kind == 2, False).otherwise(reported.isNull() | (reported <= F.col("discovered")))
    confidence = (F.when(kind == 0, F.when(reported.isNull(), 0.85).otherwise(0.95)).when(kind == 1, F.when(reported.isNull(), 0.8).otherwise(0.92)).when(kind == 2, 0.55)
                  .otherwise(F.when(links, 0.7).otherwise(0.4)))
    return got.select("category", F.array(*[F.lit(s) for s in STRATEGIES])[kind].alias("strategy"), "discovered", reported.alias("reported_total"), complete.alias("complete"),
                      ((kind == 3) & F.col("more")).alias("truncated"), confidence.alias("confidence"))
