"""Landed product pages as observations and items: linked data first, then embedded JSON, then what the page's own tags say."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import quoted
from ..functions.columns import url_key
from . import nested

#: What a page's own tags say, by the way it is said: a property or itemprop of a meta tag or element, or a data attribute.
PROPERTIES = {"og:title": "title", "og:image": "image"}
ITEMPROPS = {"price": "price", "pricecurrency": "currency", "availability": "availability"}
DATA = {"data-price": "price", "data-currency": "currency", "data-availability": "availability"}
FIELDS = [("noindex", pa.bool_()), ("canonical_raw", pa.string()), ("schema_present", pa.bool_()), ("title", pa.string()), ("image_raw", pa.string()), ("base_price", pa.string()), ("sale_price", pa.string()),
          ("currency", pa.string()), ("availability", pa.string()), ("strategy", pa.string()), ("links", pa.int32())]
FIELD_TYPES = "noindex boolean, canonical_raw string, schema_present boolean, title string, image_raw string, base_price string, sale_price string, currency string, availability string, strategy string, links int"


class _Page(HTMLParser):
    """What of a page matters: robots, the first canonical link, scripts of data, tags' own words, headings and links."""

    def __init__(self):
        super().__init__()
        self.robots, self.canonical, self.links = [], None, 0
        self.scripts: dict[str, list[str]] = {"application/ld+json": [], "application/json": []}
        self.said: dict[tuple[str, str], str] = {}  # (way, field): the first that is said
        self.texts: dict[str, list[str]] = {}  # of the first h1, the first element of class price, the title
        self._script, self._open = None, []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        note = lambda way, field, value: self.said.setdefault((way, field), value)
        if tag == "meta":
            if a.get("name") in ("robots", "googlebot"):
                self.robots.append(a.get("content", ""))
            if a.get("property") in PROPERTIES and "content" in a:
                note("meta", PROPERTIES[a["property"]], a["content"])
        elif tag == "link" and a.get("rel") == "canonical" and self.canonical is None:
            self.canonical = a.get("href", "")
        elif tag == "script":
            self._script = self.scripts.get(a.get("type", ""))
            if self._script is not None:
                self._script.append("")
        elif tag == "a" and "href" in a:
            self.links += 1
        elif tag == "img":
            note("img", "image", a.get("src", ""))
        if a.get("itemprop", "").lower() in ITEMPROPS and "content" in a:
            note("itemprop", ITEMPROPS[a["itemprop"].lower()], a["content"])
        for name, field in DATA.items():
            if name in a:
                note("data", field, a[name])
        for name in ("h1", "title"):
            if tag == name:
                self._begin(name, tag)
        if "price" in a.get("class", "").split():
            self._begin("price", tag)

    def _begin(self, name: str, tag: str) -> None:
        if name not in self.texts:
            self.texts[name] = []
            self._open.append((name, tag))

    def handle_endtag(self, tag):
        if tag == "script":
            self._script = None
        self._open = [(n, t) for n, t in self._open if t != tag]

    def handle_data(self, data):
        if self._script is not None:
            self._script[-1] += data
        for name, _ in self._open:
            self.texts[name].append(data)


def _text(value) -> str | None:
    """The first text that a JSON value says: trimmed, numbers as scripts print them, of lists the first member; null if nothing."""
    while isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    return str(value) if isinstance(value, int) else (value.strip() or None) if isinstance(value, str) else None


def _is_product(node: dict) -> bool:
    kind = node.get("type") if node.get("@type") is None else node["@type"]
    return kind == "Product" or isinstance(kind, list) and "Product" in kind


def parse(html: str | None, robots_header: str | None = None) -> tuple:
    """The values of FIELDS of a page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    noindex = bool(re.search("noindex", ",".join([robots_header or "", *page.robots]), re.I))
    linked = nested.first(page.scripts["application/ld+json"], _is_product)
    node, strategy = (linked, "json_ld") if linked is not None else (nested.first(page.scripts["application/json"], _is_product), "embedded_json")
    if node is not None:
        offer = node.get("offers")
        while isinstance(offer, list):
            offer = offer[0] if offer else None
        offer = offer if isinstance(offer, dict) else {}
        either = lambda a, b: _text(a) if _text(a) is not None else _text(b)
        got = (either(node.get("name"), node.get("title")), _text(node.get("image")), either(offer.get("price"), node.get("price")), _text(offer.get("sale_price")),
               either(offer.get("priceCurrency"), node.get("priceCurrency")), either(offer.get("availability"), node.get("availability")), strategy)
    else:
        said = lambda field, *ways: next((page.said[w, field] for w in ways if (w, field) in page.said), None)
        words = lambda name: "".join(page.texts.get(name, [])).strip()
        title, price = said("title", "meta"), said("price", "itemprop", "data")
        got = ((words("h1") if title is None else title) or None, said("image", "meta", "img") or None, (words("price") if price is None else price) or None, None,
               said("currency", "itemprop", "data"), said("availability", "itemprop", "data"), "html")
    return noindex, page.canonical or None, linked is not None, *got, page.links


def absolute(base: str | None, said: str | None) -> str | None:
    """said as an address, seen from base, host in lower case and a path at least; null if it is none."""
    if not said:
        return None
    try:
        parts = urlsplit(urljoin(base or "", said.strip()))
        if parts.scheme not in ("http", "https"):
            return urlunsplit(parts) if parts.scheme else None
        host = parts.netloc.lower()
        return urlunsplit((parts.scheme, host, parts.path or "/", parts.query, parts.fragment)) if host else None
    except ValueError:
        return None


def observations(pages: DataFrame) -> DataFrame:
    """What is seen of landed pages: pages without html and robots_header, with FIELDS' values and indexability, canonical_url, canonical_state, schema_valid, image_url, effective_price.

    pages: url, final_url, http_status, robots_header (null: none), html and others. A page that couldn't be fetched has
    a null html: unknown, without a canonical address, schema or price. canonical_state is missing, self, different or
    invalid, compared by key.
    """
    rest = [c for c in pages.columns if c not in ("html", "robots_header")]
    at = {c: pages.columns.index(c) for c in pages.columns}

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                base, rows = part.column(at["final_url"]).to_pylist(), [parse(h, r) for h, r in zip(part.column(at["html"]).to_pylist(), part.column(at["robots_header"]).to_pylist(), strict=True)]
                columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)]
                links = [pa.array([absolute(b, r[k]) for b, r in zip(base, rows, strict=True)], pa.string()) for k in (1, 4)]
                yield pa.RecordBatch.from_arrays([*[part.column(at[c]) for c in rest], part.column(at["html"]).is_valid(), *columns, *links], names=[*rest, "fetched", *[n for n, _ in FIELDS], "canonical_url", "image_url"])

    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest]
    found = pages.mapInArrow(run, ", ".join([*fields, "fetched boolean", FIELD_TYPES, "canonical_url string", "image_url string"]))
    fine = F.col("http_status").between(200, 399)
    indexable = F.when(~F.col("fetched"), "unknown").when(F.col("noindex"), "noindex").when(fine, "indexable").otherwise("unknown")
    own, said = url_key(F.col("final_url")), url_key(F.col("canonical_url"))
    state = F.when(F.col("canonical_url").isNull(), "missing").when(said.isNull(), "invalid").when(said == own, "self").otherwise("different")
    price = F.coalesce("sale_price", "base_price")
    valid = F.col("schema_present") & (F.col("title").isNotNull() | price.isNotNull() | F.col("availability").isNotNull())
    return found.withColumns({"indexability": indexable, "canonical_state": state, "schema_valid": valid, "effective_price": price}).drop("canonical_raw", "image_raw", "noindex", "fetched")


def page_items(seen: DataFrame) -> DataFrame:
    """(rest, stable_key, url, title, price, currency, availability, image_url, http_status, indexability, canonical_url, schema_present, raw_hash) of observations.

    The hash is that of the JSON of eleven fields in a fixed order, those that are null left out.
    """
    key, final = url_key(F.col("url")), url_key(F.col("final_url"))
    state = [("finalUrl", quoted(final)), ("httpStatus", F.col("http_status").cast("string")), ("indexability", quoted(F.col("indexability"))), ("canonicalUrl", quoted(F.col("canonical_url"))), ("canonicalState", quoted(F.col("canonical_state"))),
             ("schemaPresent", F.col("schema_present").cast("string")), ("schemaValidEnough", F.col("schema_valid").cast("string")), ("effectivePrice", quoted(F.col("effective_price"))), ("currency", quoted(F.col("currency"))),
             ("availability", quoted(F.col("availability"))), ("imageUrl", quoted(F.col("image_url")))]
    json = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), v) for n, v in state]), F.lit("}"))
    known = {"url", "final_url", "http_status", "schema_present", "title", "base_price", "sale_price", "currency", "availability", "strategy", "links", "canonical_url", "image_url", "indexability", "canonical_state", "schema_valid", "effective_price"}
    return seen.select(*[c for c in seen.columns if c not in known], F.concat(F.lit("url:"), key).alias("stable_key"), key.alias("url"), "title", F.col("effective_price").alias("price"), "currency", "availability", "image_url", "http_status",
                       "indexability", "canonical_url", "schema_present", F.sha2(json.cast("binary"), 256).alias("raw_hash"))
