"""Scalar functions: column to column, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the sources' scripts see it: Java's \s, no-break and other Unicode spaces, byte-order mark.
SPACE = r"[\s ﻿\p{Z}]"


def once(value: Column, use) -> Column:
    """use(value), the value being computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapsed(text: Column) -> Column:
    """Trimmed, with each run of white space as one space; null stays null."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def offer_key(offer_id: Column) -> Column:
    """Normalised offer id: collapsed and lower-cased; null if nothing is left."""
    return F.nullif(F.lower(collapsed(offer_id)), F.lit(""))


def bounded(text: Column, most: int = 256) -> Column:
    """Collapsed and cut to a number of code points; null if nothing is left."""
    return F.nullif(F.left(collapsed(text), F.lit(most)), F.lit(""))


def token(text: Column, most: int = 64) -> Column:
    """Lower case, other characters than letters and digits as single underscores, none at the ends."""
    return F.nullif(F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(most)), F.lit(""))


def url_key(url: Column) -> Column:
    """An http(s) address for comparison: scheme and host lower-cased, default port, query and fragment dropped, no slash
    at the end of a path other than the root. Null if it isn't one."""
    scheme = F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"://([^/?#\s]+)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.regexp_replace(F.regexp_extract(url, r"://[^/?#\s]+([^?#]*)", 1), r"/+$", "")
    path = F.when(F.trim(path) == "", "/").otherwise(F.trim(path))
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, path))


def domain_key(url: Column) -> Column:
    """Scheme and host (with a port of its own) of an http(s) address, lower-cased; null if it isn't one."""
    return F.nullif(F.regexp_extract(url_key(url), "^https?://[^/]+", 0), F.lit(""))


# Hosts and address ranges that aren't to be fetched from.
INTERNAL_HOSTS = ("localhost", "metadata.google.internal")
PRIVATE_V4 = r"^(0|10|127)\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^169\.254\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\."
PRIVATE_V6 = r"^(::1$|fc|fd|fe80:|::ffff:(127|10|192\.168|169\.254)\.)"


def is_public_url(url: Column) -> Column:
    """Whether a url is http(s) and names neither an internal host nor a private address; false for null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), r"\.$", "")
    v6 = host.startswith("[")
    bare = F.regexp_replace(host, r"[\[\]]", "")
    v4 = bare.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = bare.isin(*INTERNAL_HOSTS) | (v4 & bare.rlike(PRIVATE_V4)) | (v6 & bare.rlike(PRIVATE_V6))
    return F.coalesce(url.rlike(r"(?i)^\s*https?://") & (bare != "") & ~inside, F.lit(False))


def product_key(offer: Column, url: Column, canonical: Column, title: Column, image: Column, price: Column) -> Column:
    """offer:…, else url:…, else canonical:…, else a hash of title, image and price."""
    rest = F.concat_ws("|", *[F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (title, image, price)])
    return F.coalesce(F.concat(F.lit("offer:"), offer_key(offer)), F.concat(F.lit("url:"), url_key(url)),
                      F.concat(F.lit("canonical:"), url_key(canonical)), F.concat(F.lit("hash:"), F.sha2(rest.cast("binary"), 256)))


def price_number(text: Column) -> Column:
    """Number in a price text: other characters than digits, comma, point and minus go, the first comma is a point.
    An empty text is null; another one without digits counts as 0, as sources read it; what is no number then is null."""
    kept = F.regexp_replace(F.regexp_replace(text, "[^0-9.,-]", ""), "^([^,]*),", "$1.")
    return F.when(text == "", None).when(kept == "", 0.0).when(kept.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def money(text: Column) -> Column:
    """struct(amount, currency) of "12,50 EUR"; null parts if the text is something else."""
    shape = r"^\s*(\d+(?:[.,]\d+)?)(?:\s*([A-Za-z]{3}))?\s*$"
    return F.struct(F.nullif(F.replace(F.regexp_extract(text, shape, 1), F.lit(","), F.lit(".")), F.lit("")).try_cast("double").alias("amount"),
                    F.nullif(F.upper(F.regexp_extract(text, shape, 2)), F.lit("")).alias("currency"))


#: The wordings of availability.
IN_STOCK = ("in_stock", "instock", "available")
OUT_OF_STOCK = ("out_of_stock", "outofstock", "sold_out", "unavailable")


def availability(text: Column) -> Column:
    """in_stock, out_of_stock, preorder, backorder or unknown of a source's wording ("pre-order" is unknown, and so is one with blanks around it).

    The vocabulary's address before the word goes, runs of white space and hyphens are one underscore.
    """
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"^(?s)(.*?)https?://schema\.org/", "$1"), rf"({SPACE}|-)+", "_")
    return F.coalesce(F.when(t.isin(*IN_STOCK), "in_stock").when(t.isin(*OUT_OF_STOCK), "out_of_stock").when(t.contains("preorder"), "preorder").when(t.contains("backorder"), "backorder"), F.lit("unknown"))


def comparable(status: Column, before_status: Column, value: Column, before: Column, extracted: Column, before_extracted: Column) -> Column:
    """Whether a field may be compared: both checks success or partial, no extraction failed (null: it didn't), both values known."""
    useful = status.isin("success", "partial") & before_status.isin("success", "partial")
    return F.coalesce(useful & F.coalesce(extracted, F.lit(True)) & F.coalesce(before_extracted, F.lit(True)) & value.isNotNull() & before.isNotNull(), F.lit(False))


def shifted(text: Column, places: int) -> Column:
    """A decimal text times a power of ten, exactly: digits only move. Null for other texts than digits with one point, and beyond 512 characters."""
    shape = r"^\s*(\d+)(?:\.(\d+))?\s*$"
    whole, part = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    if places >= 0:
        whole, part = F.concat(whole, F.rpad(F.left(part, F.lit(places)), places, "0")) if places else whole, F.substring(part, places + 1, 512)
    else:
        padded = F.concat(F.lit("0" * -places), whole)
        whole, part = F.left(padded, F.length(padded) + places), F.concat(F.right(padded, F.lit(-places)), part)
    moved = F.concat(F.regexp_replace(whole, r"^0+(?=\d)", ""), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(text.rlike(shape) & (F.length(text) <= 512), moved)


def fixed(value: Column, places: int) -> Column:
    """value with so many decimals, the nearest by its exact binary value, ties up: as evidence texts show shares. Values from 0 below 1e9."""
    scale = float(10**places)
    product = value * scale
    split = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # the upper half of a double's bits
    high = split(value)
    error = high * scale - product + (value - high) * scale  # what the product has lost, exactly: scale has few bits
    whole = F.floor(product)
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & (error >= 0))
    digits = (whole + up.cast("int")).cast("long").cast("string")
    digits = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(places + 1) - F.length(digits))), digits)
    return F.concat(F.left(digits, F.length(digits) - places), F.lit("."), F.right(digits, F.lit(places))) if places else digits


def fingerprint(store: Column, kind: Column, *scope: Column) -> Column:
    """store:kind and the scope's parts, joined by colons; a null part is empty."""
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (store, kind, *scope)])


def _over(old: Column, new: Column) -> Column:
    """The entries of two maps, the new ones winning; both are named twice, so give values already computed."""
    return once(F.map_keys(new), lambda names: F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(names, k)), new))


def _object(json: Column) -> Column:
    """A JSON object's fields as map<string,variant>; empty for other JSON and null."""
    return F.coalesce(F.when(json.rlike(r"^\s*\{"), F.from_json(json, "map<string,variant>")), F.from_json(F.lit("{}"), "map<string,variant>"))


def _merged_maps(old: Column, new: Column) -> Column:
    """What merged_metadata says, of maps and as a map."""
    field = lambda m, name: F.to_json(F.element_at(m, name))
    texts = lambda json: F.coalesce(F.when(json.rlike(r"^\["), F.transform(F.from_json(json, "array<variant>"), lambda v: F.to_json(v))), F.array().cast("array<string>"))
    fits = lambda a, b, shape: F.coalesce(a.rlike(shape), F.lit(False)) | F.coalesce(b.rlike(shape), F.lit(False))
    none = F.from_json(F.lit("{}"), "map<string,variant>")

    def grown(m: Column) -> Column:
        found = F.concat(F.lit("["), F.array_join(F.array_distinct(F.concat(texts(m["fa"]), texts(m["fb"]))), ","), F.lit("]"))
        hashes = once(F.struct(_object(m["ha"]).alias("a"), _object(m["hb"]).alias("b")), lambda h: F.to_json(_over(h["a"], h["b"])))
        more = [F.when(fits(m[f"{c}a"], m[f"{c}b"], shape), F.create_map(F.lit(name), F.parse_json(json))).otherwise(none)
                for c, name, shape, json in (("f", "discoveredFrom", r"^\[", found), ("h", "sourceHashes", r"^\{", hashes))]
        return once(F.map_concat(*more), lambda added: once(_over(m["a"], m["b"]), lambda whole: _over(whole, added)))

    both = F.struct(old.alias("a"), new.alias("b"))
    fields = [(f"{c}{side}", side, name) for c, name in (("f", "discoveredFrom"), ("h", "sourceHashes")) for side in "ab"]
    return once(both, lambda m: once(F.struct(m["a"].alias("a"), m["b"].alias("b"), *[field(m[side], name).alias(n) for n, side, name in fields]), grown))


def merged_metadata(old: Column, new: Column) -> Column:
    """JSON text of two JSON objects merged, the new fields winning; but the elements of both discoveredFrom arrays stay, each
    once by its JSON text, and so do the fields of both sourceHashes objects. Null and what is no object count as empty."""
    return F.to_json(_merged_maps(_object(old), _object(new)))


# How items say which data of a merchant account they hold, and what belongs to an identity.
DATA_KIND, IDENTITY_KIND, ISSUES_KIND = "merchantDataKind", "product_identity", "item_issues"
IDENTITY_FIELDS = ("merchantProductIdentityVersion", "merchantItemIssuesConfigurationHash")


def merged_item_metadata(old: Column, new: Column, keep_identity: Column) -> Column:
    """merged_metadata, but where keep_identity and issues come to an item of an identity scan, the item stays one: its kind and IDENTITY_FIELDS are the old ones, or go if the old object lacks them."""
    said = lambda json: F.get_json_object(json, f"$.{DATA_KIND}")
    kept = F.coalesce(keep_identity & (said(old) == IDENTITY_KIND) & (said(new) == ISSUES_KIND), F.lit(False))
    names = F.array(*[F.lit(n) for n in (DATA_KIND, *IDENTITY_FIELDS)])

    def told(m: Column) -> Column:
        identity = lambda whole: F.map_concat(F.map_filter(whole, lambda k, _: ~F.array_contains(names, k)), F.map_filter(m["a"], lambda k, _: F.array_contains(names, k)))
        return once(_merged_maps(m["a"], m["b"]), lambda whole: F.to_json(F.when(m["kept"], identity(whole)).otherwise(whole)))

    return once(F.struct(_object(old).alias("a"), _object(new).alias("b"), kept.alias("kept")), told)


def countries(codes: Column) -> Column:
    """Distinct two-letter country codes, upper-cased, 50 at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(codes, lambda c: F.upper(F.trim(c))), lambda c: c.rlike("^[A-Z]{2}$"))), 1, 50)


def escaped_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def shortened(text: Column, most: int) -> Column:
    """text, or its beginning and three points, most characters in all."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def like_pattern(text: str) -> str:
    """text as a literal inside a LIKE pattern with backslash escapes."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def fraction_lost(before: Column, after: Column) -> Column:
    """(before - after) / before; 0 where before is 0."""
    return F.when(before == 0, 0.0).otherwise((before - after) / F.when(before == 0, 1.0).otherwise(before))


def http_status_class(status: Column) -> Column:
    """How a fetch of a sitemap, category or page went."""
    return (F.when(status.isNull(), "timeout").when(status.isin(403, 429), "blocked").when(status.between(200, 299), "success").otherwise("source_unavailable"))


def feed_status_class(status: Column) -> Column:
    """How a fetch of a feed went: feeds may ask for credentials."""
    return F.when(status == 401, "authentication_failed").otherwise(http_status_class(status))


def labelled(name: Column) -> Column:
    """a_b as A B: underscores as blanks, each word's first letter upper-cased, the rest as it is."""
    return F.array_join(F.transform(F.split(name, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")


def rounded_percent(share: Column) -> Column:
    """A share as whole percents, halves up."""
    return F.concat(F.floor(share * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


def retry_seconds(attempt: Column, retry_after: Column) -> Column:
    """Delay before the next delivery attempt: the server's wish within a day, else a ladder."""
    ladder = F.element_at(F.array(*[F.lit(n) for n in (60, 300, 900, 3600)]), F.least(F.greatest(attempt, F.lit(1)), F.lit(4)).cast("int"))
    return F.when(retry_after.isNotNull(), F.least(F.greatest(retry_after, F.lit(1)), F.lit(86_400))).otherwise(ladder)
