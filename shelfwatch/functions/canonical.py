"""Canonical JSON: keys in order at every depth, one spelling for each value, so that equal values hash alike.

Plain texts (strict JSON, keys of printable ASCII, numbers of 15 digits at most) are read and written by Python's json
module in batches.  All others are folded over their tokens with a stack of open objects and arrays, in column
expressions: no limit of depth, but some 50 times slower.  The fold copies the open object's members at each step, so
one object of very many members costs their number squared; depth and the number of objects cost nothing of the kind.
Give
them a column of a DataFrame, not a long expression: it is named twice, and the batches can't be part of a lambda.
"""

from __future__ import annotations

import functools
import json as jsonlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import once

#: A string, a sign of structure, or a run of other characters (numbers, true, false, null).
TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]++'
ITEMS = "array<struct<late:boolean,place:decimal(10,0),name:string collate UNICODE,key:string,text:string>>"
FRAME = f"struct<open:string,key:string,items:{ITEMS}>"
STATE = f"struct<stack:array<{FRAME}>,done:string,bad:boolean>"
#: JSON's short escapes, the backslash first.
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")]


def quoted(text: Column) -> Column:
    """text as a JSON string: the short escapes, \\u00xx in lower case for other control characters, all else as it is."""
    escaped = text
    for plain, escape in [*ESCAPES, *[(chr(c), f"\\u{c:04x}") for c in range(32) if chr(c) not in "\b\t\n\f\r"]]:
        escaped = F.replace(escaped, F.lit(plain), F.lit(escape))
    return F.concat(F.lit('"'), F.when(text.rlike('[\\x00-\\x1f"\\\\]'), escaped).otherwise(text), F.lit('"'))


def unquoted(token: Column) -> Column:
    """The text that a JSON string stands for."""
    return F.when(F.contains(token, F.lit("\\")), F.get_json_object(F.concat(F.lit('{"a":'), token, F.lit("}")), "$.a")).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def number(text: Column) -> Column:
    """A number as scripts print it: shortest digits, an exponent below 1e-6 and from 1e21 on, no sign of zero. Too large ones become null."""
    shape = r"^(\d+)\.(\d+?)0*(?:E(-?\d+))?$"  # of a double's text

    def parts(shown: Column) -> Column:
        whole, part = F.regexp_extract(shown, shape, 1), F.regexp_extract(shown, shape, 2)
        return F.struct(whole.alias("whole"), F.when(part == "0", "").otherwise(part).alias("part"), F.coalesce(F.nullif(F.regexp_extract(shown, shape, 3), F.lit("")).cast("int"), F.lit(0)).alias("power"))

    def placed(p: Column) -> Column:
        """Digits without zeros at the ends, and how many of them stand before the point."""
        both = F.concat(p["whole"], p["part"])
        digits = F.regexp_replace(both, "^0+", "")
        return F.struct(F.regexp_replace(digits, "0+$", "").alias("digits"), (F.length(p["whole"]) + p["power"] - (F.length(both) - F.length(digits))).alias("point"))

    def told(d: Column) -> Column:
        digits, point, n = d["digits"], d["point"], F.length(d["digits"])
        science = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(point < 1, "e-").otherwise("e+"), F.abs(point - 1).cast("string"))
        plain = (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
                 .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n))).otherwise(F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, n))))
        return F.when((point < -5) | (point > 21), science).otherwise(plain)

    def spelt(value: Column) -> Column:
        said = once(once(F.abs(value).cast("string"), parts), lambda p: once(placed(p), told))
        return F.when(value == 0, "0").when(F.abs(value) == float("inf"), "null").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), said))

    short = text.rlike(r"^-?[1-9]\d{0,14}$")  # spelt so already
    return F.when(short, text).when(text.isNotNull(), once(text.try_cast("double"), spelt))


def _folded(json: Column, ordered: bool, hidden: str | None = None) -> Column:
    """json written anew: members ordered or as they come, those whose key matches hidden left out at any depth."""
    # no casts below: one of a whole state would copy all that is open at each token
    empty_items = F.array().cast(ITEMS)
    start = F.struct(F.array().cast(f"array<{FRAME}>").alias("stack"), F.lit(None).cast("string").alias("done"), F.lit(False).alias("bad")).cast(STATE)

    def state(stack: Column, done: Column, bad: Column) -> Column:
        return F.struct(stack.alias("stack"), done.alias("done"), bad.alias("bad"))

    def frame(open_: Column, key: Column, items: Column) -> Column:
        return F.struct(open_.alias("open"), key.alias("key"), items.alias("items"))

    def below(s: Column) -> Column:
        return F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)

    def member(key: Column, text: Column) -> Column:
        whole = key.rlike(r"^(0|[1-9]\d{0,9})$") & (key.try_cast("decimal(10,0)") < 4294967295)
        place = F.when(whole, key.try_cast("decimal(10,0)"))
        return F.struct((~F.coalesce(whole, F.lit(False))).alias("late"), place.alias("place"), F.collate(key, "UNICODE").alias("name"), key.alias("key"), text.alias("text"))

    def put(stack: Column, done: Column, bad: Column, text: Column) -> Column:
        """The state after a whole value: the result, an array's item or the value of an object's key."""
        def into(last: Column) -> Column:
            lacks_key = (last["open"] == "{") & last["key"].isNull()
            kept = F.when(last["open"] == "{", F.filter(last["items"], lambda m: m["key"] != last["key"])).otherwise(last["items"])
            added = F.concat(kept, F.array(member(last["key"], text)))
            if hidden is not None:
                added = F.when(F.coalesce(last["key"].rlike(hidden), F.lit(False)), kept).otherwise(added)
            grown = F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(frame(last["open"], F.lit(None).cast("string"), added)))
            return state(grown, done, bad | lacks_key)

        return F.when(F.size(stack) == 0, state(stack, text, bad | done.isNotNull())).otherwise(once(F.element_at(stack, -1), into))

    def closed(f: Column) -> Column:
        members = F.transform(F.array_sort(f["items"]) if ordered else f["items"], lambda m: F.concat(quoted(m["key"]), F.lit(":"), m["text"]))
        return F.when(f["open"] == "{", F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))).otherwise(
            F.concat(F.lit("["), F.array_join(F.transform(f["items"], lambda m: m["text"]), ","), F.lit("]")))

    def step(s: Column, token: Column) -> Column:
        is_text = F.startswith(token, F.lit('"'))
        word = token.isin("true", "false", "null")

        def scalar(_: Column) -> Column:
            known = is_text | word | token.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$")
            said = F.when(is_text, quoted(unquoted(token))).when(word, token).otherwise(number(token))
            return once(said, lambda text: put(s["stack"], s["done"], s["bad"] | ~known, text))

        def at_text(last: Column) -> Column:
            names = (last["open"] == "{") & last["key"].isNull()
            named = F.concat(below(s), F.array(frame(last["open"], unquoted(token), last["items"])))
            return F.when(F.coalesce(names, F.lit(False)), state(named, s["done"], s["bad"])).otherwise(scalar(token))

        def at_close(last: Column) -> Column:
            matches = F.coalesce((last["open"] == F.when(token == "}", "{").otherwise("[")) & last["key"].isNull(), F.lit(False))
            return F.when(matches, once(F.struct(below(s).alias("stack"), closed(last).alias("text")), lambda b: put(b["stack"], s["done"], s["bad"], b["text"]))).otherwise(state(s["stack"], s["done"], F.lit(True)))

        return (F.when(token.isin(",", ":"), s).when(token.isin("{", "["), state(F.concat(s["stack"], F.array(frame(token, F.lit(None).cast("string"), empty_items))), s["done"], s["bad"]))
                .when(token.isin("}", "]"), once(F.try_element_at(s["stack"], F.lit(-1)), at_close)).when(is_text, once(F.try_element_at(s["stack"], F.lit(-1)), at_text)).otherwise(scalar(token)))

    tokens = F.regexp_extract_all(json, F.lit(TOKEN), F.lit(0))
    return once(F.aggregate(tokens, start, step), lambda end: F.when((F.size(end["stack"]) == 0) & ~end["bad"], end["done"]))


#: Printable ASCII in the order of the root collation, small letters before capital ones.
ROOT_ORDER = " _-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$0123456789aAbBcCdDeEfFgGhHiIjJkKlLmMnNoOpPqQrRsStTuUvVwWxXyYzZ"
RANK = {c: chr(32 + k) for k, c in enumerate(ROOT_ORDER)}
PRIMARY = str.maketrans({c: RANK[c.lower()] for c in ROOT_ORDER})
CASE = str.maketrans({c: "1" if c.isupper() else "0" for c in ROOT_ORDER})


@functools.lru_cache(10000)
def _key_order(key: str) -> tuple:
    """What orders a key; ValueError for one that isn't plain."""
    if not (key.isascii() and (key.isprintable() or not key)):
        raise ValueError(key)
    if re.fullmatch(r"0|[1-9][0-9]{0,9}", key) and int(key) < 4294967295:
        return 0, int(key), "", key
    return 1, key.translate(PRIMARY), key.translate(CASE), key


def _plain_number(text: str) -> int | float:
    value = float(text)
    if len(text) > 15 or abs(value) >= 1e15:  # digits may get lost, or an exponent is due
        raise ValueError(text)
    if value == int(value):
        return int(value)
    if abs(value) < 0.001:  # Python would write an exponent for some
        raise ValueError(text)
    return value


def _refused(text: str) -> None:
    raise ValueError(text)


def _decoder(ordered: bool, hidden: str | None) -> jsonlib.JSONDecoder:
    leaves_out = re.compile(hidden).search if hidden is not None else lambda _: None

    def members(pairs: list) -> dict:
        for key, _ in pairs:
            _key_order(key)  # plain?
        last = dict(pairs)
        if len(last) < len(pairs):  # of equal keys the last value, at its place
            last = {}
            for key, value in pairs:
                last.pop(key, None)
                last[key] = value
        return {k: last[k] for k in (sorted(last, key=_key_order) if ordered else last) if not leaves_out(k)}

    return jsonlib.JSONDecoder(object_pairs_hook=members, parse_int=_plain_number, parse_float=_plain_number, parse_constant=_refused)


def _plain(ordered: bool, hidden: str | None = None):
    """A function of batches of texts: what _folded says of a plain text, null for any other."""
    write = jsonlib.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode

    def told(texts: pd.Series) -> pd.Series:
        read = _decoder(ordered, hidden).decode

        @functools.cache  # of this batch: texts often come again
        def one(text: str | None) -> str | None:
            try:
                said = write(read(text)) if text else None
                return said if said is None or "\\u" not in text else said.encode().decode()  # halves of characters can't be written
            except (ValueError, RecursionError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(told, "string")


def _written(json: Column, ordered: bool, hidden: str | None = None) -> Column:
    return F.coalesce(_plain(ordered, hidden)(json), _folded(json, ordered, hidden))


def canonical_json(json: Column) -> Column:
    """json (a text) without white space, every object's keys in order and once (the last one's value), values spelt alike.

    Keys that are whole numbers below 2**32 - 1 come first, by number; the others as people sort words (root collation:
    signs, digits, letters, small before capital only where all else is equal). Null if json is null or no JSON value.
    """
    return _written(json, ordered=True)


def redacted_json(json: Column, hidden: str) -> Column:
    """A JSON object without white space and without the members whose key matches hidden, at any depth; null for null and for what is no object."""
    return F.when(json.rlike(r"^\s*\{"), _written(json, ordered=False, hidden=hidden))


def canonical_hash(json: Column) -> Column:
    """SHA-256, lower-case hex, of the canonical form."""
    return F.sha2(canonical_json(json).cast("binary"), 256)
