"""JSON of any depth: reading and searching with a stack of one's own, so that nesting costs no recursion."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*+")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.S)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def loads(text: str):
    """The value of a JSON text; ValueError for what is none. Texts too deep for the library's reader are read here."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _by_stack(text)


def _by_stack(text: str):
    top: list = []
    # an open container, the key that waits for its value, and what may come next
    stack: list[tuple[list | dict, list]] = [(top, [None, "value"])]
    at, end = 0, len(text.rstrip(" \t\n\r"))
    while at < end:
        m = TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        sign, said, other = m.groups()
        box, state = stack[-1]
        want = state[1]
        if sign in (",", ":"):
            if (sign, want) not in ((",", "comma"), (":", "colon")) or len(stack) == 1:
                raise ValueError(f"{sign} at {at}")
            state[1] = "value" if sign == ":" or isinstance(box, list) else "key"
            continue
        if sign in ("}", "]"):
            fits = isinstance(box, dict) == (sign == "}") and len(stack) > 1 and (want == "comma" or want in ("first", "first key"))
            if not fits:
                raise ValueError(f"{sign} at {at}")
            stack.pop()
            continue
        if want in ("key", "first key"):
            if said is None:
                raise ValueError(f"no key at {at}")
            state[:] = [json.loads(said), "colon"]
            continue
        if want not in ("value", "first"):
            raise ValueError(f"a value at {at}")
        value = ({} if sign == "{" else []) if sign else json.loads(said or other)
        if isinstance(box, dict):
            box[state[0]] = value
        else:
            box.append(value)
        state[:] = [None, "comma"]
        if sign:
            stack.append((value, [None, "first key" if sign == "{" else "first"]))
    if len(stack) != 1 or len(top) != 1:
        raise ValueError("no JSON value")
    return top[0]


def objects(value) -> Iterator[dict]:
    """The objects inside value, outer ones first, in the order of the text."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
            stack += reversed(x.values())
        elif isinstance(x, list):
            stack += reversed(x)


def first(texts: list[str], fits: Callable[[dict], bool]) -> dict | None:
    """The first object that fits of the first text that has one; texts that are no JSON have none."""
    for text in texts:
        try:
            value = loads(text)
        except ValueError:
            continue
        found = next((x for x in objects(value) if fits(x)), None)
        if found is not None:
            return found
    return None
