"""Strict JSON reading that keeps numbers as written."""

from __future__ import annotations

import json
import re

INVALID = object()
_NUMBER_LIKE = re.compile(r"[-+]?\d")


class Number(str):
    """The text of a JSON number."""

    __slots__ = ()


def _refuse(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)
_SPACE = " \t\n\r"


def clean(text: str) -> str:
    """Replace lone surrogates, which a JSON escape can make and UTF-8 cannot hold."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _deep(text: str):
    """A value nested beyond the C scanner's depth, read with an explicit stack."""
    at, stack, want = 0, [], "value"
    root = key = None
    n = len(text)

    def place(v):
        nonlocal root
        if not stack:
            root = v
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(v)
        else:
            stack[-1][0][stack[-1][1]] = v

    while True:
        while at < n and text[at] in _SPACE:
            at += 1
        if want == "end" and not stack:
            return root if at == n else INVALID
        if at >= n:
            return INVALID
        c = text[at]
        if want in ("value", "first") and c == "[":
            v: list | dict = []
            place(v)
            stack.append([v, None])
            at, want = at + 1, "first"
        elif want in ("value", "first") and c == "{":
            v = {}
            place(v)
            stack.append([v, None])
            at, want = at + 1, "firstkey"
        elif want == "first" and c == "]" or want == "firstkey" and c == "}":
            stack.pop()
            at, want = at + 1, "end"
        elif want in ("key", "firstkey"):
            if c != '"':
                return INVALID
            try:
                key, at = json.decoder.scanstring(text, at + 1, True)
            except ValueError:
                return INVALID
            while at < n and text[at] in _SPACE:
                at += 1
            if at >= n or text[at] != ":":
                return INVALID
            stack[-1][1] = key
            at, want = at + 1, "value"
        elif want in ("value", "first"):
            try:
                v, at = _DECODER.raw_decode(text, at)
            except ValueError:
                return INVALID
            place(v)
            want = "end"
        elif c == ",":
            at, want = at + 1, "value" if isinstance(stack[-1][0], list) else "key"
        elif c == ("]" if isinstance(stack[-1][0], list) else "}"):
            stack.pop()
            at += 1
        else:
            return INVALID


def read(text: str | None):
    """The value of a JSON text, or ``INVALID``.  ``NaN`` and the infinities are not JSON."""
    if text is None:
        return INVALID
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return _deep(text)
    except ValueError:
        return INVALID
