"""URL attributes: protocols, normal form, source sets."""

from __future__ import annotations

import re
from collections.abc import Callable

from hedgerow.kernel.tables import ascii_lower

HTML_SPACE = " \t\n\f\r"
_DELIMITER = re.compile("[/#?:]")
_PARENS = {"(": "%28", ")": "%29", "{": "%7b", "}": "%7d"}
#: Characters that look like a colon.
_COLONS = {"։": "%d6%89", "׃": "%d7%83", "∶": "%e2%88%b6", "：": "%ef%bc%9a"}


def normalize(url: str) -> str:
    """Parentheses, braces, controls and spaces in percent form, and look-alikes of a colon where a protocol could end."""
    out, seen = [], False
    for c in url:
        if c in "/:?#":
            seen = True
            out.append(c)
        elif c in _PARENS:
            out.append(_PARENS[c])
        elif c <= " ":
            if c != "\0":
                out.append(f"%{ord(c):02x}")
        elif c in _COLONS and not seen:
            out.append(_COLONS[c])
        else:
            out.append(c)
    return "".join(out)


def url_filter(protocols: frozenset[str]) -> Callable[[str], str | None]:
    """The URL in normal form if its protocol, should it have one, is allowed."""
    relative_host = "http" in protocols and "https" in protocols

    def of(value: str) -> str | None:
        url = value.strip(HTML_SPACE)
        m = _DELIMITER.search(url)
        if m and m[0] == ":":
            if ascii_lower(url[: m.start()]) not in protocols:
                return None
        elif m and m.start() == 0 and url.startswith("//") and not relative_host:
            return None
        return normalize(url)

    return of


def float_end(s: str, start: int) -> int:
    """The end of the number that begins at ``start``, or -1."""
    m = re.compile(r"-?(?:[0-9]*\.[0-9]+|[0-9]+(?![0-9.]))(?:[eE][+-]?[0-9]+|(?![eE0-9]))").match(s, start)
    return m.end() if m else -1


def srcset(value: str, url_policy: Callable[[str], str | None]) -> str | None:
    """Candidates with an allowed URL; None if the list is not well-formed."""
    out, at, n = [], 0, len(value)

    def skip(i: int) -> int:
        while i < n and value[i] in HTML_SPACE:
            i += 1
        return i

    while True:
        at = skip(at)
        end = at
        while end < n and value[end] not in HTML_SPACE:
            end += 1
        url = value[at:end]
        if not url or url.startswith(",") or url.endswith(","):
            return None
        at = skip(end)
        size = ""
        if at < n and value[at] != ",":
            stop = float_end(value, at)
            if stop < 0:
                return None
            if stop < n and value[stop].isascii() and value[stop].isalpha():
                stop += 1
            size, at = value[at:stop], skip(stop)
        allowed = url_policy(url)
        if allowed:
            out.append(allowed.replace(",", "%2c") + (f" {size}" if size else ""))
        if at >= n:
            return " , ".join(out) or None
        if value[at] != ",":
            return None
        at = skip(at + 1)
        if at >= n:  # a comma may end the list
            return " , ".join(out) or None
