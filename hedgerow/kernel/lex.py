"""From a document to tokens, and from tokens to events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from hedgerow.kernel.codec import decode, strip_banned
from hedgerow.kernel.tables import ESCAPE_EXEMPT, RCDATA, VALUELESS, attribute_name, element_name


class Token(NamedTuple):
    kind: str
    start: int
    end: int


class Event(NamedTuple):
    """kind: open, close or text. attrs: list of (name, value) of an open event."""

    kind: str
    name: str = ""
    attrs: tuple[tuple[str, str], ...] = ()
    text: str = ""


#: White space of names and of tags: Unicode's without the no-break ones, and the information separators.
_WS = "\t\n\x0b\f\r\x1c-\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000"
_TAG_NAME = re.compile(f"</?[^{_WS}>/<]*")
_IN_TAG = re.compile(f"(?P<TAGEND>/?>)|(?P<QSTRING>\"[^\"]*(?:\"|$)|'[^']*(?:'|$))|(?P<IGNORABLE>[{_WS}]+)|(?P<MARK>[=/])")
_WORD_STOP = re.compile(f"[>={_WS}]|/>|[\"'](?=[{_WS}>/])")
_WORD_STOP_AFTER_EQ = re.compile(f"[>={_WS}]|[\"'](?=[{_WS}>/])")


def _comment_end(html: str, at: int) -> int:
    """Where the comment that begins at ``at`` ends, or the end of the document."""
    dash = html.find("-", at + 4)
    if dash < 0:
        return len(html)
    second = html.find("-", dash + 1)
    while second >= 0:
        run = second
        while html.startswith("-", run):
            run += 1
        if html.startswith(">", run):
            return run + 1
        second = html.find("-", run)
    return len(html)


def _tag_tokens(html: str, at: int) -> Iterator[Token]:
    """Tokens from behind a tag's name to its end."""
    after_eq = False
    while at < len(html):
        m = _IN_TAG.match(html, at)
        if m and m.lastgroup != "MARK":
            kind, end = m.lastgroup, m.end()
        elif m:
            kind, end = "TEXT", m.end()
        else:
            stop = (_WORD_STOP_AFTER_EQ if after_eq else _WORD_STOP).search(html, at)
            kind, end = "TEXT", len(html) if stop is None else stop.start() + (html[stop.start()] in "\"'")
        if kind != "IGNORABLE":
            after_eq = html[at:end] == "="
        yield Token(kind, at, end)
        at = end
        if kind == "TAGEND":
            return


def _value_end(html: str, tokens: list[Token], i: int) -> int:
    """The number of the last token of the unquoted value that begins at token ``i``."""
    last = i
    while last + 1 < len(tokens):
        t = tokens[last + 1]
        if t.kind == "TEXT":
            last += 1
            continue
        if t.kind != "IGNORABLE" or last + 2 >= len(tokens):
            break
        word = tokens[last + 2]
        if word.kind != "TEXT" or attribute_name(html[word.start : word.end]) in VALUELESS:
            break
        follow = last + 3
        if follow < len(tokens) and tokens[follow].kind == "IGNORABLE":
            follow += 1
        if follow >= len(tokens) or html[tokens[follow].start : tokens[follow].end] == "=":
            break
        last += 2
    return last


def _attributes(html: str, tokens: list[Token]) -> Iterator[Token]:
    """The names and values among a tag's tokens, and its end."""
    state, i = "tag", 0
    while i < len(tokens):
        t = tokens[i]
        word = html[t.start : t.end] if t.kind == "TEXT" else ""
        if t.kind == "IGNORABLE":
            pass
        elif state == "eq":
            if t.kind == "TEXT":
                i = _value_end(html, tokens, i)
                yield Token("ATTRVALUE", t.start, tokens[i].end)
            elif t.kind == "QSTRING":
                yield Token("ATTRVALUE", t.start, t.end)
            else:
                yield Token("ATTRVALUE", t.start, t.start)
                yield t
            state = "tag"
        elif t.kind == "TEXT" and word == "=":
            if state == "name":
                state = "eq"
            else:
                yield t
        elif t.kind == "TEXT":
            yield Token("ATTRNAME", t.start, t.end)
            state = "name"
        else:
            yield t
            state = "tag"
        i += 1


def _raw_tokens(html: str) -> Iterator[Token]:
    at, exempt, n = 0, "", len(html)
    while at < n:
        kind, name = "TEXT", ""
        if html[at] != "<":
            end = html.find("<", at)
            end = n if end < 0 else end
        else:
            nxt = html[at + 1 : at + 2]
            if nxt == "%":
                end = html.find("%>", at + 2)
                kind, end = "SERVERCODE", n if end < 0 else end + 2
            elif exempt:
                m = _TAG_NAME.match(html, at)
                if nxt == "/" and exempt != "plaintext" and m.end() < n and element_name(m[0][2:]) == exempt:
                    kind, end, name = "TAGBEGIN", m.end(), m[0]
                else:
                    end = html.find("<", at + 1)
                    end = n if end < 0 else end
            elif nxt.isascii() and nxt.isalpha() or nxt == "/" and html[at + 2 : at + 3].isalpha():
                m = _TAG_NAME.match(html, at)
                kind, end, name = "TAGBEGIN", m.end(), m[0]
            elif nxt == "!":
                if html.startswith("<!--", at):
                    kind, end = "COMMENT", _comment_end(html, at)
                else:
                    end = html.find(">", at + 2)
                    kind, end = "DIRECTIVE" if end >= 0 else "SERVERCODE", n if end < 0 else end + 1
            elif nxt == "?":
                end = html.find(">", at + 2)
                kind, end = ("QMARKMETA", end + 1) if end >= 0 else ("TEXT", n)
            elif nxt == "<":
                end = at + 1
            else:
                end = html.find("<", at + 2 if nxt != "/" or html[at + 2 : at + 3] == "<" else at + 3)
                end = n if end < 0 else end
        if kind == "TEXT" and exempt and exempt not in RCDATA:
            kind = "UNESCAPED"
        yield Token(kind, at, end)
        at = end
        if kind == "TAGBEGIN":
            own = list(_tag_tokens(html, at))
            yield from _attributes(html, own)
            if own:
                at = own[-1].end
            closing = name.startswith("</")
            exempt = "" if closing else element_name(name[1:]) if own and own[-1].kind == "TAGEND" and element_name(name[1:]) in ESCAPE_EXEMPT else ""


def tokens_of(html: str) -> Iterator[Token]:
    """The document's tokens, with adjacent text together."""
    held = None
    for t in _raw_tokens(html):
        if held and t.kind == held.kind and t.kind in ("TEXT", "UNESCAPED") and held.end == t.start:
            held = Token(t.kind, held.start, t.end)
            continue
        if held:
            yield held
        held = t if t.kind in ("TEXT", "UNESCAPED") else None
        if held is None:
            yield t
    if held:
        yield held


def _unquoted(s: str) -> str:
    """Without quotes at both ends, or one at the end only."""
    if s and s[-1] in "\"'":
        if len(s) > 1 and s[0] == s[-1]:
            return s[1:-1]
        if s[0] not in "\"'":
            return s[:-1]
    return s


def events_of(html: str) -> Iterator[Event]:
    """Open, close and text events; comments, directives and server code are left out."""
    name, attrs, closing = "", [], False
    in_tag = False

    def done() -> Event:
        return Event("close", name) if closing else Event("open", name, tuple((k, k if v is None else v) for k, v in attrs))

    for kind, start, end in tokens_of(html):
        if in_tag and kind not in ("ATTRNAME", "ATTRVALUE", "TAGEND", "QSTRING", "TEXT"):
            yield done()
            in_tag = False
        if kind == "TAGBEGIN":
            closing = html.startswith("</", start)
            name, attrs, in_tag = element_name(html[start + 1 + closing : end]), [], True
        elif kind == "ATTRNAME" and in_tag:
            attrs.append((attribute_name(html[start:end]), None))
        elif kind == "ATTRVALUE" and in_tag and attrs:
            attrs[-1] = (attrs[-1][0], decode(_unquoted(html[start:end]), True))
        elif kind == "TAGEND":
            if in_tag:
                yield done()
            in_tag = False
        elif kind == "TEXT" and not in_tag:
            yield Event("text", text=decode(html[start:end]))
        elif kind == "UNESCAPED":
            yield Event("text", text=strip_banned(html[start:end]))
    if in_tag:
        yield done()
