"""From events to HTML that stays safe when it is put between other HTML."""

from __future__ import annotations

import re
from collections.abc import Iterable

from hedgerow.kernel import tables as T
from hedgerow.kernel.codec import encode_attribute, encode_pcdata, encode_rcdata, joins, strip_banned
from hedgerow.kernel.lex import Event

MAX_NAME = 128
#: Old elements that are written as ``pre``.
_AS_PRE = frozenset(["xmp", "listing", "plaintext"])
_NAME = re.compile(r"[^\W\d_](?:[0-9A-Za-z]|[-_](?!\Z)|:(?!\Z)(?!.*:))*\Z")
_FOREIGN = frozenset(["svg", "math"])


def valid_name(name: str) -> bool:
    return len(name) <= MAX_NAME and name.isascii() and _NAME.match(name) is not None


def cdata_fault(name: str, text: str) -> int:
    """Where raw text could end its element early or hide its end; -1 if nowhere."""
    tag = re.compile(f"<!--|-->|<(/?)({re.escape(name)})(?=[\\s/>]|\\Z)", re.I)
    opened, at = -1, 0
    while m := tag.search(text, at):
        at = m.start() + 1
        if m[0] == "<!--":
            if opened >= 0:
                return m.start()
            opened = m.start()
        elif m[0] == "-->":
            if opened < 0:
                return m.start()
            if opened + 4 > m.start():
                return opened
            opened = -1
        elif m[1] or opened >= 0:
            return m.start()
    return opened


class Renderer:
    def __init__(self) -> None:
        self.out: list[str] = []
        self.errors: list[str] = []
        self._cdata: tuple[str, list[str]] | None = None
        self._rcdata, self._foreign = False, 0

    def _error(self, message: str, what: str) -> None:
        self.errors.append(f"{message} : {what}")

    def take(self, e: Event) -> None:
        if e.kind == "text":
            if self._cdata:
                self._cdata[1].append(e.text)
            else:
                if self.out and joins(self.out[-1], e.text):
                    self.out[-1] = self.out[-1][:-1]
                self.out.append((encode_rcdata if self._rcdata else encode_pcdata)(e.text))
        elif e.kind == "open":
            self._open("pre" if e.name in _AS_PRE else e.name, e.attrs)
        else:
            self._close("pre" if e.name in _AS_PRE else e.name)

    def _open(self, name: str, attrs: Iterable[tuple[str, str]]) -> None:
        if not valid_name(name):
            return self._error("Invalid element name", name)
        if self._cdata:
            return self._error("Tag content cannot appear inside CDATA element", name)
        raw, rc = name in T.CDATA, name in T.RCDATA
        if name in _FOREIGN:
            self._foreign += 1
        elif self._foreign and (raw or name == "plaintext"):
            raw, rc = False, True
        self._rcdata = rc
        parts = ["<", name]
        for k, v in attrs:
            if not valid_name(k):
                self._error("Invalid attr name", k)
                continue
            parts.append(f' {k}="{encode_attribute(v)}{" " if "`" in v else ""}"')
        parts.append(" />" if name in T.VOID else ">")
        self.out.append("".join(parts))
        if raw:
            self._cdata = name, []

    def _close(self, name: str) -> None:
        if not valid_name(name):
            return self._error("Invalid element name", name)
        if self._cdata:
            if self._cdata[0] != name:
                return self._error("Tag content cannot appear inside CDATA element", name)
            text, self._cdata = strip_banned("".join(self._cdata[1])), None
            fault = cdata_fault(name, text)
            if fault < 0:
                self.out.append(text)
            else:
                self._error("Invalid CDATA text content", text[fault : fault + 10])
        if name in _FOREIGN and self._foreign:
            self._foreign -= 1
        if name not in T.VOID:
            self.out.append(f"</{name}>")


def render(events: Iterable[Event]) -> tuple[str, list[str]]:
    """The HTML and what was wrong with the events."""
    own = Renderer()
    for e in events:
        own.take(e)
    if own._cdata:
        own._close(own._cdata[0])
    return "".join(own.out), own.errors
