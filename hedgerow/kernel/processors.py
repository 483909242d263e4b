"""Processors of events that stand before or behind a policy."""

from __future__ import annotations

import re
import string
from collections.abc import Iterable, Iterator

from hedgerow.kernel import tables as T
from hedgerow.kernel.lex import Event

_TARGET = {"a": "href", "img": "src"}
_CAPITALS = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)
_HOST = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)")


def hosts_told(events: Iterable[Event]) -> Iterator[Event]:
    """Balanced events with the host of every link and image told in the text behind it."""
    due: list[Event | None] = []
    for e in events:
        yield e
        note = None
        if e.kind == "open":
            found = next((_HOST.match(v) for k, v in e.attrs if k == _TARGET.get(e.name)), None)
            note = Event("text", text=f" - {found[1]}") if found else None
            if e.name not in T.VOID:
                due.append(note)
                note = None
        elif e.kind == "close" and due:
            note = due.pop()
        if note is not None:
            yield note


def only_inside(element: str):
    """A preprocessor that leaves an element and what it holds."""

    def own(events: Iterable[Event]) -> Iterator[Event]:
        inside = False
        for e in events:
            if e.kind == "open" and e.name == element:
                inside = True
            if inside:
                yield e
            if e.kind == "close" and e.name == element:
                inside = False

    return own


def first_text(events: Iterable[Event], element: str) -> str:
    """The text in the first such element, '' without one; what follows isn't read."""
    inside, out = False, []
    for e in events:
        if e.kind == "open" and e.name == element:
            inside = True
        elif inside and e.kind == "close" and e.name == element:
            break
        elif inside and e.kind == "text":
            out.append(e.text)
    return "".join(out)


def shouted(events: Iterable[Event]) -> Iterator[Event]:
    """Text with ASCII letters in capitals."""
    for e in events:
        yield e._replace(text=e.text.translate(_CAPITALS)) if e.kind == "text" else e
