"""Well-nested events from events in any order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from hedgerow.kernel import tables as T
from hedgerow.kernel.lex import Event

NESTING_LIMIT = 256
_BLANK = re.compile(r"[ \t\n\f\r]*\Z")


class Balancer:
    """Holds the open elements and those that are to be opened again. Elements at ``limit`` and deeper are followed, not emitted."""

    def __init__(self, limit: int = NESTING_LIMIT):
        self.limit, self.open, self.again, self.out = limit, [], [], []

    def _emit(self, event: Event, depth: int) -> None:
        if depth < self.limit:
            self.out.append(event)

    def _holds(self, child: str, at: int) -> bool:
        """Whether the open element number ``at`` may have the child; transparent ones ask what is around them."""
        while True:
            name = self.open[at] if at >= 0 else "body"
            if child == T.TEXT:
                if name in T.SPECIAL_TEXT and "select" in self.open[: max(at, 0)]:
                    return False
                fits = name in T.HOLDS_TEXT
            else:
                fits = child in T.MAY_CONTAIN[name]
            if fits or at < 0 or name not in T.TRANSPARENT:
                return fits
            at -= 1

    def _pop(self, unless: str = "") -> None:
        name = self.open.pop()
        self._emit(Event("close", name), len(self.open))
        if name in T.RESUMED and name != unless:
            self.again.append(name)

    def _prepare(self, child: str) -> None:
        top = self.open[-1] if self.open else "body"
        more = T.implied(top, child)
        if top in more:
            more = more[more.index(top) + 1 :]
        for name in more:
            self.out.append(Event("open", name))
            self.open.append(name)
        while self.open and not (self._holds(child, len(self.open) - 1) and not (child == "a" and "a" in self.open)):
            self._pop(child)
        while self.again:
            name = self.again[-1]
            if self.open and not self._holds(name, len(self.open) - 1):
                break
            if not self._fits_in(child, name):
                break
            self.again.pop()
            self._emit(Event("open", name), len(self.open))
            self.open.append(name)

    @staticmethod
    def _fits_in(child: str, parent: str) -> bool:
        return parent in T.HOLDS_TEXT if child == T.TEXT else child in T.MAY_CONTAIN[parent]

    def _close(self, name: str) -> None:
        blocks = T.BLOCKS[T.END_SCOPE.get(name, "in")]
        for at in range(len(self.open) - 1, -1, -1):
            own = self.open[at]
            if own == name or name in T.HEADINGS and own in T.HEADINGS:
                break
            if own in blocks:
                return
        else:
            return
        while len(self.open) > at + 1:
            self._pop()
        self._emit(Event("close", self.open[at]), at)
        self.open.pop()

    def take(self, event: Event) -> None:
        if event.kind != "text":  # processors may give names in any case
            event = event._replace(name=T.element_name(event.name))
        if event.kind == "text":
            if _BLANK.match(event.text):
                if self.open and (self.open[-1] not in T.HOLDS_TEXT or T.implied(self.open[-1], "a")):
                    return
            else:
                self._prepare(T.TEXT)
            self._emit(event, len(self.open))
        elif event.name not in T.PLACE or event.name == T.UNKNOWN:
            self._emit(event, len(self.open))
        elif event.kind == "open":
            self._prepare(event.name)
            self._emit(event, len(self.open))
            if event.name not in T.VOID:
                self.open.append(event.name)
        elif event.name not in T.VOID:
            self._close(event.name)

    def end(self) -> None:
        for at in range(min(self.limit, len(self.open)) - 1, -1, -1):
            self.out.append(Event("close", self.open[at]))
        self.open, self.again = [], []


def balanced(events: Iterable[Event], limit: int = NESTING_LIMIT) -> Iterator[Event]:
    own = Balancer(limit)
    for e in events:
        own.take(e)
        yield from own.out
        own.out = []
    own.end()
    yield from own.out
