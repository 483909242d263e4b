"""Policies: what is built, what it compiles to, and its application to balanced events."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from hedgerow.kernel import css
from hedgerow.kernel import tables as T
from hedgerow.kernel.balance import NESTING_LIMIT, balanced
from hedgerow.kernel.lex import Event, events_of
from hedgerow.kernel.render import render
from hedgerow.kernel.urls import HTML_SPACE, srcset, url_filter

#: (element, attribute, value) -> value or None
AttributePolicy = Callable[[str, str, str], str | None]
#: (element, attributes as a list of [name, value]) -> element or None; may change the list
ElementPolicy = Callable[[str, list[list[str]]], str | None]
Processor = Callable[[Iterable[Event]], Iterable[Event]]

SKIP, SKIP_BY_DEFAULT, DO_NOT_SKIP, DO_NOT_SKIP_BY_DEFAULT = "SKIP", "SKIP_BY_DEFAULT", "DO_NOT_SKIP", "DO_NOT_SKIP_BY_DEFAULT"

#: Elements that mean nothing without attributes, and those whose text goes with them.
_SKIP_EMPTY = frozenset("a font img input span".split())
_DROPS_TEXT = frozenset("script style noscript nostyle noembed noframes iframe object frame frameset title".split())
_URL_ATTRIBUTES = frozenset("action archive background cite classid codebase data dsync formaction href icon longdesc manifest poster profile src usemap".split())
_FORMATTING = "b i font s u o sup sub ins del strong strike tt code big small br span em".split()
_BLOCKS = "p div h1 h2 h3 h4 h5 h6 ul ol li blockquote".split()


def reject(*_: object) -> None:
    """Drops every element or value."""
    return None


def identity(element: str, *_: object) -> str:
    return element


@dataclass(frozen=True)
class StylePolicy:
    """Joins by uniting the schemas."""

    schema: css.Schema
    rewrite: AttributePolicy | None = None

    def __call__(self, element: str, attribute: str, value: str) -> str | None:
        rewrite = self.rewrite and (lambda url: self.rewrite(element, "style", url))
        return css.sanitize_css(value, self.schema, rewrite)


@dataclass(frozen=True)
class RelPolicy:
    """The rel of links: what is required, what is skipped; joins by uniting both."""

    require: tuple[str, ...] = ()
    skip: frozenset[str] = frozenset()

    def __call__(self, element: str, attrs: list[list[str]]) -> str:
        names = [a[0] for a in attrs]
        if "href" not in names:
            return element
        rels = next((a[1] for a in attrs if a[0] == "rel"), "")
        found = [T.ascii_lower(r) for r in re.split("[ \t\n\f\r]+", rels) if r]
        wanted = [r for r in found if r not in self.skip] + [r for r in self.require if r not in self.skip]
        if "target" in names:
            wanted += [r for r in ("noopener", "noreferrer") if r not in self.skip]
        value = " ".join(dict.fromkeys(wanted))
        if "rel" in names:
            attrs[:] = [[n, value] if n == "rel" else [n, v] for n, v in attrs if n != "rel" or value]
        elif value:
            attrs.append(["rel", value])
        return element


def _joined(policies: Iterable) -> tuple:
    """In order and once each; a rejection alone if there is one; styles and rels united, and last."""
    plain, styles, rels = [], [], []
    for p in policies:
        if p is reject:
            return (reject,)
        if p is identity or p in plain:
            continue
        (styles if isinstance(p, StylePolicy) else rels if isinstance(p, RelPolicy) else plain).append(p)
    if styles:
        schema = styles[0].schema
        for s in styles[1:]:
            schema = schema.union(s.schema)
        rewrites = [s.rewrite for s in styles if s.rewrite]
        plain.append(StylePolicy(schema, _chain(rewrites) if rewrites else None))
    if rels:
        plain.append(RelPolicy(tuple(dict.fromkeys(r for p in rels for r in p.require)), frozenset().union(*(p.skip for p in rels))))
    return tuple(plain)


def _chain(policies: list[AttributePolicy]) -> AttributePolicy:
    if len(policies) == 1:
        return policies[0]
    return lambda e, a, v: _through(policies, e, a, v)


def _through(policies: Iterable[AttributePolicy], element: str, attribute: str, value: str | None) -> str | None:
    for p in policies:
        if value is None:
            return None
        value = p(element, attribute, value)
    return value


def skip_and(left: str, right: str) -> str:
    """The right one if it is explicit."""
    return right if right in (SKIP, DO_NOT_SKIP) else left


@dataclass(frozen=True)
class Rule:
    """An allowed element: its policies, its attributes' policies, and what happens to it without attributes."""

    policies: tuple
    attributes: dict[str, tuple]
    skip: str

    def joined(self, other: Rule) -> Rule:
        names = dict.fromkeys([*self.attributes, *other.attributes])
        attrs = {n: _joined((*self.attributes.get(n, ()), *other.attributes.get(n, ()))) for n in names}
        return Rule(_joined((*self.policies, *other.policies)), attrs, skip_and(self.skip, other.skip))

    def with_globals(self, globals_: dict[str, tuple]) -> Rule:
        if not globals_:
            return self
        names = dict.fromkeys([*self.attributes, *globals_])
        return Rule(self.policies, {n: _joined((*self.attributes.get(n, ()), *globals_.get(n, ()))) for n in names}, self.skip)


@dataclass(frozen=True)
class Discard:
    """A tag that was dropped, or attributes that an allowed tag lost."""

    element: str
    attributes: tuple[str, ...] = ()

    @property
    def kind(self) -> str:
        return "attributes" if self.attributes else "tag"


@dataclass(frozen=True)
class Result:
    html: str
    discards: list[Discard]
    errors: list[str]


@dataclass(frozen=True)
class Policy:
    """A compiled policy."""

    elements: dict[str, Rule]
    text_containers: frozenset[str]
    global_attributes: dict[str, tuple] = field(default_factory=dict)
    pre: tuple[Processor, ...] = ()
    post: tuple[Processor, ...] = ()

    def and_(self, other: Policy) -> Policy:
        """What either allows; where both have a policy, a value passes both."""
        out = {}
        for name in dict.fromkeys([*self.elements, *other.elements]):
            a, b = self.elements.get(name), other.elements.get(name)
            out[name] = a.joined(b) if a and b else a.with_globals(other.global_attributes) if a else b.with_globals(self.global_attributes)
        names = dict.fromkeys([*self.global_attributes, *other.global_attributes])
        shared = {n: _joined((*self.global_attributes.get(n, ()), *other.global_attributes.get(n, ()))) for n in names}
        return Policy(out, self.text_containers | other.text_containers, shared, self.pre + other.pre, self.post + other.post)

    def apply(self, events: Iterable[Event], discards: list[Discard] | None = None) -> Iterator[Event]:
        return _Application(self, discards).run(events)

    def events(self, html: str | None, discards: list[Discard] | None = None, limit: int = NESTING_LIMIT) -> Iterable[Event]:
        """What the policy lets through; ``discards`` gets what it doesn't, as the events are read."""
        events: Iterable[Event] = events_of(html or "")
        for p in self.pre:
            events = p(events)
        events = self.apply(balanced(events, limit), discards)
        for p in self.post:
            events = p(events)
        return events

    def process(self, html: str | None, limit: int = NESTING_LIMIT, strict: bool = False) -> Result:
        """The result for a document; if ``strict``, the renderer's first error is raised."""
        discards: list[Discard] = []
        out, errors = render(self.events(html, discards, limit))
        if strict and errors:
            raise ValueError(errors[0])
        return Result(out, discards, errors)

    def audit(self, html: str | None, limit: int = NESTING_LIMIT) -> list[Discard]:
        """The discards, without rendering."""
        discards: list[Discard] = []
        for _ in self.events(html, discards, limit):
            pass
        return discards

    def sanitize(self, html: str | None, limit: int = NESTING_LIMIT, strict: bool = False) -> str:
        return self.process(html, limit, strict).html


class _Application:
    def __init__(self, policy: Policy, discards: list[Discard] | None):
        self.p, self.discards = policy, discards
        self.stack: list[tuple[str, str | None]] = []
        self.mute = False

    def _open(self, e: Event) -> Iterator[Event]:
        rule = self.p.elements.get(e.name)
        name, attrs = None, []
        if rule is not None:
            for k, v in e.attrs:
                policies = rule.attributes.get(k)
                value = None if policies is None else _through(policies, e.name, k, v)
                if value is not None and k not in [a[0] for a in attrs]:
                    attrs.append([k, value])
            name = e.name
            for policy in rule.policies:
                name = policy(name, attrs)
                if name is None:
                    break
            name = None if name is None else T.element_name(name)
            if name is not None and not attrs and rule.skip in (SKIP, SKIP_BY_DEFAULT):
                name = None
        if self.discards is not None:
            if name != e.name:
                self.discards.append(Discard(e.name))
            else:
                lost = [k for k, _ in e.attrs if k not in [a[0] for a in attrs]]
                if lost:
                    self.discards.append(Discard(e.name, tuple(dict.fromkeys(lost))))
        if e.name not in T.VOID:
            self.stack.append((e.name, name))
        if name is None:
            self.mute = e.name in _DROPS_TEXT if e.name not in T.VOID else self.mute
            return
        if name not in T.VOID:
            self.mute = name not in self.p.text_containers
        yield Event("open", name, tuple(map(tuple, attrs)))

    def _close(self, e: Event) -> Iterator[Event]:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == e.name:
                break
        else:
            return
        for _, name in reversed(self.stack[at:]):
            if name is not None:
                yield Event("close", name)
        del self.stack[at:]
        inner = next((name for _, name in reversed(self.stack) if name is not None), None)
        self.mute = inner is not None and inner not in self.p.text_containers

    def _text(self, e: Event) -> Iterator[Event]:
        if self.mute:
            return
        raw = any(name in T.RAW_TEXT and name in self.p.text_containers for _, name in self.stack if name)
        yield Event("text", text=without_tags(e.text, self.p.elements)) if raw and "<" in e.text else e

    def run(self, events: Iterable[Event]) -> Iterator[Event]:
        for e in events:
            yield from (self._open(e) if e.kind == "open" else self._close(e) if e.kind == "close" else self._text(e))
        for _, name in reversed(self.stack):
            if name is not None:
                yield Event("close", name)


_TAG = re.compile("<([^>]*)>")


def _named(body: str) -> tuple[bool, str | None]:
    """Whether a tag closes, and its element; None if it isn't a tag."""
    trimmed = body.strip()
    closes = trimmed.startswith("/")
    word = trimmed[1:].split(None, 1)[0] if closes and trimmed[1:].split() else trimmed.split(None, 1)[0] if trimmed else ""
    start = trimmed[1:2] if closes else trimmed[:1]
    return closes, T.element_name(word) if start.isalpha() else None


def without_tags(text: str, allowed: dict[str, Rule]) -> str:
    """Raw text without the tags of other elements and what they hold."""
    out, at = [], 0
    while (left := text.find("<", at)) >= 0:
        out.append(text[at:left])
        m = _TAG.match(text, left)
        if m is None:
            at = left + 1
            continue
        at = m.end()
        _, name = _named(m[1])
        if name is None or name in allowed:
            out.append(m[0])
            continue
        if m[1].startswith("/"):
            continue
        depth = 1
        while depth:
            left = text.find("<", at)
            inner = _TAG.match(text, left) if left >= 0 else None
            if inner is None:
                at = len(text)
                break
            at = inner.end()
            closes, other = _named(inner[1])
            if other == name:
                depth += -1 if closes else 1
    out.append(text[at:])
    return "".join(out)


class Attributes:
    """Attribute names on their way into a builder."""

    def __init__(self, builder: PolicyBuilder, names: Iterable[str]):
        self._b, self._names, self._policies = builder, [T.attribute_name(n) for n in names], []

    def matching(self, test) -> Attributes:
        """A regular expression (whole value), values (a set or list), a predicate of the value, or an attribute policy."""
        if isinstance(test, str):
            test = re.compile(test)
        if isinstance(test, re.Pattern):
            pattern = test
            self._policies.append(lambda e, a, v: v if pattern.fullmatch(v) else None)
        elif isinstance(test, (set, frozenset, list, tuple)):
            values = frozenset(test)
            self._policies.append(lambda e, a, v: v if v in values else None)
        else:
            self._policies.append(lambda e, a, v: v if test(v) else None)
        return self

    def matching_ignore_case(self, *values: str) -> Attributes:
        wanted = frozenset(map(T.ascii_lower, values))
        self._policies.append(lambda e, a, v: T.ascii_lower(v) if T.ascii_lower(v) in wanted else None)
        return self

    def through(self, policy: AttributePolicy) -> Attributes:
        self._policies.append(policy)
        return self

    def globally(self) -> PolicyBuilder:
        if "style" in self._names and self._policies != [reject]:
            self._b.allow_styling()
        for n in self._names:
            self._b._globals[n] = _joined((*self._b._globals.get(n, ()), *(self._policies or [lambda e, a, v: v])))
        return self._b

    def on_elements(self, *elements: str) -> PolicyBuilder:
        for e in map(T.element_name, elements):
            own = self._b._attributes.setdefault(e, {})
            for n in self._names:
                own[n] = _joined((*own.get(n, ()), *(self._policies or [keep_value])))
        return self._b


def keep_value(element: str, attribute: str, value: str) -> str:
    return value


def integer(element: str, attribute: str, value: str) -> str | None:
    """Digits up to a point."""
    m = re.match(r"([0-9]+)(?:\..*)?\Z", value, re.S)
    return m[1] if m else None


class PolicyBuilder:
    """Everything is denied that isn't allowed, and what is disallowed stays so, whatever the order."""

    def __init__(self) -> None:
        self._elements: dict[str, tuple] = {}
        self._attributes: dict[str, dict[str, tuple]] = {}
        self._globals: dict[str, tuple] = {}
        self._text: dict[str, bool] = {}
        self._skip: dict[str, str] = {}
        self._protocols: set[str] = set()
        self._schema: css.Schema | None = None
        self._style_urls: AttributePolicy = reject
        self._require: list[str] = []
        self._skip_rels: list[str] = []
        self._pre: tuple[Processor, ...] = ()
        self._post: tuple[Processor, ...] = ()

    def allow_elements(self, *names: str, policy: ElementPolicy = identity) -> PolicyBuilder:
        for n in map(T.element_name, names):
            old = self._elements.get(n)
            self._elements[n] = _joined((policy,)) if old is None else _joined((*old, policy))
            own = n if n in T.PLACE else T.UNKNOWN
            if policy is not reject and own in T.PLAIN_TEXT_ELEMENTS and n != "iframe":
                self._text.setdefault(n, True)
        return self

    def disallow_elements(self, *names: str) -> PolicyBuilder:
        return self.allow_elements(*names, policy=reject)

    def allow_formatting(self) -> PolicyBuilder:
        return self.allow_elements(*_FORMATTING)

    def allow_blocks(self) -> PolicyBuilder:
        return self.allow_elements(*_BLOCKS)

    def allow_text_in(self, *names: str) -> PolicyBuilder:
        self._text |= dict.fromkeys(map(T.element_name, names), True)
        return self

    def disallow_text_in(self, *names: str) -> PolicyBuilder:
        self._text |= dict.fromkeys(map(T.element_name, names), False)
        return self

    def allow_without_attributes(self, *names: str) -> PolicyBuilder:
        self._skip |= dict.fromkeys(map(T.element_name, names), DO_NOT_SKIP)
        return self

    def disallow_without_attributes(self, *names: str) -> PolicyBuilder:
        self._skip |= dict.fromkeys(map(T.element_name, names), SKIP)
        return self

    def allow_attributes(self, *names: str) -> Attributes:
        return Attributes(self, names)

    def disallow_attributes(self, *names: str) -> Attributes:
        return Attributes(self, names).through(reject)

    def require_rels_on_links(self, *rels: str) -> PolicyBuilder:
        return self._rels(rels, self._require, self._skip_rels)

    def skip_rels_on_links(self, *rels: str) -> PolicyBuilder:
        return self._rels(rels, self._skip_rels, self._require)

    def _rels(self, rels: Iterable[str], into: list[str], out_of: list[str]) -> PolicyBuilder:
        for r in map(T.ascii_lower, rels):
            if any(c in HTML_SPACE for c in r):
                raise ValueError(f"a space in {r!r}")
            if r not in into:
                into.append(r)
            if r in out_of:
                out_of.remove(r)
        return self

    def require_nofollow(self) -> PolicyBuilder:
        return self.require_rels_on_links("nofollow")

    def allow_protocols(self, *names: str) -> PolicyBuilder:
        self._protocols |= set(map(T.ascii_lower, names))
        return self

    def disallow_protocols(self, *names: str) -> PolicyBuilder:
        self._protocols -= set(map(T.ascii_lower, names))
        return self

    def allow_standard_protocols(self) -> PolicyBuilder:
        return self.allow_protocols("http", "https", "mailto")

    def allow_styling(self, schema: css.Schema = css.DEFAULT_SCHEMA) -> PolicyBuilder:
        self._schema = schema if self._schema is None else self._schema.union(schema)
        if "style" not in self._globals:
            self._globals["style"] = (keep_value,)
        return self

    def allow_urls_in_styles(self, policy: AttributePolicy) -> PolicyBuilder:
        self._style_urls = policy
        return self

    def with_preprocessor(self, p: Processor) -> PolicyBuilder:
        self._pre += (p,)
        return self

    def with_postprocessor(self, p: Processor) -> PolicyBuilder:
        self._post += (p,)
        return self

    def build(self) -> Policy:
        own_url = url_filter(frozenset(self._protocols))
        url: AttributePolicy = lambda e, a, v: own_url(v)
        guards: dict[str, AttributePolicy] = dict.fromkeys(_URL_ATTRIBUTES, url) | {"srcset": lambda e, a, v: srcset(v, own_url)}
        if self._schema is not None:
            style_urls = self._style_urls
            guards["style"] = StylePolicy(self._schema, None if style_urls is reject else lambda e, a, v: _through((style_urls, url), e, a, v))

        def rejected(policies: tuple) -> bool:
            return policies == (reject,)

        shared = {n: _joined((*([guards[n]] if n in guards else []), *p)) for n, p in self._globals.items()}
        elements = {}
        for name, policies in self._elements.items():
            if name == "a":
                policies = _joined((*policies, RelPolicy(tuple(self._require), frozenset(self._skip_rels))))
            if rejected(policies):
                continue
            attrs = {}
            for n in dict.fromkeys([*self._attributes.get(name, {}), *shared]):
                own = self._attributes.get(name, {}).get(n, ())
                guard = () if n in shared or n not in guards else (guards[n],)
                joined = _joined((*own, *shared[n])) if n in shared else _joined((*guard, *own))
                if not rejected(joined):
                    attrs[n] = joined
            default = SKIP_BY_DEFAULT if name in _SKIP_EMPTY else DO_NOT_SKIP_BY_DEFAULT
            elements[name] = Rule(policies, attrs, self._skip.get(name, default))
        return Policy(elements, frozenset(n for n, yes in self._text.items() if yes), {n: p for n, p in shared.items() if not rejected(p)}, self._pre, self._post)


FORMATTING = PolicyBuilder().allow_formatting().build()
BLOCKS = PolicyBuilder().allow_blocks().build()
STYLES = PolicyBuilder().allow_styling().build()
LINKS = PolicyBuilder().allow_standard_protocols().allow_elements("a").allow_attributes("href").on_elements("a").require_nofollow().build()
TABLES = (
    PolicyBuilder().allow_standard_protocols().allow_elements("table", "tr", "td", "th", "colgroup", "caption", "col", "thead", "tbody", "tfoot")
    .allow_attributes("summary").on_elements("table")
    .allow_attributes("align", "valign").on_elements("table", "tr", "td", "th", "colgroup", "col", "thead", "tbody", "tfoot").allow_text_in("table").build()
)
IMAGES = (
    PolicyBuilder().allow_protocols("http", "https").allow_elements("img").allow_attributes("alt", "src").on_elements("img")
    .allow_attributes("border", "height", "width").through(integer).on_elements("img").build()
)
