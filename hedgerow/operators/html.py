"""Sanitising, auditing and taking apart the documents of a column, one Arrow-batched function for each.

A document is a row's own work: nothing is shuffled. Null documents are empty ones, and the result is never null. Columns beside
the document are kept, so that filters and pruning on them reach the scan. A worker takes a batch in pieces, so that what it holds
as Python objects has a bound, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgerow.kernel.balance import NESTING_LIMIT, balanced
from hedgerow.kernel.lex import Event, events_of, tokens_of
from hedgerow.kernel.policy import Policy
from hedgerow.kernel.render import render

DISCARDS = "array<struct<kind:string,element:string,attributes:array<string>>>"
RESULT = f"struct<html:string,discards:{DISCARDS},errors:array<string>>"
TOKENS = "array<struct<pos:int,kind:string,start:int,end:int,text:string>>"
EVENTS = "array<struct<kind:string,name:string,attrs:array<struct<name:string,value:string>>,text:string,depth:int,parent:string>>"

#: Where rendering can change a document at all.
_CHANGES = "[<&{\"'+=>@`\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\u093a-\\x{10ffff}]"


#: Bytes of a column that are taken apart at a time; a row is never cut.
PIECE = 1 << 18


def _pieces(column: pa.Array) -> Iterator[pa.Array]:
    """The column in runs of rows of up to ``PIECE`` bytes, or of one row."""
    if len(column) > 1 and column.nbytes > PIECE:
        half = len(column) // 2
        yield from _pieces(column.slice(0, half))
        yield from _pieces(column.slice(half))
    else:
        yield column


def _by_piece(column: Column | str, kind: str, one: Callable[[object], object], arrow_type: pa.DataType) -> Column:
    """``one`` of every value. Spark's batches have up to 10,000 rows and 64 MB; only a piece of one, and of its result, is there as objects."""

    @F.arrow_udf(kind)
    def own(batch: pa.Array) -> pa.Array:
        return pa.concat_arrays(pa.array([one(x) for x in piece.to_pylist()], arrow_type) for piece in _pieces(batch))

    return own(column)


def _mapped(column: Column | str, kind: str, one: Callable[[str], object], arrow_type: pa.DataType) -> Column:
    return _by_piece(column, kind, lambda x: one(x or ""), arrow_type)


_ATTR = pa.struct([("name", pa.string()), ("value", pa.string())])
_DISCARD = pa.struct([("kind", pa.string()), ("element", pa.string()), ("attributes", pa.list_(pa.string()))])


def text_function(column: Column | str, one: Callable[[str], str | None]) -> Column:
    """A function of one string over Arrow batches; null counts as the empty string."""
    return _mapped(column, "string", one, pa.string())


def sanitize(column: Column | str, policy: Policy, limit: int = NESTING_LIMIT, strict: bool = False) -> Column:
    """The safe HTML of a column; what is nested deeper than ``limit`` is dropped. If ``strict``, an error of the renderer fails the query."""
    return _mapped(column, "string", lambda html: policy.sanitize(html, limit, strict), pa.string())


def receive(column: Column | str, policy: Policy, receiver: Callable[[Iterable[Event]], object], kind: str, arrow_type: pa.DataType) -> Column:
    """What ``receiver`` makes of the events that the policy lets through, as a sink of one's own in the renderer's place."""
    return _mapped(column, kind, lambda html: receiver(policy.events(html)), arrow_type)


def sanitize_plain(df: DataFrame, column: str, policy: Policy) -> DataFrame:
    """``df`` with the column sanitised; documents that nothing can change never leave the JVM."""
    may_change = F.coalesce(F.col(column).rlike(_CHANGES), F.lit(True))
    changed = df.where(may_change).withColumn(column, sanitize(column, policy))
    return changed.unionByName(df.where(~may_change)).select(df.columns)


def process(column: Column | str, policy: Policy) -> Column:
    """struct<html, discards, errors>."""
    kind = pa.struct([("html", pa.string()), ("discards", pa.list_(_DISCARD)), ("errors", pa.list_(pa.string()))])

    def one(html: str) -> dict:
        r = policy.process(html)
        return {"html": r.html, "discards": [{"kind": d.kind, "element": d.element, "attributes": list(d.attributes)} for d in r.discards], "errors": r.errors}

    return _mapped(column, RESULT, one, kind)


def audit(df: DataFrame, column: str, policy: Policy) -> DataFrame:
    """A row for each discard: the other columns of ``df``, seq, kind, element, attributes."""
    rest = [c for c in df.columns if c != column]

    def one(html: str) -> list:
        return [{"kind": d.kind, "element": d.element, "attributes": list(d.attributes)} for d in policy.audit(html)]

    # exploded where it is made: of a column of its own Spark infers a filter, and audits twice
    found = df.select(*rest, F.posexplode(_mapped(column, DISCARDS, one, pa.list_(_DISCARD))).alias("seq", "__d"))
    return found.select(*rest, "seq", "__d.kind", "__d.element", "__d.attributes")


def tokens(df: DataFrame, column: str, *kinds: str) -> DataFrame:
    """A row for each token, or for those of these kinds: the other columns, pos, kind, start, end (code points, end exclusive), text."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def one(html: str) -> list:
        return [{"pos": i, "kind": t.kind, "start": t.start, "end": t.end, "text": html[t.start : t.end]} for i, t in enumerate(tokens_of(html)) if not kinds or t.kind in kinds]

    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(_mapped(column, TOKENS, one, kind)).alias("__t")).select(*rest, "__t.pos", "__t.kind", "__t.start", "__t.end", "__t.text")


def _placed(html: str, balance: bool) -> list[dict]:
    out, stack = [], []
    for e in balanced(events_of(html)) if balance else events_of(html):
        if e.kind == "close" and e.name in stack:
            while stack.pop() != e.name:
                pass
        attrs = [{"name": k, "value": v} for k, v in e.attrs]
        out.append({"kind": e.kind, "name": e.name, "attrs": attrs, "text": e.text, "depth": len(stack), "parent": stack[-1] if stack else None})
        if e.kind == "open" and balance:
            from hedgerow.kernel.tables import VOID

            if e.name not in VOID:
                stack.append(e.name)
    return out


def events(df: DataFrame, column: str, balance: bool = True) -> DataFrame:
    """A row for each event: the other columns, seq, kind, name, attrs, text, depth, parent."""
    event = pa.struct([("kind", pa.string()), ("name", pa.string()), ("attrs", pa.list_(_ATTR)), ("text", pa.string()), ("depth", pa.int32()), ("parent", pa.string())])
    rest = [c for c in df.columns if c != column]
    found = df.select(*rest, F.posexplode(_mapped(column, EVENTS, lambda h: _placed(h, balance), pa.list_(event))).alias("seq", "__e"))
    return found.select(*rest, "seq", *[f"__e.{c}" for c in ("kind", "name", "attrs", "text", "depth", "parent")])


def opened(df: DataFrame, column: str, policy: Policy | None = None) -> DataFrame:
    """A row for each element that the source opens, or that what a policy makes of it does: the other columns, seq (of the events), element."""
    rest = [c for c in df.columns if c != column]

    def one(html: str) -> list:
        return [{"seq": i, "element": e.name} for i, e in enumerate(events_of(policy.sanitize(html) if policy else html)) if e.kind == "open"]

    found = _mapped(column, "array<struct<seq:int,element:string>>", one, pa.list_(pa.struct([("seq", pa.int32()), ("element", pa.string())])))
    return df.select(*rest, F.explode(found).alias("__o")).select(*rest, "__o.seq", "__o.element")


def attributes(df: DataFrame, column: str, *elements: str) -> DataFrame:
    """A row for each attribute of the source's tags, or of these elements': the other columns, seq, element, pos, name, value."""
    rest = [c for c in df.columns if c != column]
    fields = ("seq", pa.int32()), ("element", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("value", pa.string())

    def one(html: str) -> list:
        tags = ((i, e) for i, e in enumerate(events_of(html)) if e.kind == "open" and (not elements or e.name in elements))
        return [{"seq": i, "element": e.name, "pos": pos, "name": k, "value": v} for i, e in tags for pos, (k, v) in enumerate(e.attrs)]

    found = _mapped(column, "array<struct<seq:int,element:string,pos:int,name:string,value:string>>", one, pa.list_(pa.struct(fields)))
    return df.select(*rest, F.explode(found).alias("__a")).select(*rest, *[f"__a.{c}" for c, _ in fields])


def links(df: DataFrame, column: str) -> DataFrame:
    """A row for each link's target: the other columns, seq (of the source's events), href."""
    rest = [c for c in df.columns if c != column]

    def one(html: str) -> list:
        return [{"seq": i, "href": v} for i, e in enumerate(events_of(html)) if e.kind == "open" and e.name == "a" for k, v in e.attrs if k == "href"]

    found = _mapped(column, "array<struct<seq:int,href:string>>", one, pa.list_(pa.struct([("seq", pa.int32()), ("href", pa.string())])))
    return df.select(*rest, F.explode(found).alias("__l")).select(*rest, "__l.seq", "__l.href")


def rendered(df: DataFrame, events_col: str) -> DataFrame:
    """``df`` with ``html``: what a column of events (kind, name, attrs, text) renders to after balancing."""

    def one(row: list[dict] | None) -> str:
        made = [Event(e["kind"], e["name"] or "", tuple((a["name"], a["value"]) for a in e["attrs"] or []), e["text"] or "") for e in row or []]
        return render(balanced(made))[0]

    return df.withColumn("html", _by_piece(events_col, "string", one, pa.string()))
