"""String functions of the engine as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedgerow.kernel import tables as T

HTML_SPACE = " \t\n\f\r"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def equals_ignore_case(a: Column, b: Column) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def html_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(HTML_SPACE))


def is_blank(c: Column) -> Column:
    return c.rlike(r"\A[ \t\n\f\r]*\z")


def contains_html_space(c: Column) -> Column:
    return c.rlike(r"[ \t\n\f\r]")


def element_name(c: Column) -> Column:
    return F.when(c.contains(":") | c.isin(*T.MIXED_ELEMENTS), c).otherwise(ascii_lower(c))


def attribute_name(c: Column) -> Column:
    return F.when(c.contains(":") | c.isin(*T.MIXED_ATTRIBUTES), c).otherwise(ascii_lower(c))


def valid_name(c: Column) -> Column:
    """Letters, digits, inner hyphens and underscores and one inner colon, up to 128 characters."""
    return c.rlike(r"\A[A-Za-z](?:[0-9A-Za-z]|[-_](?!\z)|:(?!\z)(?!.*:))*\z") & (F.length(c) <= 128)


def safe_name(c: Column) -> Column:
    return F.when(c.isin("xmp", "listing", "plaintext"), F.lit("pre")).otherwise(c)


def escaping_mode(c: Column) -> Column:
    return (
        F.when(c == "plaintext", F.lit("PLAIN_TEXT")).when(c.isin(*T.CDATA), F.lit("CDATA")).when(c.isin(*T.RCDATA), F.lit("RCDATA"))
        .when(c.isin(*T.VOID), F.lit("VOID")).otherwise(F.lit("PCDATA"))
    )


def strip_banned(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "")


_ENTITIES = (('"', "&#34;"), ("'", "&#39;"), ("+", "&#43;"), ("<", "&lt;"), ("=", "&#61;"), (">", "&gt;"), ("@", "&#64;"), ("`", "&#96;"))


def _encoded(c: Column, brace: str) -> Column:
    out = F.replace(strip_banned(c), F.lit("&"), F.lit("&amp;"))
    for plain, entity in _ENTITIES:
        out = F.replace(out, F.lit(plain), F.lit(entity))
    out = F.regexp_replace(out, r"\{(?=\{|\z)", "{" + brace)
    # what has no short form, from U+FE60 on
    special = r"[\u1fef\ufe60-\x{10ffff}]"
    one = F.transform(F.split(out, "(?<=" + special + ")|(?=" + special + ")"), lambda p: F.when(p == "\u1fef", "&#8175;").when(p.rlike(special), F.concat(F.lit("&#x"), _code_point(p), F.lit(";"))).otherwise(p))
    return F.when(out.rlike(special), F.array_join(one, "")).otherwise(out)


def _code_point(c: Column) -> Column:
    """Hexadecimal digits of a character's number, from its UTF-32 form."""
    return F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0+", ""))


def only_references(c: Column, *names: str) -> Column:
    """HTML in which nothing but these named references, each with its semicolon, is decoded later: other ampersands stand for themselves."""
    return F.regexp_replace(c, f"&(?!(?:{'|'.join(names)});)", "&amp;")


def encode_pcdata(c: Column) -> Column:
    return _encoded(c, "<!-- -->")


def encode_attribute(c: Column) -> Column:
    return _encoded(c, "\u200b")


def numeric_entity(code: Column) -> Column:
    return F.when(code < 100, F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))).otherwise(F.concat(F.lit("&#x"), F.lower(F.hex(code)), F.lit(";")))


def url_scheme(c: Column) -> Column:
    """The protocol in lower case, '' without one."""
    return ascii_lower(F.regexp_extract(html_trim(c), r"\A([^/#?:]*):", 1))


def url_allowed(c: Column, protocols: Iterable[str]) -> Column:
    own = sorted(set(protocols))
    has = html_trim(c).rlike(r"\A[^/#?:]*:")
    host = F.lit("http" in own and "https" in own) | ~html_trim(c).startswith("//")
    return F.when(has, url_scheme(c).isin(*own) if own else F.lit(False)).otherwise(host)


def normalize_uri(c: Column) -> Column:
    """Parentheses, braces and spaces in percent form."""
    out = c
    for plain, hexed in (("(", "%28"), (")", "%29"), ("{", "%7b"), ("}", "%7d"), (" ", "%20"), ("\t", "%09"), ("\n", "%0a"), ("\r", "%0d"), ("\f", "%0c"), ("\x00", "")):
        out = F.replace(out, F.lit(plain), F.lit(hexed))
    return out


def integer_prefix(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?s)\A([0-9]+)(\..*)?\z", 1)
    return F.when(found != "", found)


def float_prefix(c: Column) -> Column:
    """The number that a string begins with, '' if it is none; a dangling point or exponent spoils it."""
    return F.regexp_extract(c, r"\A-?(?:[0-9]*+\.[0-9]++|[0-9]++(?!\.))(?:[eE][+-]?[0-9]++|(?![eE]))", 0)


def link_rel(rel: Column, has_target: Column, require: Iterable[str] = (), skip: Iterable[str] = ()) -> Column:
    skipped = F.array(*map(F.lit, skip)).cast("array<string>")
    own = F.filter(F.split(ascii_lower(F.coalesce(rel, F.lit(""))), r"[ \t\n\f\r]+"), lambda r: r != "")
    wanted = F.concat(own, F.array(*map(F.lit, require)).cast("array<string>"), F.when(has_target, F.array(F.lit("noopener"), F.lit("noreferrer"))).otherwise(F.array().cast("array<string>")))
    kept = F.array_except(F.array_distinct(wanted), skipped)
    return F.when(F.size(kept) > 0, F.array_join(kept, " "))
