"""Decoding and encoding of text and attribute values."""

from __future__ import annotations

import re
from html.entities import html5

LONGEST = max(map(len, html5))
_BANNED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
_NUMERIC = re.compile(r"#([xX]?)([0-9A-Za-z-]*)(;?)")
_NAME = re.compile(r"[0-9A-Za-z]+;?")
_TEMPLATE_PCDATA, _TEMPLATE_OTHER = "{<!-- -->", "{\u200b"
_ESCAPES = {'"': "&#34;", "&": "&amp;", "'": "&#39;", "+": "&#43;", "<": "&lt;", "=": "&#61;", ">": "&gt;", "@": "&#64;", "`": "&#96;"}
_SPECIAL = re.compile("[\"&'+<=>@`\u1fef\ufe60-\U0010ffff]|\\{(?=\\{|\\Z)")
#: A joiner before a vowel sign lets some renderers run out of memory: fixed values.
_JOINER = re.compile("\u200c(?=[\u093a-\u094f\u0985-\u0994\u09be-\u09cb\u09e0-\u09e3\u0c05-\u0c14\u0c3e-\u0c47\u0c49-\u0c4c])")


def joins(before: str, after: str) -> bool:
    """Whether a joiner that ends one text would stand before such a vowel sign in the next."""
    return before.endswith("\u200c") and _JOINER.match("\u200c" + after[:1]) is not None


def strip_banned(s: str) -> str:
    """Without control characters, lone surrogates and noncharacters; halves of a pair are joined first."""
    if _BANNED.search(s) is None:
        return s
    if any("\ud800" <= c <= "\udfff" for c in s):
        s = s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass") if _paired(s) else s
    return _BANNED.sub("", s)


def _paired(s: str) -> bool:
    return re.search("[\ud800-\udbff][\udc00-\udfff]", s) is not None


def _join_pairs(s: str) -> str:
    return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda m: chr(0x10000 + (ord(m[0][0]) - 0xD800) * 0x400 + ord(m[0][1]) - 0xDC00), s)


def _int32(digits: str, base: int) -> int | None:
    """The number as 32-bit arithmetic gives it, None for a digit of another base."""
    n = 0
    for d in digits:
        v = int(d, 36) if d.isalnum() else base
        if v >= base:
            return None
        n = (n * base + v) & 0xFFFFFFFF
    return n - (1 << 32) if n >> 31 else n


def _entity(s: str, at: int, in_attribute: bool) -> tuple[str, int]:
    """What the reference at ``at`` stands for, and where the text goes on."""
    limit = min(len(s), at + 2 + LONGEST)
    if len(s) - at < 3:
        return "&", at + 1
    if s[at + 1] == "#":
        m = _NUMERIC.match(s, at + 1, limit)
        hex_, digits = m[1], m[2]
        n = _int32(digits, 16 if hex_ else 10) if digits else None
        if n is None or n < 0:
            return "&", at + 1
        return (chr(n) if n <= 0x10FFFF else "\ufffd"), m.end()
    m = _NAME.match(s, at + 1, limit)
    if m is None:
        return "&", at + 1
    word = m[0]
    for name in (word, word.translate({c: c + 32 for c in range(65, 91)})):
        for n in range(len(name), 0, -1):
            found = html5.get(name[:n])
            if found is not None:
                after = at + 1 + n
                if in_attribute and name[n - 1] != ";" and after < len(s) and (s[after] == "=" or s[after].isascii() and s[after].isalnum()):
                    return "&", at + 1
                return found, after
    return "&", at + 1


def decode(s: str, in_attribute: bool = False) -> str:
    if "&" not in s:
        return strip_banned(s)
    out, at = [], 0
    while (amp := s.find("&", at)) >= 0:
        out.append(s[at:amp])
        text, at = _entity(s, amp, in_attribute)
        out.append(text)
    out.append(s[at:])
    return strip_banned(_join_pairs("".join(out)))


def _encode(s: str, template: str) -> str:
    s = _JOINER.sub("", strip_banned(s))

    def one(m: re.Match) -> str:
        c = m[0]
        if c in _ESCAPES:
            return _ESCAPES[c]
        if c == "{":
            return template
        n = ord(c)
        return f"&#{n};" if n == 0x1FEF else f"&#x{n:x};"

    return _SPECIAL.sub(one, s)


def encode_pcdata(s: str) -> str:
    return _encode(s, _TEMPLATE_PCDATA)


def encode_rcdata(s: str) -> str:
    return _encode(s, _TEMPLATE_OTHER)


encode_attribute = encode_rcdata
