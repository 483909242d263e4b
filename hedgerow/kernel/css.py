"""Style attributes: declarations whose properties and values a schema allows, written anew."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from hedgerow.kernel.tables import ascii_lower

QUANTITY, HASH, NEGATIVE, STRING, URL, WORD = 1, 2, 4, 8, 16, 64
MAX_URL = 1024
#: Units of quantities.
UNITS = frozenset("em ex ch rem vh vw vmin vmax px mm cm in pt pc deg rad grad turn s ms hz khz dpi dpcm dppx".split())


class Property(NamedTuple):
    bits: int
    literals: frozenset[str]
    functions: dict[str, str]  # from a function's name to the property that rules its arguments


#: The named colours.
_COLORS = """
aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue chartreuse chocolate coral
cornflowerblue cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkkhaki darkmagenta darkolivegreen darkorange darkorchid darkred
darksalmon darkseagreen darkslateblue darkslategray darkturquoise darkviolet deeppink deepskyblue dimgray dodgerblue firebrick floralwhite forestgreen
fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow honeydew hotpink indianred indigo ivory khaki lavender lavenderblush lawngreen
lemonchiffon lightblue lightcoral lightcyan lightgoldenrodyellow lightgreen lightgrey lightpink lightsalmon lightseagreen lightskyblue lightslategray
lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine mediumblue mediumorchid mediumpurple mediumseagreen mediumslateblue
mediumspringgreen mediumturquoise mediumvioletred midnightblue mintcream mistyrose moccasin navajowhite navy oldlace olive olivedrab orange orangered
orchid palegoldenrod palegreen paleturquoise palevioletred papayawhip peachpuff peru pink plum powderblue purple red rosybrown royalblue saddlebrown salmon
sandybrown seagreen seashell sienna silver skyblue slateblue slategray snow springgreen steelblue tan teal thistle tomato turquoise violet wheat white
whitesmoke yellow yellowgreen
"""
_COLOR_FUNCTIONS = "rgb rgba hsl hsla"
_IMAGES = "image linear-gradient radial-gradient repeating-linear-gradient repeating-radial-gradient"
_LINES = "dashed dotted double groove outset ridge solid"
_FULL_LINE = f"{_LINES} hidden inherit inset none"
_BACKGROUND = ", / auto center fixed inherit local none repeat scroll transparent border-box contain content-box cover padding-box no-repeat repeat-x repeat-y round space bottom top left right"
_LIST_TYPES = """
armenian cjk-decimal decimal decimal-leading-zero disc disclosure-closed disclosure-open ethiopic-numeric georgian hebrew hiragana hiragana-iroha
japanese-formal japanese-informal katakana katakana-iroha korean-hangul-formal korean-hanja-formal korean-hanja-informal lower-alpha lower-greek lower-latin
lower-roman simp-chinese-formal simp-chinese-informal square trad-chinese-formal trad-chinese-informal upper-alpha upper-latin upper-roman circle inherit none
"""
_SIZES = "large larger small smaller x-large x-small xx-large xx-small xxx-large medium"
_FAMILIES = "cursive fantasy monospace sans-serif serif"
_WEIGHTS = "100 200 300 400 500 600 700 800 900 bold bolder lighter"
_SIDES = ("bottom", "left", "right", "top")
_CORNERS = [(v, h) for v in ("bottom", "top") for h in ("left", "right")]

#: Properties (those with + are defined and not in the default schema), bits, literals, functions.
_DEFINED: list[tuple[str, int, str, str]] = [
    ("-moz-border-radius -webkit-border-radius border-radius", 5, "/", ""),
    (" ".join([f"-moz-border-radius-{v}{h} -webkit-border-{v}-{h}-radius -webkit-border-radius-{v}-{h} border-{v}-{h}-radius" for v, h in _CORNERS]), 5, "", ""),
    ("-moz-box-shadow -webkit-box-shadow box-shadow text-shadow", 7, f", inset none {_COLORS}", _COLOR_FUNCTIONS),
    ("-moz-opacity+ opacity+ padding " + " ".join(f"padding-{s}" for s in _SIDES), 1, "inherit", ""),
    ("-moz-outline outline", 7, f"{_COLORS} {_LINES} thick thin hidden inherit inset invert medium none", _COLOR_FUNCTIONS),
    ("-moz-outline-color outline-color", 2, f"{_COLORS} inherit invert", _COLOR_FUNCTIONS),
    ("-moz-outline-style outline-style border-style " + " ".join(f"border-{s}-style" for s in _SIDES), 0, _FULL_LINE, ""),
    ("-moz-outline-width outline-width border-width " + " ".join(f"border-{s}-width" for s in _SIDES), 5, "thick thin inherit medium", ""),
    ("-o-text-overflow text-overflow", 0, "clip ellipsis", ""),
    ("azimuth", 5, "behind center-left center-right far-left far-right left-side leftwards right-side rightwards left right center inherit", ""),
    ("background", 23, f"{_BACKGROUND} {_COLORS}", f"{_IMAGES} {_COLOR_FUNCTIONS}"),
    ("background-attachment", 0, ", fixed local scroll", ""),
    ("background-color", 2, f"inherit transparent {_COLORS}", _COLOR_FUNCTIONS),
    ("background-image", 16, ", none", _IMAGES),
    ("background-position", 5, "left right bottom top , center", ""),
    ("background-repeat", 0, "no-repeat repeat-x repeat-y round space , repeat", ""),
    ("border " + " ".join(f"border-{s}" for s in _SIDES), 7, f"hidden inherit inset medium none transparent {_COLORS} {_LINES} thick thin", _COLOR_FUNCTIONS),
    ("border-color " + " ".join(f"border-{s}-color" for s in _SIDES), 2, f"inherit transparent {_COLORS}", _COLOR_FUNCTIONS),
    ("border-collapse", 0, "collapse inherit separate", ""),
    ("border-spacing pause pause-after pause-before pitch-range richness stress text-indent", 5, "inherit", ""),
    ("bottom+ height left+ right+ top+ z-index+", 5, "auto inherit", ""),
    ("caption-side", 0, "bottom top inherit", ""),
    ("clear+", 0, "left right both inherit none", ""),
    ("clip+", 0, "auto inherit", "rect"),
    ("color", 2, f"inherit {_COLORS}", _COLOR_FUNCTIONS),
    ("content+", 8, "none normal", ""),
    ("cue cue-after cue-before", 16, "inherit none", ""),
    ("cursor+", 16, "all-scroll col-resize crosshair default e-resize hand help move n-resize ne-resize no-drop not-allowed nw-resize pointer progress row-resize s-resize se-resize sw-resize text vertical-text w-resize wait , auto inherit", ""),
    ("direction", 0, "ltr rtl inherit", ""),
    ("display+", 0, "inherit none -moz-inline-box -moz-inline-stack block inline inline-block inline-table list-item run-in table table-caption table-cell table-column table-column-group table-footer-group table-header-group table-row table-row-group", ""),
    ("elevation", 5, "above below higher level lower inherit", ""),
    ("empty-cells", 0, "hide show inherit", ""),
    ("float+", 0, "left right inherit none", ""),
    ("font", 73, f"{_WEIGHTS} {_SIZES} caption icon menu message-box small-caption status-bar {_FAMILIES} italic oblique , / inherit medium normal small-caps", ""),
    ("font-family", 72, f", inherit {_FAMILIES}", ""),
    ("font-size", 1, f"{_SIZES} inherit medium", ""),
    ("font-stretch", 0, "condensed expanded extra-condensed extra-expanded narrower semi-condensed semi-expanded ultra-condensed ultra-expanded wider normal", ""),
    ("font-style", 0, "italic oblique inherit normal", ""),
    ("font-variant", 0, "inherit normal small-caps", ""),
    ("font-weight", 0, f"{_WEIGHTS} inherit normal", ""),
    ("letter-spacing word-spacing", 5, "inherit normal", ""),
    ("line-height", 1, "inherit normal", ""),
    ("list-style", 16, f"{_LIST_TYPES} inside outside", _IMAGES),
    ("list-style-image", 16, "inherit none", _IMAGES),
    ("list-style-position", 0, "inside outside inherit", ""),
    ("list-style-type", 0, _LIST_TYPES, ""),
    ("margin min-height min-width width " + " ".join(f"margin-{s}" for s in _SIDES), 1, "auto inherit", ""),
    ("max-height max-width", 1, "auto inherit none", ""),
    ("overflow-wrap+", 0, "normal break-word anywhere inherit", ""),
    ("overflow-x+ overflow-y+", 0, "no-content no-display auto hidden scroll visible", ""),
    ("overflow+", 0, "auto hidden inherit scroll visible", ""),
    ("page-break-after+ page-break-before+", 0, "left right always auto avoid inherit", ""),
    ("page-break-inside+", 0, "auto avoid inherit", ""),
    ("pitch", 5, "inherit medium high low x-high x-low", ""),
    ("play-during+", 16, "auto inherit mix none repeat", ""),
    ("position+", 0, "inherit absolute relative static", ""),
    ("quotes", 8, "inherit none", ""),
    ("speak", 0, "inherit none normal spell-out", ""),
    ("speak-header", 0, "always inherit once", ""),
    ("speak-numeral", 0, "inherit continuous digits", ""),
    ("speak-punctuation", 0, "code inherit none", ""),
    ("speech-rate", 5, "inherit medium fast faster slow slower x-fast x-slow", ""),
    ("table-layout", 0, "auto fixed inherit", ""),
    ("text-align", 0, "left right center inherit justify", ""),
    ("text-decoration", 0, "inherit none blink line-through overline underline", ""),
    ("text-transform", 0, "inherit none capitalize lowercase uppercase", ""),
    ("text-wrap", 0, "none normal suppress unrestricted", ""),
    ("unicode-bidi", 0, "inherit normal bidi-override embed", ""),
    ("vertical-align", 5, "bottom top inherit baseline middle sub super text-bottom text-top", ""),
    ("visibility+", 0, "collapse hidden inherit visible", ""),
    ("voice-family", 8, ", inherit child female male", ""),
    ("volume", 1, "inherit medium loud silent soft x-loud x-soft", ""),
    ("white-space", 0, "inherit normal -moz-pre-wrap -o-pre-wrap -pre-wrap nowrap pre pre-line pre-wrap", ""),
    ("word-break+", 0, "break-all break-word keep-all normal", ""),
    ("word-wrap", 0, "anywhere break-word normal", ""),
    ("zoom+", 1, "normal", ""),
    ("hsl() hsla() rgb() rgba()", 1, ",", ""),
    ("image()", 18, f"{_COLORS} ,", _COLOR_FUNCTIONS),
    ("linear-gradient() repeating-linear-gradient()", 7, f"left right bottom top , to {_COLORS}", _COLOR_FUNCTIONS),
    ("radial-gradient() repeating-radial-gradient()", 7, f"left right bottom top {_COLORS} at closest-corner closest-side ellipse farthest-corner farthest-side , center circle", _COLOR_FUNCTIONS),
    ("rect()", 5, ", auto", ""),
]


def _defined() -> Iterator[tuple[str, Property, bool]]:
    for names, bits, literals, functions in _DEFINED:
        rule = Property(bits, frozenset(literals.split()), {f"{f}(": f"{f}()" for f in functions.split()})
        for name in names.split():
            yield name.rstrip("+"), rule, not name.endswith("+")


DEFINITIONS = {name: rule for name, rule, _ in _defined()}
DEFAULT_NAMES = [name for name, _, default in _defined() if default and not name.endswith("()")]


class Schema:
    """Allowed properties; the functions that they use come along."""

    def __init__(self, rules: dict[str, Property]):
        self.rules = dict(rules)
        for rule in list(rules.values()):
            for key in rule.functions.values():
                if key not in self.rules:
                    if key not in DEFINITIONS:
                        raise ValueError(f"no rule for the function {key}")
                    self.rules[key] = DEFINITIONS[key]

    @staticmethod
    def of(names: Iterable[str]) -> Schema:
        unknown = [n for n in names if n not in DEFINITIONS]
        if unknown:
            raise ValueError(f"unknown properties: {unknown}")
        return Schema({n: DEFINITIONS[n] for n in names})

    def union(self, other: Schema) -> Schema:
        for name in self.rules.keys() & other.rules.keys():
            if self.rules[name] != other.rules[name]:
                raise ValueError(f"two rules for {name}")
        return Schema(self.rules | other.rules)

    def rule(self, name: str) -> Property | None:
        """The property's rule; a vendor's prefix counts only if the whole name isn't known."""
        if name in self.rules:
            return self.rules[name]
        m = re.match(r"-(?:ms|moz|o|webkit)-(.+)\Z", name)
        return self.rules.get(m[1]) if m else None


DEFAULT_SCHEMA = Schema.of(DEFAULT_NAMES)

_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\r\n\f])?|[^\n\r\f0-9a-fA-F])"
_IDENT = rf"-?(?:[A-Za-z_\u0080-\U0010ffff]|{_ESCAPE})(?:[A-Za-z0-9_\u0080-\U0010ffff-]|{_ESCAPE})*"
#: A unit that may stand apart from its number.
_KNOWN = rf"(?i:{'|'.join(sorted(UNITS))})(?![A-Za-z0-9_\\(\u0080-\U0010ffff-])"
_TOKENS = re.compile(
    rf"""(?P<SPACE>(?:[\s\x00-\x20\ufeff]|/\*.*?(?:\*/|\Z)|//[^\n\r\f]*|<!--|-->)+)
    |(?P<URI>[uU][rR][lL]\(\s*(?:"(?:[^"\\\n\r\f]|\\.)*"|'(?:[^'\\\n\r\f]|\\.)*'|(?:[^\s"'()\\]|{_ESCAPE})*)\s*\))
    |(?P<STRING>"(?:[^"\\\n\r\f]|\\.)*"|'(?:[^'\\\n\r\f]|\\.)*')
    |(?P<NUMBER>[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+(?![A-Za-z]))?)(?P<UNIT>%|{_IDENT}|[ \t\n\r\f]+{_KNOWN})?
    |(?P<FUNCTION>{_IDENT}\()
    |(?P<IDENT>{_IDENT})
    |(?P<HASHED>\#(?:[A-Za-z0-9_\u0080-\U0010ffff-]|{_ESCAPE})+)
    |(?P<AT>@{_IDENT})
    |(?P<OPEN>[(\[{{])|(?P<CLOSE>[)\]}}])
    |(?P<MARK>.)""",
    re.X | re.S,
)


class CssToken(NamedTuple):
    kind: str
    text: str


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        body = m[0][1:]
        if body[:1] in "\n\r\f":
            return ""
        try:
            n = int(body.strip(), 16) if re.match(r"[0-9a-fA-F]", body) else -1
        except ValueError:
            return body
        return body if n < 0 else chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else "\ufffd"

    return re.sub(r"\\(?:[0-9a-fA-F]{1,6}(?:\r\n|[ \t\r\n\f])?|.|\Z)", one, s, flags=re.S)


def _normal(number: str) -> str:
    """Without a plus sign, zeros before the whole part and zeros after the fraction."""
    sign, whole, fraction, power = re.fullmatch(r"([+-]?)([0-9]*)\.?([0-9]*)((?:[eE].*)?)", number).groups()
    fraction = fraction.rstrip("0")
    return sign.replace("+", "") + (whole.lstrip("0") or "0") + ("." + fraction if fraction else "") + power.lower()


def css_tokens(css: str) -> list[CssToken]:
    """Tokens in normal form: names unescaped and in lower case, strings and URLs by their content."""
    out = []
    for m in _TOKENS.finditer(css):
        kind, text = m.lastgroup, m[0]
        if kind in ("NUMBER", "UNIT"):
            number, unit = _normal(m["NUMBER"]), ascii_lower(m["UNIT"] or "").lstrip()
            out.append(CssToken("QUANTITY" if not unit or unit == "%" or unit in UNITS else "BAD", number + unit))
        elif kind == "STRING":
            out.append(CssToken(kind, unescape(text[1:-1])))
        elif kind == "URI":
            inner = text[4:-1].strip()
            out.append(CssToken(kind, unescape(inner[1:-1] if inner[:1] in ("'", '"') else inner)))
        elif kind in ("IDENT", "FUNCTION", "HASHED", "AT"):
            out.append(CssToken(kind, ascii_lower(unescape(text)) if kind != "FUNCTION" else ascii_lower(unescape(text[:-1])) + "("))
        else:
            out.append(CssToken(kind, " " if kind == "SPACE" else text))
    return out


_PARTNER = {"(": ")", "[": "]", "{": "}"}


def _skip_group(tokens: list[CssToken], at: int) -> int:
    """Behind the bracket that closes the one at ``at``, or the end."""
    wanted = []
    while at < len(tokens):
        kind, text = tokens[at]
        if kind in ("OPEN", "FUNCTION"):
            wanted.append(_PARTNER[text[-1]])
        elif kind == "CLOSE" and wanted and text == wanted[-1]:
            wanted.pop()
            if not wanted:
                return at + 1
        at += 1
    return at


def declarations(tokens: list[CssToken]) -> Iterator[tuple[str, list[CssToken]]]:
    """Names and values; what isn't a declaration is left out up to the next semicolon or behind a group of brackets."""
    at, n = 0, len(tokens)
    while at < n:
        if tokens[at].kind == "SPACE" or tokens[at] == ("MARK", ";"):
            at += 1
            continue
        name = tokens[at]
        after = at + 1 + (at + 1 < n and tokens[at + 1].kind == "SPACE")
        if name.kind == "IDENT" and after < n and tokens[after] == ("MARK", ":"):
            at, value = after + 1, []
            while at < n and tokens[at] != ("MARK", ";"):
                if tokens[at].kind == "OPEN" and tokens[at].text == "{":
                    at = _skip_group(tokens, at)
                    continue
                end = _skip_group(tokens, at) if tokens[at].kind in ("FUNCTION", "OPEN") else at + 1
                value += tokens[at:end]
                at = end
            yield name.text, value
            continue
        while at < n and tokens[at] != ("MARK", ";"):
            grouped = tokens[at].kind in ("OPEN", "FUNCTION")
            at = _skip_group(tokens, at) if grouped else at + 1
            if grouped and tokens[at - 1].text == "}":
                break


def _quoted(s: str) -> str:
    return "'" + s + "'"


def _url(value: str, rewrite: Callable[[str], str | None] | None) -> str | None:
    found = rewrite(value) if rewrite and len(value) < MAX_URL else None
    if not found:
        return None
    return "url('" + re.sub(r"[\x00-\x20'\"()\\<>]", lambda m: f"%{ord(m[0]):02x}", found) + "')"


def _value(tokens: list[CssToken], rule: Property | None, schema: Schema, rewrite: Callable[[str], str | None] | None) -> list[str]:
    """The allowed tokens; without a rule none."""
    out: list[str] = []
    words: list[str] = []
    at = 0

    def flush() -> None:
        if words:
            out.append(_quoted(" ".join(words)))
            words.clear()

    while at < len(tokens):
        kind, text = tokens[at]
        at += 1
        if kind == "SPACE":
            continue
        if kind == "FUNCTION":
            end = _skip_group(tokens, at - 1)
            inner = tokens[at : end - 1] if tokens[end - 1].text == ")" else tokens[at:end]
            key = rule.functions.get(text) if rule else None
            if key and schema.rule(key):
                flush()
                out.append(text)
                out += _value(inner, schema.rule(key), schema, rewrite)
                out.append(")")
            at = end
            continue
        if rule is None:
            continue
        if kind == "IDENT":
            if text in rule.literals:
                flush()
                out.append(text)
            elif text == "important" and [t for t in tokens[max(at - 3, 0) : at - 1] if t.kind != "SPACE"][-1:] == [("MARK", "!")]:
                flush()
                out.append("!important")
            elif rule.bits & STRING and rule.bits & WORD and re.fullmatch("[a-z0-9-]+", text):
                words.append(text)
            continue
        flush()
        if kind == "HASHED":
            if rule.bits & HASH and re.fullmatch("#(?:[0-9a-f]{3}|[0-9a-f]{6})", text):
                out.append(text)
        elif kind == "QUANTITY":
            if text in rule.literals or rule.bits & (NEGATIVE if text.startswith("-") else QUANTITY):
                out.append(text)
        elif kind == "STRING":
            meaning = rule.bits & (WORD | URL)
            low = ascii_lower(text).strip()
            if meaning == WORD and low and re.fullmatch("[a-z0-9 -]+", low):
                out.append(_quoted(re.sub(" +", " ", low)))
            elif meaning == URL and (found := _url(text, rewrite)):
                out.append(found)
        elif kind == "URI":
            if rule.bits & URL and (found := _url(text, rewrite)):
                out.append(found)
        elif text in rule.literals:
            out.append(text)
    flush()
    return out


def sanitize_css(css: str, schema: Schema = DEFAULT_SCHEMA, rewrite: Callable[[str], str | None] | None = None) -> str | None:
    """The allowed declarations as ``name:token token;name:...``; None if none is left."""
    out = []
    for name, value in declarations(css_tokens(css)):
        rule = schema.rule(name)
        if rule and (own := _value(value, rule, schema, rewrite)):
            out.append(f"{name}:{' '.join(own)}")
    return ";".join(out) or None
