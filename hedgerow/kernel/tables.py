"""What HTML's elements may contain, imply, close and resume, as sets built from rules."""

from __future__ import annotations

#: The elements in the order that the implied-element rule counts in.
ELEMENTS = """
a abbr acronym address applet area article aside audio b base basefont bb bdi bdo bgsound big blink blockquote body br button canvas caption center cite
code col colgroup command content data datagrid datalist dd del details dfn dialog dir div dl dt element em embed fieldset figcaption figure font footer
form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins isindex kbd keygen label legend li link listing main map mark
marquee menu menuitem meta meter multicol nav nobr noembed noframes noscript object ol optgroup option output p param picture plaintext pre progress q
rp rt rtc ruby s samp script section select shadow slot small source spacer span strike strong style sub summary sup table tbody td template textarea
tfoot th thead time title tr track tt u ul var video wbr xmp xcustom
""".split()
PLACE = {name: i for i, name in enumerate(ELEMENTS)}
UNKNOWN = "xcustom"
TEXT = "#text"

#: Content models.
NO_CONTENT = frozenset("area base basefont bgsound br col colgroup command embed frame frameset head hr html img input keygen link meta param source template track wbr".split())
COMMENTS_ONLY = frozenset("table tbody tfoot thead tr".split())
RAW_TEXT = frozenset("script style".split())
SPECIAL_TEXT = frozenset("script style iframe noembed noframes noscript xmp textarea title plaintext".split())
PLAIN_TEXT_ELEMENTS = frozenset(ELEMENTS) - NO_CONTENT - COMMENTS_ONLY - RAW_TEXT
HOLDS_TEXT = frozenset(ELEMENTS) - NO_CONTENT - COMMENTS_ONLY

#: Elements whose content is read as text up to their end tag, and those without content.
CDATA = frozenset("iframe listing xmp script style comment".split())
RCDATA = frozenset("textarea title".split())
ESCAPE_EXEMPT = CDATA | RCDATA | {"plaintext"}
VOID = frozenset("area base br col command embed hr img input keygen link meta param source track wbr basefont bgsound frame isindex".split())

_STRUCTURE = frozenset("body caption col colgroup frame frameset head html tbody td tfoot th thead tr".split())
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_EVERY = frozenset(ELEMENTS)
_FLOW = _EVERY - _STRUCTURE

#: The elements that hold no others, and those that hold only a few or all but a few.
_EMPTY = """area base basefont bgsound br col command embed frame hr iframe img input keygen link meta noembed noframes noscript param plaintext script source style
template textarea title track wbr xmp""".split()
_NOT_IN_P = """address article aside blockquote center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li
listing main menu nav ol p plaintext pre section summary table ul xmp""".split()
_ONLY = {
    "select": "optgroup option script template",
    "table": "caption col colgroup form script style tbody td template tfoot th thead tr",
    "tbody": "form script style td template th tr", "tfoot": "form script style td template th tr", "thead": "form script style td template th tr",
    "tr": "form script style td template th", "colgroup": "col template", "head": "base command link meta noscript script style title",
    "html": "body frameset head", "frameset": "frame frameset noframes",
}


def _may_contain() -> dict[str, frozenset[str]]:
    out = {name: _FLOW for name in ELEMENTS}
    out |= dict.fromkeys(_EMPTY, frozenset())
    out |= dict.fromkeys(_HEADINGS, _FLOW - _HEADINGS)
    out |= dict.fromkeys(("dd", "dt"), _FLOW - {"dd", "dt"})
    out |= {name: _FLOW - {name} for name in ("a", "button", "form", "li", "nobr")}
    out |= {"option": _FLOW - {"optgroup", "option"}, "p": _FLOW - frozenset(_NOT_IN_P)}
    out |= {name: frozenset(v.split()) for name, v in _ONLY.items()}
    return out | dict.fromkeys(("noscript", "noframes", "noembed"), _EVERY)


MAY_CONTAIN = _may_contain()

#: Formatting that is opened again after something that closed it.
RESUMED = frozenset("a b big code em font i nobr s small strike strong tt u".split())
TRANSPARENT = frozenset("a audio canvas del ins map object video".split())

#: An element, the parents that it may stand in, and what is implied elsewhere.
_WRAPPED = {
    "li": ("dir ol ul li", "ul"), "option": ("select optgroup option", "select"), "optgroup": ("select optgroup", "select"),
    "td": ("tr td th", "table tbody tr"), "th": ("tr td th", "table tbody tr"), "tr": ("tbody thead tfoot tr td th", "table tbody"),
    "tbody": ("table thead tbody tfoot", "table"), "thead": ("table thead tbody tfoot", "table"), "tfoot": ("table thead tbody tfoot", "table"),
    "caption": ("table", "table"), "colgroup": ("table", "table"), "col": ("colgroup", "table colgroup"),
}
_WRAPPERS = {e: (frozenset(p.split()), max(PLACE[x] for x in p.split()), w.split()) for e, (p, w) in _WRAPPED.items()}
_BETWEEN = {("table", "col"): ["colgroup"], ("table", "td"): ["tbody", "tr"], ("table", "th"): ["tbody", "tr"], ("table", "tr"): ["tbody"]}


def implied(parent: str, child: str) -> list[str]:
    """Elements to open in ``parent`` before ``child``. A wrapper counts only for parents up to the last allowed one in order."""
    if child in RAW_TEXT:
        return []
    if child in _WRAPPERS:
        parents, last, wrappers = _WRAPPERS[child]
        if PLACE[parent] <= last and parent not in parents:
            return wrappers
    if (parent, child) in _BETWEEN:
        return _BETWEEN[parent, child]
    if parent in ("ol", "ul") and child != "li":
        return ["li"]
    return ["li"] if parent == "select" and child != "option" else []


#: Scopes that an element ends, and the scope that an end tag looks in: fixed values.
_IN = frozenset("applet caption html table td th marquee object template".split())
BLOCKS = {
    "in": _IN, "list": _IN | {"dir", "ol", "ul"}, "button": _IN | {"button"}, "table": frozenset(["html", "table", "template"]),
    "select": _EVERY - {"optgroup", "option"},
}
BLOCKS = {k: v | {"noembed", "noframes", "noscript"} for k, v in BLOCKS.items()}
END_SCOPE = dict.fromkeys("caption col colgroup table tbody tfoot thead tr td th".split(), "table") | {"select": "select", "p": "button", "li": "list"}
HEADINGS = _HEADINGS

#: Names whose capitals count.
MIXED_ELEMENTS = frozenset("""
animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix feDiffuseLighting
feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode feMorphology feOffset
fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject linearGradient radialGradient solidColor textArea textPath
""".split())  # fmt: skip
MIXED_ATTRIBUTES = frozenset("""
attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits contentScriptType contentStyleType defaultAction definitionURL
diffuseConstant edgeMode externalResourcesRequired filterUnits focusHighlight gradientTransform gradientUnits initialVisibility kernelMatrix
kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth maskContentUnits maskUnits
mediaCharacterEncoding mediaContentEncodings mediaSize mediaTime numOctaves pathLength patternContentUnits patternTransform patternUnits
playbackOrder pointsAtX pointsAtY pointsAtZ preserveAlpha preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions
requiredFeatures requiredFonts requiredFormats schemaLocation snapshotTime specularConstant specularExponent spreadMethod startOffset stdDeviation
stitchTiles surfaceScale syncBehavior syncBehaviorDefault syncMaster syncTolerance syncToleranceDefault systemLanguage tableValues targetX targetY
textLength timelineBegin transformBehavior viewBox xChannelSelector yChannelSelector zoomAndPan
""".split())  # fmt: skip
VALUELESS = frozenset("checked compact declare defer disabled ismap multiple nohref noresize noshade nowrap readonly selected".split())

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(s: str) -> str:
    return s.translate(_LOWER)


def element_name(s: str) -> str:
    return s if ":" in s or s in MIXED_ELEMENTS else ascii_lower(s)


def attribute_name(s: str) -> str:
    return s if ":" in s or s in MIXED_ATTRIBUTES else ascii_lower(s)
