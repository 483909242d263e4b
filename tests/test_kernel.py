import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hedgerow import cases
from hedgerow.kernel import codec, css, lex, policy, processors, render, tables, urls
from hedgerow.kernel.balance import balanced
from hedgerow.kernel.lex import Event


@pytest.mark.parametrize(("name", "html", "clean"), cases.SANITIZE)
def test_sanitize(name, html, clean):
    assert cases.NAMED[name].sanitize(html) == clean


@pytest.mark.parametrize(("s", "text", "attribute"), cases.DECODE)
def test_decode(s, text, attribute):
    assert codec.decode(s) == text
    assert codec.decode(s, True) == attribute


@pytest.mark.parametrize(("style", "clean"), cases.CSS)
def test_css(style, clean):
    assert css.sanitize_css(style) == clean


@pytest.mark.parametrize(("value", "clean"), cases.SRCSET)
def test_srcset(value, clean):
    assert urls.srcset(value, urls.url_filter(frozenset(["http", "https"]))) == clean


@pytest.mark.parametrize(("value", "number"), cases.FLOATS)
def test_float(value, number):
    end = urls.float_end(value, 0)
    assert (value[:end] if end >= 0 else "") == number


def test_surrogates_meet():
    assert codec.decode("&#xd87e;&#xdc1a;") == "\U0002f81a"
    assert codec.encode_pcdata("\U0002f81a") == "&#x2f81a;"
    assert codec.encode_pcdata("{{x") == "{<!-- -->{x"
    assert codec.encode_attribute("{{x") == "{​{x"


def test_comment_ends():
    kinds = lambda h: [t.kind for t in lex.tokens_of(h)]
    assert kinds("<!-- a - b ->c") == ["COMMENT", "TEXT"]  # after a dash, one dash and ">" are enough
    assert kinds("<!-->x") == ["COMMENT"]
    assert kinds("<!-- x --->y") == ["COMMENT", "TEXT"]


def test_policies_and():
    both = policy.FORMATTING.and_(policy.LINKS)
    other = policy.LINKS.and_(policy.FORMATTING)
    for html in ("<b>x</b>", "<a href='http://a/'><i>x</i></a>", "<p onclick=x>y"):
        assert both.sanitize(html) == other.sanitize(html)


def test_and_intersects_values():
    letters = policy.PolicyBuilder().allow_elements("p", "a").allow_protocols("mailto").allow_attributes("href", "lang").on_elements("a").build()
    inline = policy.FORMATTING.and_(policy.LINKS)
    html = "<p><i>1</i><a lang=de href=mailto:me>2</a><a href=https://h.example/>3</a></p>"
    assert letters.sanitize(html) == '<p>1<a lang="de" href="mailto:me">2</a>3</p>'
    for both in (letters.and_(inline), inline.and_(letters)):
        assert both.sanitize(html) == '<p><i>1</i><a lang="de" href="mailto:me" rel="nofollow">2</a>3</p>'


@pytest.mark.parametrize(("value", "kept"), [("7", "7"), ("0012", "0012"), ("3.9.1", "3"), ("+5", None), ("1e3", None), ("8.", "8")])
def test_integer_attributes(value, kept):
    expected = f' width="{kept}"' if kept else ""
    assert policy.IMAGES.sanitize(f"<img src=i.gif width={value}>") == f'<img src="i.gif"{expected} />'


@pytest.mark.parametrize("left", [policy.SKIP, policy.SKIP_BY_DEFAULT, policy.DO_NOT_SKIP, policy.DO_NOT_SKIP_BY_DEFAULT])
def test_skip_and(left):
    assert policy.skip_and(left, policy.SKIP) == policy.SKIP
    assert policy.skip_and(left, policy.DO_NOT_SKIP) == policy.DO_NOT_SKIP
    assert policy.skip_and(left, policy.SKIP_BY_DEFAULT) == left


def test_rel():
    p = policy.PolicyBuilder().allow_elements("a").allow_attributes("href", "target", "rel").on_elements("a").allow_standard_protocols()
    assert p.build().sanitize("<a target=T href=http://e.com/>x") == '<a target="T" href="http://e.com/" rel="noopener noreferrer">x</a>'
    p.require_nofollow()
    assert p.build().sanitize("<a rel='Foo' href=http://e.com/>x") == '<a rel="foo nofollow" href="http://e.com/">x</a>'
    with pytest.raises(ValueError):
        p.require_rels_on_links("a b")


def test_processors_and_custom_policies():
    def shout(events):
        for e in events:
            yield e._replace(text=e.text.upper()) if e.kind == "text" else e

    b = policy.PolicyBuilder().allow_elements("h1", policy=lambda name, attrs: "div").allow_elements("div").with_preprocessor(shout)
    assert b.build().sanitize("<h1>a</h1>") == "<div>A</div>"
    r = b.build().process("<h1>a</h1><script>x</script>")
    assert [(d.kind, d.element) for d in r.discards] == [("tag", "h1"), ("tag", "script")]


def test_nesting_limit():
    html = "<div>" * 400 + "x"
    assert policy.BLOCKS.sanitize(html).count("<div>") == 256


O, C, X = (lambda n, *a: Event("open", n, a)), (lambda n: Event("close", n)), (lambda s: Event("text", text=s))
BALANCE = [
    ([O("p"), X("a"), O("div"), X("b"), C("p"), X("c")], "<p>a</p><div>bc</div>"),
    ([O("td"), X("1"), O("td"), X("2"), O("tr"), O("td"), X("3")], "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
    ([O("dl"), O("dt"), X("t"), O("dd"), X("d"), O("dt"), X("u")], "<dl><dt>t</dt><dd>d</dd><dt>u</dt></dl>"),
    ([O("b"), O("i"), X("1"), C("b"), X("2"), C("i"), X("3")], "<b><i>1</i></b><i>2</i>3"),
    ([O("ul"), X("loose"), O("p"), X("para")], "<ul><li>loose<p>para</p></li></ul>"),
    ([O("select"), O("option"), X("a"), O("option"), X("b"), C("select"), X("c")], "<select><option>a</option><option>b</option></select>c"),
    ([C("div"), O("br"), C("br"), X("x")], "<br />x"),
    ([O("span", ("title", '"&"')), X("{{"), O("h2"), X("&")], '<span title="&#34;&amp;&#34;">{<!-- -->{<!-- --><h2>&amp;</h2></span>'),
]


@pytest.mark.parametrize(("events", "html"), BALANCE)
def test_balance(events, html):
    assert render.render(balanced(events))[0] == html


@pytest.mark.parametrize(("html", "clean"), [("x\0<i\0>y", "xy"), ("<p>&#0;&#x00;.</p>", "<p>.</p>"), ("\0<b>z", "<b>z</b>")])
def test_null_characters(html, clean):
    assert cases.NAMED["mixed"].sanitize(html) == clean


def test_implied():
    assert tables.implied("table", "td") == ["table", "tbody", "tr"]  # the balancer goes on behind the table
    assert tables.implied("body", "td") == ["table", "tbody", "tr"]
    assert tables.implied("ul", "p") == ["li"]
    assert tables.implied("body", "script") == []


def test_cdata_faults():
    assert render.cdata_fault("script", "<!-- x -->") == -1
    for bad in ("<!--<!---->", "</script", "-->", "<!-- <script -->", "<!--"):
        assert render.cdata_fault("script", bad) >= 0, bad


def test_schema_conflicts():
    with pytest.raises(ValueError):
        css.Schema.of(["no-such-property"])
    one = css.Schema({"color": css.Property(0, frozenset(["x"]), {})})
    with pytest.raises(ValueError):
        one.union(css.DEFAULT_SCHEMA)
    assert len(css.DEFINITIONS) == 160 and len(css.DEFAULT_SCHEMA.rules) >= 125


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "a", "b", "p", "/", "!", "-", "--", "script", "style", "'", '"', "=", " ", "onclick", "href", "javascript:", "&", "&lt;", "table", "td", "select", "%", "?", "\0", "{{"]), max_size=30))
def test_any_document_gives_allowed_tags_only(parts):
    html = "".join(parts)
    clean = cases.NAMED["blocks+formatting+links"].sanitize(html)
    names = {e.name for e in lex.events_of(clean) if e.kind == "open"}
    assert names <= set(cases.NAMED["blocks+formatting+links"].elements)
    assert "javascript:" not in "".join(v for e in lex.events_of(clean) for _, v in e.attrs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["color", ":", "red", ";", "(", ")", "{", "}", "url(", "'", '"', "</style", "<!--", "-->", "]]>", "#fff", "\\", "12px", "rgb(", ",", "\n"]), max_size=20))
def test_any_style_is_safe(parts):
    out = css.sanitize_css("".join(parts), rewrite=lambda u: u) or ""
    assert not any(x in out for x in ("</", "<!", "]]>", "\n", "\r"))
    assert css.sanitize_css(out, rewrite=lambda u: u) in (out or None, out)


def test_random_events_are_balanced():
    random.seed(7)
    for _ in range(300):
        events = [random.choice([Event("open", n), Event("close", n), Event("text", text="x")]) for n in random.choices(["a", "b", "p", "ul", "li", "table", "td", "select", "option", "h1", "div"], k=25)]
        stack = []
        for e in balanced(events):
            if e.kind == "open":
                stack.append(e.name)
            elif e.kind == "close":
                assert stack.pop() == e.name
        assert not stack


@pytest.mark.parametrize(
    ("style", "expected"),
    [("width: 007.250 EM", "width:7.25em"), ("padding: 3 mm 0", "padding:3mm 0"), ("height:+0.90%", "height:0.9%"), ("color:blue !  Important", "color:blue !important"), ("width:5. px", "width:5px")],
)
def test_quantities_have_a_normal_form(style, expected):
    assert css.sanitize_css(style) == expected


def test_a_comma_may_end_a_source_set():
    assert urls.srcset("one.png 2x, two.png ,", lambda u: u) == "one.png 2x , two.png"
    assert urls.srcset("three.png , ", lambda u: u) == "three.png"
    assert urls.srcset(",", lambda u: u) is None


def test_balancer_knows_names_in_capitals():
    out = list(balanced([Event("open", "H2"), Event("text", text="x"), Event("close", "H2")]))
    assert [(e.kind, e.name) for e in out] == [("open", "h2"), ("text", ""), ("close", "h2")]


def test_what_is_disallowed_stays_so():
    b = policy.PolicyBuilder().allow_elements("i", "q").disallow_elements("q").allow_attributes("lang", "dir").on_elements("i")
    b.disallow_attributes("dir").on_elements("i").allow_elements("q")
    assert b.build().sanitize("<q><i lang=en dir=ltr>x</i></q>") == '<i lang="en">x</i>'
    b.disallow_text_in("style").allow_elements("style")
    assert b.build().sanitize("<style>x</style>") == "<style></style>"
    b.allow_elements("span").disallow_without_attributes("i").allow_without_attributes("span")
    assert b.build().sanitize("<i>x</i><span>y</span>") == "x<span>y</span>"


@pytest.mark.parametrize(
    ("test", "value", "kept"),
    [("[a-c]+", "abc", True), ("[a-c]+", "abcd", False), ({"left", "right"}, "left", True), ({"left", "right"}, "Left", False), (str.isdigit, "12", True), (str.isdigit, "1b", False)],
)
def test_matching(test, value, kept):
    p = policy.PolicyBuilder().allow_elements("p").allow_attributes("title").matching(test).on_elements("p").build()
    assert p.sanitize(f"<p title={value}>") == (f'<p title="{value}"></p>' if kept else "<p></p>")


def test_matching_ignores_case():
    p = policy.PolicyBuilder().allow_elements("p").allow_attributes("dir").matching_ignore_case("LTR").on_elements("p").build()
    assert p.sanitize("<p dir=Ltr>") == '<p dir="ltr"></p>'


def test_styles_may_have_urls():
    b = policy.PolicyBuilder().allow_elements("p").allow_protocols("https").allow_styling()
    html = "<p style='background:url(https://h.example/i.png)'>x"
    assert b.build().sanitize(html) == "<p>x</p>"
    assert "h.example" in b.allow_urls_in_styles(lambda e, a, v: v).build().sanitize(html)
    assert b.build().sanitize("<p style='background:url(ftp://h.example/i.png)'>x") == "<p>x</p>"


def test_hosts_are_told():
    b = policy.PolicyBuilder().allow_elements("a", "img", "b").allow_attributes("href").on_elements("a").allow_attributes("src").on_elements("img").allow_standard_protocols()
    p = b.with_postprocessor(processors.hosts_told).build()
    assert p.sanitize("<a href=https://u@h.example:8/x><b>1</b></a>2") == '<a href="https://u&#64;h.example:8/x"><b>1</b></a> - h.example2'
    assert p.sanitize("<img src=//i.example/x.png><a href=/y>z</a>") == '<img src="//i.example/x.png" /> - i.example<a href="/y">z</a>'


def test_errors_limits_and_audits():
    p = policy.PolicyBuilder().allow_elements("div").build()
    odd = policy.PolicyBuilder().allow_elements("div").with_postprocessor(lambda events: [Event("open", "no name"), *events]).build()
    assert odd.process("<div>x").errors and odd.sanitize("<div>x") == "<div>x</div>"
    with pytest.raises(ValueError):
        odd.sanitize("<div>x", strict=True)
    assert p.sanitize("<div><div><div>x", limit=2) == "<div><div></div></div>"
    html = "<div class=a><b>x</b><div></div></div>"
    assert p.audit(html) == p.process(html).discards
