"""The balanced scan against the standard library's parser and by hand."""

import random
import re
from html.parser import HTMLParser

import pytest

from textmill.operators.markup import content_area, elements, without

WORDS = re.compile("content|main|texto")
DROP = frozenset(("script", "style", "nav", "footer", "header"))


class Text(HTMLParser):
    """The text outside dropped elements, by events."""

    VOID = set("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if not DROP & set(self.stack):
            self.out.append(data)

    handle_entityref = handle_charref = handle_comment = handle_decl = lambda self, x: None


def text_by_events(html):
    p = Text()
    p.feed(html)
    p.close()
    return "".join(p.out)


def page(rng):
    pieces = ["<div>", "</div>", "<nav>", "</nav>", "<header class='a>b'>", "</header>", "<p>", "</p>", "<br>", "<hr/>", "<footer/>", "<!-- <nav> -->", "x", " y ", "<script>if (a<b) '</div>'</script>", "<STYLE>p > q</Style>", "<article>", "</article>", "<Nav >", "</main>", "<main>", '<div title="</nav>">']
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))


def test_without_as_the_standard_parser():
    rng = random.Random(6)
    for _ in range(3_000):
        html = page(rng)
        assert text_by_events(without(html, DROP)) == text_by_events(html), html


def test_elements_nest_and_end_with_their_parent():
    html = "<div a><nav>1<nav>2</nav>3</nav><section><nav>open</section>out</div></p>"
    found = [(e.tag, html[e.start : e.end], html[e.inner : e.inner_end]) for e in elements(html, lambda t: t in ("nav", "div"))]
    assert found == [("div", html[:-4], html[7:-10]), ("nav", "<nav>1<nav>2</nav>3</nav>", "1<nav>2</nav>3"), ("nav", "<nav>2</nav>", "2"), ("nav", "<nav>open", "open")]
    assert without(html, DROP) == "<div a><section></section>out</div></p>"


@pytest.mark.parametrize(
    ("html", "whole", "want"),
    [
        ("<body><div class='x content'><div>a<div>b</div></div>c</div>d</body>", False, "<div>a<div>b</div></div>c"),
        ("<body><article>1<article>2</article>3</article></body>", False, "1<article>2</article>3"),
        ("<body><article>1</article><main><main>m</main>n</main></body>", False, "<main>m</main>n"),
        ("<body><main></main><article>no</article></body>", False, ""),
        ("<body><main>m</main>b</body>", True, "<main>m</main>b"),
        ("<body>b<div class=other>c</div>", False, "b<div class=other>c</div>"),
        ("<div class=texto>open", False, "open"),
        ("no tags", False, ""),
        ("", False, ""),
        ("<div data-class='main'>x</div><body>b</body>", False, "b"),
    ],
)
def test_content_area(html, whole, want):
    assert content_area(html, whole, WORDS) == want


def test_scan_is_linear():
    for html in ("<div>" * 200_000, "</div>" * 200_000, "<nav>" * 100_000 + "</nav>" * 100_000, "<p a='>" * 50_000, "<" * 300_000):
        elements(html, lambda t: True)


def test_columns(spark):
    from textmill.operators import html as h

    rows = [(1, "http://x/boja/1", "<body><nav><nav>a</nav>b</nav><main>c</main></body>"), (2, None, "<main>c<nav>d</nav></main>"), (3, "u", None), (4, "u", "")]
    got = spark.createDataFrame(rows, "i int, url string, html string").select("i", h.main_content(h.strip_boilerplate("html"), "url").alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == ["<main>c</main>", "c", None, ""]
