"""Elements of HTML pages by one balanced scan: whole subtrees, however deep they nest."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column

from textmill.functions.batches import udf

#: A comment, or a tag: slash, name, attributes. A > inside quotes doesn't end a tag.
TOKEN = re.compile(r"""<!--.*?-->|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
#: Elements without content, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style")}
CLASS = re.compile(r"""(?is)(?:^|\s)class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class Element:
    """An element's place: from its start tag, its content, up to its end."""

    __slots__ = ("tag", "attributes", "start", "inner", "inner_end", "end")

    def __init__(self, tag: str, attributes: str, start: int, inner: int):
        self.tag, self.attributes, self.start, self.inner = tag, attributes, start, inner
        self.inner_end = self.end = inner


def elements(html: str, wanted: Callable[[str], bool]) -> list[Element]:
    """The elements whose tag is wanted, in the order of their start tags.

    An end tag closes the last open element of its name and all that are open inside; without such an
    element it says nothing. What the page leaves open ends with its parent. Linear in the page.
    """
    found: list[Element] = []
    stack: list[tuple[str, Element | None]] = []
    count: Counter[str] = Counter()
    at = 0

    def close(name: str, inner_end: int, end: int) -> None:
        while stack:
            tag, element = stack.pop()
            count[tag] -= 1
            if element is not None:
                element.inner_end, element.end = inner_end, end if tag == name else inner_end
            if tag == name:
                return

    while (m := TOKEN.search(html, at)) is not None:
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if count[name]:
                close(name, m.start(), m.end())
            continue
        element = Element(name, m[3], m.start(), m.end()) if wanted(name) else None
        if element is not None:
            found.append(element)
        if name in VOID or m[3].endswith("/"):
            continue
        if name in RAW:
            ends = RAW[name].search(html, at)
            inner_end, at = (ends.start(), ends.end()) if ends else (len(html), len(html))
            if element is not None:
                element.inner_end, element.end = inner_end, at
            continue
        stack.append((name, element))
        count[name] += 1
    for _, element in stack:
        if element is not None:
            element.inner_end = element.end = len(html)
    return found


def without(html: str, tags: frozenset[str]) -> str:
    """The page without the subtrees of these tags."""
    out, at = [], 0
    for e in elements(html, tags.__contains__):
        if e.start >= at:  # not inside one that went already
            out.append(html[at : e.start])
            at = e.end
    out.append(html[at:])
    return "".join(out)


def content_area(html: str, whole: bool, words: re.Pattern) -> str:
    """The content of the first main, else the first article, else the first div with a class that has one of the
    words, else the body; of the body only if whole. A page without any gives an empty text."""
    first: dict[str, Element] = {}
    for e in elements(html, lambda t: t in ("main", "article", "div", "body")):
        if e.tag != "div":
            first.setdefault(e.tag, e)
        elif "div" not in first and (m := CLASS.search(e.attributes)) and words.search(m[1] or m[2] or m[3] or ""):
            first["div"] = e
    for tag in ("body",) if whole else ("main", "article", "div", "body"):
        if tag in first:
            return html[first[tag].inner : first[tag].inner_end]
    return ""


def without_tags(html: Column, tags: tuple[str, ...]) -> Column:
    """without() for a column; row-local, in pieces of Arrow batches. A null page stays null."""
    drop = frozenset(tags)
    return udf(lambda pages: pa.array([None if p is None else without(p, drop) for p in pages], pa.string()))(html)


def area_of(html: Column, whole: Column, words: str) -> Column:
    """content_area() for a column; words is a pattern."""
    pattern = re.compile(words)
    return udf(lambda pages, all_of_it: pa.array([None if p is None else content_area(p, bool(w), pattern) for p, w in zip(pages, all_of_it)], pa.string()))(html, whole)
