"""Elements of web pages: tags are read one after another with a stack, so nested elements, comments and unclosed tags are understood."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A comment, declaration or tag; attribute values may hold `>` in quotes.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(/?)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
#: Elements without content, those whose content is no markup, and what a starting element ends of those that are open.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
HIDDEN = frozenset(("script", "style"))
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Elements that shield what is open around them from being ended.
SHIELDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


def attributes(text: str) -> dict[str, str]:
    """A tag's attributes, names in lower case, entities read; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("start", name, attributes), ("end", name, "") and ("text", "", text) in order; an element without content ends at once, text has its entities read."""
    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            yield "text", "", html.unescape(page[at:])
            return
        if m.start() > at:
            yield "text", "", html.unescape(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            yield "end", name, ""
            continue
        yield "start", name, m[3]
        if name in VOID or m[4]:
            yield "end", name, ""
        elif name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            stop = close.start() if close else end
            if name not in HIDDEN and stop > at:
                yield "text", "", html.unescape(page[at:stop])
            yield "end", name, ""
            at = close.end() if close else end


def elements(page: str, element: str, css_class: str | None = None) -> list[str]:
    """Texts of a page's elements of a name and, if given, a class, in the order in which they begin; those within others are elements too, and part of the others' text.

    White space is collapsed, tags stand for a blank. What is never closed ends where its parent does, or where the like begins.
    """
    texts: list[str] = []
    open_now: list[tuple[str, int | None, int]] = []  # name, place in out if it is wanted, first of its texts
    out: list[str] = []

    def close(depth: int) -> None:
        while len(open_now) > depth:
            _, place, first = open_now.pop()
            if place is not None:
                out[place] = " ".join(" ".join(texts[first:]).split())

    for what, name, more in events(page):
        if what == "text":
            texts.append(more)
        elif what == "start":
            for depth in range(len(open_now) - 1, -1, -1):
                if open_now[depth][0] in SHIELDS.get(name, ()):
                    break
                if open_now[depth][0] in ENDS.get(name, ()):
                    close(depth)
                    if name != "tr":
                        break
            wanted = name == element and (css_class is None or css_class in attributes(more).get("class", "").split())
            if wanted:
                out.append("")
            open_now.append((name, len(out) - 1 if wanted else None, len(texts)))
        else:
            depth = next((k for k in range(len(open_now) - 1, -1, -1) if open_now[k][0] == name), None)
            if depth is not None:
                close(depth)
    close(0)
    return out


def page_items(pages: Column, element: str = "li", css_class: str | None = None) -> Column:
    """Texts of a page's elements, white space collapsed, without empty ones; only those of a class, if given. A null page gives null."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [x for x in elements(t, element.lower(), css_class) if x] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(pages)
