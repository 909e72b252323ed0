"""The text blocks of an HTML page, with the path of elements each stands in."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav noscript ol "
    "optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
_ENDS_PARAGRAPH = _BLOCK - {"button", "label", "option", "optgroup", "select", "noscript"}
#: a start tag closes an open element of the first kind, unless one of the second stands in between
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"})}

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?>\"[^\"]*\"|'[^']*'|[^'\">])*+|[^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]  # one string per open element: its name, then words of class, id and role
    text: str
    link_chars: int


def element(name: str, more: str) -> str:
    """The element's name and the words by which its author names it."""
    if "=" not in more:
        return name
    words = [w.lower() for m in _ATTRIBUTE.finditer(more) for w in _TOKEN.findall(m[1] or m[2] or m[3] or "")]
    return " ".join([name, *words])


def blocks(page: str) -> list[Block]:
    """All text blocks in the order of the page, white space joined, character references decoded.

    A block ends where a block element begins or ends.  Elements that may be
    left open are closed as browsers do it.  Scripts, styles, titles, other raw
    text and comments are no text; without an end tag they reach to the end of
    the page.  Drawings, formulas, objects and templates are elements like others.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    at, links, link_chars = 0, 0, 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(e for _, e in stack), text, min(link_chars, len(text))))
            parts.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                link_chars += len(text.strip())

    def close(kinds: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    while True:
        found = _MARKUP.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at:found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name in _BLOCK:
                flush()
                # an end tag closes its element, but not the page around a stray one
                if any(e == name for e, _ in stack):
                    close({name}, set())
            continue
        if name == "br":
            parts.append(" ")
        elif name in _RAW:
            if not found["more"].endswith("/") or name in ("script", "style", "textarea", "title"):
                stop = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = len(page) if stop is None else stop.start()
        elif name == "a":
            links = 1
        elif name in _BLOCK or name == "hr":
            flush()
            links = 0
            if name in _ENDS_PARAGRAPH or name == "hr":
                close({"p"}, {"button", "td", "th", "table"})
            if name in _CLOSES:
                close(*_CLOSES[name])
            if name not in _VOID:
                stack.append((name, element(name, found["more"])))
    flush()
    return out
