"""Splitting raw pages into leaf blocks: text between block-level boundaries, with the path of elements above it."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

# Fixed names of the HTML standard: elements that break blocks, have no end tag, or hold no page text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it runs to the end tag or the end of the page.
RAW = frozenset("script style textarea title".split())
#: Other elements without page text, dropped where they have an end tag.
UNWANTED = frozenset("noscript template svg iframe object canvas audio video select button".split())
#: Elements that end when one of the same kind begins beside them.
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements nest so deep at most; deeper ones are laid flat, as browsers do.
DEEPEST = 512
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NEXT = re.compile(r">|=\s*([\"'])")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")


class Leaf:
    """A block: its text, the path above it (names of elements, classes, ids and roles), and how many of its characters are in links."""

    __slots__ = ("text", "path", "linked", "depth", "tag")

    def __init__(self, text: str, path: str, linked: int, depth: int, tag: str):
        self.text, self.path, self.linked, self.depth, self.tag = text, path, linked, depth, tag


class _Reader:
    """Reads a page from left to right in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.wasted = 0  # characters read for tags that turned out to have no end

    def tag_end(self, at: int) -> int:
        """Where the tag's ">" is, one outside quoted values if there is one; `at` is before the last ">"."""
        begin, page = at, self.page
        while self.wasted <= len(page):
            m = _NEXT.search(page, at)
            if m is None:
                break
            if not m[1]:
                return m.start()
            end = page.find(m[1], m.end())
            if end < 0:  # the quote isn't closed
                self.wasted += len(page) - m.end()
                at = m.end()
            else:
                at = end + 1
        self.wasted += len(page) - begin
        return page.find(">", begin)

    def tokens(self) -> Iterator[tuple[int, str, str, bool, str]]:
        """(place, kind, name, whether it is an end tag, text or attributes); kinds are text, raw and tag. Inside svg a self-closed raw element is empty."""
        page, at, inside, ends = self.page, 0, 0, {}
        while at < len(page):
            lt = page.find("<", at)
            if lt != at:
                yield at, "text", "", False, page[at : lt if lt >= 0 else len(page)]
                if lt < 0:
                    return
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            closing = page.startswith("/", lt + 1)
            m = _NAME.match(page, lt + 1 + closing) if lt < self.last else None
            if m is None:
                if lt < self.last and page[lt + 1 : lt + 2] in ("!", "?", "/"):
                    at = page.find(">", lt) + 1
                else:
                    yield lt, "text", "", False, "<"
                    at = lt + 1
                continue
            name, end = m[0].lower(), page.find(">", m.end()) if closing else self.tag_end(m.end())
            attributes = page[m.end() : end]
            at = end + 1
            if name in RAW and not closing:
                if not (inside and attributes.endswith("/")):
                    if name not in ends:
                        ends[name] = re.compile(rf"</{name}(?=[\s/>])", re.I)
                    close = ends[name].search(page, at)
                    end = page.find(">", close.end()) if close else -1
                    at = end + 1 if end >= 0 else len(page)
                yield lt, "raw", name, False, attributes
                continue
            if name == "svg":
                inside = max(inside - 1, 0) if closing else inside + (not attributes.endswith("/"))
            yield lt, "tag", name, closing, attributes


def _closed(page: str) -> set[int]:
    """Where unwanted elements begin that have their own end tag."""
    begun: dict[str, list[int]] = {}
    found = set()
    for at, kind, name, closing, attributes in _Reader(page).tokens():
        if kind != "tag" or name not in UNWANTED or name == "svg" and not closing and attributes.endswith("/"):
            continue
        if not closing:
            begun.setdefault(name, []).append(at)
        elif begun.get(name):
            found.add(begun[name].pop())
    return found


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page in order, whatever its faults; blocks without text are left out."""
    out: list[Leaf] = []
    stack: list[tuple[str, str]] = [("", "")]  # element, path down to it
    pieces: list[str] = []
    linked, in_link = 0, 0
    skip, closed = 0, None  # where on the stack an unwanted element is
    standing: Counter[str] = Counter()  # elements on the stack by name

    def push(name: str, path: str) -> bool:
        if len(stack) < DEEPEST:
            stack.append((name, path))
            standing[name] += 1
        return stack[-1][0] == name

    def pop(k: int) -> None:
        """Elements from the k-th on end."""
        for name, _ in stack[k:]:
            standing[name] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Leaf(text, stack[-1][1], linked, len(stack), stack[-1][0]))
            pieces.clear()
        linked = 0

    for at, kind, name, closing, attributes in _Reader(page).tokens():
        if kind == "text":
            if not skip:
                piece = html.unescape(attributes) if "&" in attributes else attributes
                pieces.append(piece)
                if in_link:
                    linked += len(piece)
        elif kind == "raw":
            if name == "textarea" and not skip:
                pieces.append(" ")
        elif name in UNWANTED:
            if closing:
                if standing[name]:
                    for k in range(len(stack) - 1, skip - 1 if skip else len(stack), -1):
                        if stack[k][0] == name:
                            pop(k)
                            if k == skip:
                                skip = 0
                                if name in ("select", "iframe", "object"):
                                    pieces.append(" ")
                            break
                continue
            if closed is None:
                closed = _closed(page)
            if at in closed:
                if len(stack) >= DEEPEST:  # room for its end to be found
                    pop(DEEPEST - 1)
                    skip = skip if skip < len(stack) else 0
                skip = skip or len(stack)
                push(name, stack[-1][1])
        elif skip:
            if name not in BLOCK or name in VOID:
                continue
            if not closing:
                push(name, stack[-1][1])
                continue
            if standing[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if k < skip:  # a block around it ends
                            pop(skip)
                            skip, in_link = 0, 0
                            flush()
                        pop(k)
                        break
        elif name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = 0 if closing else 1
        elif name in BLOCK:
            flush()
            in_link = 0 if name != "li" else in_link
            if closing:
                if standing[name]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            pop(k)
                            break
                continue
            if name in VOID:
                continue
            if stack[-1][0] == "p":
                pop(len(stack) - 1)
            if name in _CLOSED_BY and any(standing[x] for x in _CLOSED_BY[name]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in _STOP[name]:
                        break
                    if stack[k][0] in _CLOSED_BY[name]:
                        pop(k)
                        break
            path = f"{stack[-1][1]} {name}"
            if attributes:
                for x in _NAMES.finditer(attributes):
                    path += "".join(f" .{w}" for w in _WORD.findall((x[1] or x[2] or x[3] or "").lower()))
            if len(path) > 4_000:  # of a very deep or many-named path, the names near the leaf
                path = " " + path[-3_000:].split(" ", 1)[1]
            push(name, path)
    if skip:
        del stack[skip:]
    flush()
    return out
