"""A page's tree from any string. The scanner never fails and never reads a byte more than a few times, whatever the markup.

Odd places are read as follows: a bracketed or other declaration that is none known ends at the next >, a < that begins nothing is
text, a tag, comment or declaration that never ends makes its < text and reading goes on behind it (a tag that swallows the rest of
the page through an odd quote makes all of the rest text). Elements are closed by their own end tag or that of an element around them,
never by another start tag; end tags of elements that aren't open are left out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Container, Iterator
from html import unescape

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements whose content is not markup.
RAW = ("script", "style")
#: Elements whose strings are no text of the page.
SILENT = frozenset(("script", "style", "template"))
#: Attributes that are lists of words, by element; * stands for all.
WORD_LISTS = {
    "*": ("class", "accesskey", "dropzone"), "a": ("rel", "rev"), "link": ("rel", "rev"), "td": ("headers",), "th": ("headers",),
    "form": ("accept-charset",), "object": ("archive",), "area": ("rel",), "icon": ("sizes",), "iframe": ("sandbox",), "output": ("for",),
}

_START = re.compile(r"<([A-Za-z][^ \t\n\r\f/>\x00]*)")
_ATTRIBUTE = re.compile(
    r"[ \t\n\r\f/]*([^ \t\n\r\f/>][^ \t\n\r\f/>=]*)"
    r"(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"([^\"]*)\"|'([^']*)'|((?![\"'])[^ \t\n\r\f>]*)))?"
)
_CLOSE = re.compile(r"[ \t\n\r\f]*(?:/[ \t\n\r\f]*)*")
_END = re.compile(r"</\s*([A-Za-z][^ \t\n\r\f/>\x00]*)[^>]*>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_BRACKETS = re.compile(r"<!\[\s*([A-Za-z]+)")
_BRACKET_END = {"cdata": "]]>", "temp": "]]>", "ignore": "]]>", "include": "]]>", "rcdata": "]]>", "if": "]>", "else": "]>", "endif": "]>"}
_BRACKET_ENDS = {"]]>": re.compile(r"\]\s*\]\s*>"), "]>": re.compile(r"\]\s*>")}


#: What a page without odd places is made of, besides text: comments, scripts and styles with their content, tags and declarations.
_TOKENS = re.compile(r"(<(?:!--.*?-->|script(?:[ \t\n\r\f][^<>]*)?>.*?</script>|style(?:[ \t\n\r\f][^<>]*)?>.*?</style>|[^<>]*>))", re.S | re.I | re.A)
#: A start tag that reads alike wherever it stands: its quotes are closed within it.
_PLAIN_TAG = re.compile(
    r"<[A-Za-z][A-Za-z0-9:_-]*(?:[ \t\n\r\f]+[A-Za-z_][A-Za-z0-9_:.-]*(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:\"[^\"<>]*\"|'[^'<>]*'|[^ \t\n\r\f\"'<>=]+))?)*"
    r"[ \t\n\r\f]*/?>"
)
_OPEN, _CLOSED, _EMPTY, _RAW, _ASIDE, _ODD = range(6)
#: Tokens that are remembered, and the characters of the longest.
TOKENS, TOKEN = 20_000, 200


class Aside(str):
    """What stands in the page but is no text of it: a comment or declaration, as written."""

    __slots__ = ()


class Page:
    """The elements of a page in document order, as columns; element 0 is the page itself. The elements below k are those from k + 1
    up to ends[k], its strings those from first[k] up to last[k]. What is no text of the page (Asides, the content of scripts and
    styles) is an empty string there, and as written in hidden."""

    __slots__ = ("names", "attrs", "parents", "ends", "first", "last", "strings", "hidden", "templates")

    def __init__(self) -> None:
        self.names: list[str | None] = [""]
        self.attrs: list[dict[str, str]] = [{}]
        self.parents, self.ends, self.first, self.last = [-1], [0], [0], [0]
        self.strings: list[str] = []
        self.hidden: dict[int, str] = {}
        self.templates: list[int] = []

    def find(self, k: int, names: Container[str]) -> list[int]:
        """The elements of these names below k."""
        return [j for j, name in enumerate(self.names[k + 1 : self.ends[k]], k + 1) if name in names]

    def parts(self, k: int) -> list[str]:
        """The strings of k, without those of silent elements below it."""
        begin, end = self.first[k], self.last[k]
        if self.names[k] in RAW:
            return [self.hidden.get(i, "") for i in range(begin, end)]
        own = self.strings[begin:end]
        if self.templates:
            i = bisect_right(self.templates, k)
            while i < len(self.templates) and self.templates[i] < self.ends[k]:
                t = self.templates[i]
                own[self.first[t] - begin : self.last[t] - begin] = [""] * (self.last[t] - self.first[t])
                i = bisect_right(self.templates, self.ends[t] - 1)
        return own

    def text(self, k: int, between: str = "") -> str:
        """Stripped strings of k, empty ones left out."""
        own = self.parts(k)
        return own[0].strip() if len(own) == 1 else between.join(filter(None, map(str.strip, own)))

    def without(self, names: Container[str]) -> Page:
        """The page without these elements: their names and strings are blank."""
        some = self.find(0, names)
        if not some:
            return self
        page = Page()
        for column in ("attrs", "parents", "ends", "first", "last", "hidden", "templates"):
            setattr(page, column, getattr(self, column))
        page.names, page.strings, end = self.names.copy(), self.strings.copy(), 0
        for k in some:
            if k >= end:
                end = self.ends[k]
                page.names[k:end] = [None] * (end - k)
                page.strings[self.first[k] : self.last[k]] = [""] * (self.last[k] - self.first[k])
        return page


class Node:
    """An element of a page."""

    __slots__ = ("page", "at")

    def __init__(self, page: Page, at: int):
        self.page, self.at = page, at

    @property
    def name(self) -> str | None:
        return self.page.names[self.at]

    @property
    def attrs(self) -> dict[str, str]:
        return self.page.attrs[self.at]

    @property
    def parent(self) -> Node | None:
        return Node(self.page, self.page.parents[self.at]) if self.at else None

    @property
    def items(self) -> list[Node | str]:
        """Elements and strings right below, in document order."""
        page, out = self.page, []
        at, begin, end = self.at + 1, page.first[self.at], page.ends[self.at]

        def shown(i: int, j: int) -> list[str]:
            return [page.hidden.get(x, page.strings[x]) for x in range(i, j)]

        while at < end:
            out += shown(begin, page.first[at])
            out.append(Node(page, at))
            begin, at = page.last[at], page.ends[at]
        return out + shown(begin, page.last[self.at])

    def find_all(self, *names: str) -> list[Node]:
        return [Node(self.page, j) for j in self.page.find(self.at, names)]

    def strings(self) -> Iterator[str]:
        return filter(None, self.page.parts(self.at))

    def text(self, between: str = "") -> str:
        """Stripped strings, empty ones left out."""
        return self.page.text(self.at, between)

    def html(self) -> str:
        """The element as well-formed markup: attributes quoted, all elements closed, &, < and > escaped in texts and values."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            item = stack.pop()
            if not isinstance(item, Node):
                out.append(item)
                continue
            name = item.name
            attrs = "".join(f" {k}={_quoted(v)}" for k, v in item.attrs.items()) if item.attrs else ""
            if name in VOID:
                out.append(f"<{name}{attrs}/>")
                continue
            out.append(f"<{name}{attrs}>")
            stack.append(f"</{name}>")
            plain = name in RAW
            stack += [x if plain or isinstance(x, (Node, Aside)) else escaped(x) for x in reversed(item.items)]
        return "".join(out)


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _quoted(value: str) -> str:
    value = escaped(value)
    if '"' not in value:
        return f'"{value}"'
    return f"'{value}'" if "'" not in value else '"' + value.replace('"', "&quot;") + '"'


def _attributes(html: str, at: int, name: str) -> tuple[dict[str, str], int]:
    """The attributes from `at` on, and where they end; of equal names the last value counts, in the place of the first."""
    values: dict[str, str] = {}
    listed = WORD_LISTS["*"] + WORD_LISTS.get(name, ())
    while found := _ATTRIBUTE.match(html, at):
        key = found[1].lower()
        value = next((v for v in found.groups()[1:] if v is not None), "")
        value = unescape(value) if "&" in value else value
        values[key] = " ".join(value.split()) if key in listed else value
        at = found.end()
    return values, at


class Tokens(dict):
    """token -> its kind, name and attributes (of scripts and styles also the content); forgets everything beyond TOKENS of them."""

    def __missing__(self, token: str) -> tuple:
        out = self.read(token)
        if len(token) <= TOKEN:
            if len(self) >= TOKENS:
                self.clear()
            self[token] = out
        return out

    @staticmethod
    def read(token: str) -> tuple:
        if token.startswith("</"):
            found = _END.fullmatch(token)
            return (_CLOSED, found[1].lower(), None) if found else (_ODD, "", None)
        if token.startswith("<!--"):
            return (_ASIDE, "", Aside(token)) if len(token) > 6 and token.endswith("-->") else (_ODD, "", None)
        if token.startswith(("<!", "<?")):
            return (_ODD, "", None) if token.startswith("<![") else (_ASIDE, "", Aside(token))
        plain = _PLAIN_TAG.match(token)
        if not plain:
            return _ODD, "", None
        start = _START.match(token)
        name = start[1].lower()
        values, end = _attributes(token, start.end(), name)
        closed = token[plain.end() - 2] == "/" and _CLOSE.match(token, end).end() > end
        if name in VOID or closed:
            return (_EMPTY, name, values) if plain.end() == len(token) else (_ODD, "", None)
        if name not in RAW:
            return (_OPEN, name, values) if plain.end() == len(token) else (_ODD, "", None)
        stop = _RAW_END[name].search(token, plain.end())
        whole = stop and stop.start() == len(token) - len(name) - 3
        return (_RAW, name, values, token[plain.end() : stop.start()]) if whole else (_ODD, "", None)


_tokens = Tokens()


def tree(html: str) -> tuple[Node, int]:
    """The root of the page and the number of odd places met on the way."""
    page, odd = _in_tokens(html) or _scanned(html)
    return Node(page, 0), odd


def _in_tokens(html: str) -> tuple[Page, int] | None:
    """The page and its odd places if it is tokens and text between them, None if it has to be scanned."""
    low = html.lower()
    if any(low.rfind(start) > low.rfind(end) for start, end in (("<!--", "-->"), ("<script", "</script>"), ("<style", "</style>"))):
        return None
    pieces = _TOKENS.split(html)
    between = pieces[::2]
    if "<" in "".join(between):
        return None
    page = Page()
    names, attrs, parents, ends, first, last, strings = page.names, page.attrs, page.parents, page.ends, page.first, page.last, page.strings
    opened: dict[str, int] = {}
    at = odd = 0
    for text, token in zip(between, pieces[1::2], strict=False):
        if text:
            strings.append(unescape(text) if "&" in text else text)
        found = _tokens[token]
        kind, name = found[0], found[1]
        if kind == _OPEN:
            parents.append(at)
            at = len(names)
            names.append(name)
            attrs.append(found[2])
            first.append(len(strings))
            ends.append(0)
            last.append(0)
            opened[name] = opened.get(name, 0) + 1
        elif kind == _CLOSED:
            if names[at] != name:
                if not opened.get(name):
                    odd += name not in VOID
                    continue
                while names[at] != name:
                    opened[names[at]] -= 1
                    ends[at], last[at] = len(names), len(strings)
                    at = parents[at]
                    odd += 1
            opened[name] -= 1
            ends[at], last[at] = len(names), len(strings)
            at = parents[at]
        elif kind == _ASIDE:
            page.hidden[len(strings)] = found[2]
            strings.append("")
        elif kind == _ODD:
            return None
        else:
            names.append(name)
            attrs.append(found[2])
            parents.append(at)
            first.append(len(strings))
            if kind == _RAW and found[3]:
                page.hidden[len(strings)] = found[3]
                strings.append("")
            elif kind == _EMPTY:
                odd += name not in VOID
            ends.append(len(names))
            last.append(len(strings))
    if between[-1]:
        strings.append(unescape(between[-1]) if "&" in between[-1] else between[-1])
    return page, odd + _ended(page, at)


def _ended(page: Page, at: int) -> int:
    """Closes all elements that are still open from `at` on; their number."""
    odd = 0
    while True:
        page.ends[at], page.last[at] = len(page.names), len(page.strings)
        if not at:
            break
        odd += 1
        at = page.parents[at]
    page.templates = page.find(0, ("template",))
    return odd


def _scanned(html: str) -> tuple[Page, int]:
    """The page and its odd places, of any string."""
    page = Page()
    names, strings = page.names, page.strings
    at = 0
    opened: Counter = Counter()
    odd, here, size = 0, 0, len(html)
    last_end, endless = html.rfind(">"), set()
    joins = False  # whether text goes on with the string before it

    def data(text: str, plain: bool = False) -> None:
        nonlocal joins
        if text:
            text = text if plain or "&" not in text else unescape(text)
            if joins:
                strings[-1] += text
            else:
                strings.append(text)
            joins = True

    def hide(text: str) -> None:
        if text:
            page.hidden[len(strings)] = text
            strings.append("")

    def search(ends: re.Pattern | str, start: int) -> tuple[int, int]:
        """Where the first end begins and ends; (-1, -1) without one, which is then known for all later places too."""
        if ends in endless:
            return -1, -1
        if isinstance(ends, str):
            found = html.find(ends, start)
            span = (found, found + len(ends))
        else:
            match = ends.search(html, start)
            found, span = (-1, (-1, -1)) if match is None else (match.start(), match.span())
        if found < 0:
            endless.add(ends)
            return -1, -1
        return span

    while here < size:
        mark = html.find("<", here)
        if mark < 0 or mark > last_end:
            odd += mark >= 0
            data(html[here:])
            break
        data(html[here:mark])
        start = _START.match(html, mark)
        if start:
            name = start[1].lower()
            values, end = _attributes(html, start.end(), name)
            closing = _CLOSE.match(html, end).end()
            if closing >= size or html[closing] != ">":
                odd += 1
                data(html[mark:])
                break
            node = len(names)
            names.append(name)
            page.attrs.append(values)
            page.parents.append(at)
            page.first.append(len(strings))
            page.ends.append(len(names))
            page.last.append(len(strings))
            joins, here = False, closing + 1
            if name in VOID or html[closing - 1] == "/" and closing > end:
                odd += name not in VOID
                continue
            if name in RAW:
                stop, _ = search(_RAW_END[name], here)
                hide(html[here:] if stop < 0 else html[here:stop])
                page.last[node] = len(strings)
                odd += stop < 0
                here = size if stop < 0 else html.find(">", stop) + 1 or size
                continue
            at = node
            opened[name] += 1
            continue
        if html.startswith("</", mark):
            found = _END.match(html, mark)
            if found:
                name, here = found[1].lower(), found.end()
                joins = False
                if not opened[name]:
                    odd += name not in VOID
                    continue
                while names[at] != name:
                    opened[names[at]] -= 1
                    page.ends[at], page.last[at] = len(names), len(strings)
                    at = page.parents[at]
                    odd += 1
                opened[name] -= 1
                page.ends[at], page.last[at] = len(names), len(strings)
                at = page.parents[at]
                continue
            odd += 1
            here = html.find(">", mark) + 1
            joins = joins and here == mark + 3
            continue
        if html.startswith("<!--", mark):
            stop, end = search("-->", mark + 4)
        elif html.startswith("<![", mark):
            found = _BRACKETS.match(html, mark)
            ends = _BRACKET_END.get(found[1].lower()) if found else None
            odd += ends is None
            stop, end = search(_BRACKET_ENDS[ends], found.end()) if ends else search(">", mark)
            if ends and stop >= 0 and html[mark + 3 : mark + 9].upper() == "CDATA[":
                joins = False
                data(html[mark + 9 : stop], True)
                joins, here = False, end
                continue
        elif html.startswith(("<!", "<?"), mark):
            stop, end = search(">", mark)
        else:
            odd += not html[mark + 1 : mark + 2].isspace()
            data("<", True)
            here = mark + 1
            continue
        if stop < 0:
            odd += 1
            data("<", True)
            here = mark + 1
            continue
        hide(Aside(html[mark:end]))
        joins, here = False, end
    return page, odd + _ended(page, at)
