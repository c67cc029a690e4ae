"""A tolerant HTML reader: leaf blocks with their tag paths.

Follows what browsers do where it matters here: raw script and style content,
an open paragraph ends at the next block, unknown end tags are ignored, a tag
or comment cut off at the end of the input is dropped.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SILENT = frozenset("head title script style noscript template iframe select option textarea button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table html body article section div td th blockquote".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r ]+")


class Path:
    """Tag and class, id and role words of every open element, outermost first.
    Blocks share the words of the elements they share."""

    def __init__(self, last: tuple | None):
        self.last = last

    def elements(self) -> Iterator[tuple]:
        """(words, elements above) from the innermost element outwards."""
        at = self.last
        while at is not None:
            yield at
            at = at[1]

    def __iter__(self) -> Iterator[str]:
        for words, _ in reversed(list(self.elements())):
            yield from words

    def __eq__(self, other: object) -> bool:
        return tuple(self) == tuple(other)

    def __len__(self) -> int:
        return sum(len(words) for words, _ in self.elements())


@dataclass
class Block:
    path: Path
    text: str
    link_chars: int


#: What ends a tag or opens a quote in it, from inside a tag.
_TAG_PART = re.compile(r""">|=\s*(["'])""")


def _tag_end(source: str, i: int) -> int:
    """Index after the '>' that ends the tag whose attributes start at i; one
    inside a quoted value does not. A quote that is never closed is no quote.
    -1 if the tag is cut off. Every character is passed once, for a quote is
    looked for from where it opens on; that one is open to the end of the page
    is remembered by the caller's ``_Quotes``."""
    return _Quotes(source).tag_end(i)


class _Quotes:
    """Tag ends of one page. Remembers from where on a quote mark is missing,
    so that stray quotes do not search the rest of the page again and again."""

    def __init__(self, source: str):
        self.source = source
        self.missing = {'"': len(source) + 1, "'": len(source) + 1}

    def tag_end(self, i: int) -> int:
        at = i
        while m := _TAG_PART.search(self.source, at):
            at = m.end()
            if not m[1]:
                return at
            if at >= self.missing[m[1]]:
                continue
            close = self.source.find(m[1], at)
            if close < 0:
                self.missing[m[1]] = min(self.missing[m[1]], at)
                continue
            at = close + 1
        return -1


def read_blocks(source: str) -> list[Block]:
    """The non-empty leaf blocks in page order."""
    # open elements: name, own words, and the words of all of them as a linked
    # list (words, list above, depth), which blocks share
    stack: list[tuple[str, tuple | None]] = []
    open_names: Counter[str] = Counter()
    quotes = _Quotes(source)
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = silent = in_link = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip(" ")
            pieces.clear()
            if text:
                blocks.append(Block(Path(stack[-1][1] if stack else None), text, min(linked, len(text))))
        linked = 0

    def pop(n: int) -> None:
        nonlocal silent, in_link
        if any(name not in INLINE and name not in RAW for name, _ in stack[n:]):
            flush()
        for name, _ in stack[n:]:
            open_names[name] -= 1
            silent -= name in SILENT
            in_link -= name == "a"
        del stack[n:]

    def close(names: set[str], scope: frozenset[str]) -> None:
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in names:
                pop(n)
                return
            if stack[n][0] in scope:
                return

    def text(data: str) -> None:
        nonlocal linked
        if not silent:
            pieces.append(data)
            if in_link:
                linked += len(data)

    i, n = 0, len(source)
    while i < n:
        at = source.find("<", i)
        if at < 0:
            text(source[i:])
            break
        if at > i:
            text(source[i:at])
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            i = n if end < 0 else end + 3
            continue
        if source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at)
            i = n if end < 0 else end + 1
            continue
        m = _NAME.match(source, at)
        if not m:
            text("<")
            i = at + 1
            continue
        end = quotes.tag_end(m.end())
        if end < 0:
            break
        name = m[1].lower()
        if source[at + 1] == "/":
            if open_names[name]:
                close({name}, frozenset())
            i = end
            continue
        if name in _CLOSES_P and open_names["p"]:
            close({"p"}, frozenset({"td", "th", "button", "object"}))
        if name in _CLOSES_SAME and any(open_names[x] for x in _CLOSES_SAME[name]):
            close(_CLOSES_SAME[name], _SCOPE - {"td", "th"})
        if name not in INLINE and name not in RAW:
            flush()
        if name not in VOID and not source.startswith("/>", end - 2) or name in RAW:
            attrs = source[m.end() : end]
            words = [name]
            if "=" in attrs:
                for a in _ATTR.finditer(attrs):
                    words += [f"{a[1].lower()[0]}.{w}" for w in _WORDS.findall((a[2] or a[3] or a[4] or "").lower())]
            above = stack[-1][1] if stack else None
            if name not in INLINE or name == "a":
                above = (tuple(words), above)
            stack.append((name, above))
            open_names[name] += 1
            silent += name in SILENT
            in_link += name == "a"
        i = end
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, i)
            i = n if not stop else stop.start()
    flush()
    return blocks
