"""Pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

#: Comments, declarations and tags.  A quoted value may hold >; a quote that never closes does not swallow the page.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
#: What is markup where no > follows.
_UNCLOSED = re.compile(r"<!--.*()()()()()()", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: A block's path tells of its innermost elements, at most so many.
DEEPEST = 64

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements within a line of text: they end no block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is not markup.
RAW = frozenset(("script", "style"))
#: An element of the first kind ends an open one of the second.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPE = frozenset("article aside body div footer form header html main nav ol section table td th ul".split())


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    link_chars: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and each word of its class, id and role."""
    if not attributes or "=" not in attributes:
        return (tag,)
    out = [tag]
    for m in _ATTRIBUTE.finditer(attributes):
        out += ["." + n for n in _NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(out)


def blocks(page: str) -> list[Block]:
    """The blocks of text in page order, references decoded, white space as one space; empty ones are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links, in_link = 0, 0

    def close() -> None:
        nonlocal links
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(tuple(n for tag, names in stack[-DEEPEST:] if tag not in INLINE for n in names), text, links))
            parts.clear()
        links = 0

    def drop(k: int) -> None:
        nonlocal in_link
        in_link -= sum(tag == "a" for tag, _ in stack[k:])
        for tag, _ in stack[k:]:
            counts[tag] -= 1
        del stack[k:]

    counts: Counter = Counter()

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        m = _MARKUP.search(page, at) if at <= last else _UNCLOSED.search(page, at)
        to = m.start() if m else end
        if to > at:
            parts.append(page[at:to])
            if in_link:
                links += to - at
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag not in INLINE:
                close()
            if counts[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if tag in INLINE and stack[k][0] not in INLINE:
                        break
                    if stack[k][0] == tag:
                        drop(k)
                        break
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            close()
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            close()
            ends = CLOSES.get(tag, ())
            if tag in _ENDS_P:
                ends = (*ends, "p")
            for k in range(len(stack) - 1, -1, -1) if any(counts[t] for t in ends) else ():
                if stack[k][0] in ends:
                    drop(k)
                    break
                if stack[k][0] in _SCOPE and stack[k][0] not in ends:
                    break
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, _names(tag, attributes)))
            counts[tag] += 1
            in_link += tag == "a"
    close()
    return out
