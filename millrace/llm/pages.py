"""Pages as flat text blocks: one pass over the tags, no tree."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"<!--.*?-->|<(script|style|template|svg|iframe|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>|<[!?][^>]*>",
    re.S | re.I,
)
# Elements that end a block, and those that hold blocks.
_BLOCK = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 td th tr table blockquote section article main aside nav header footer form dl dt dd pre figure figcaption body head html title br hr option select noscript address details summary center".split())
_HOLD = frozenset("div section article main aside nav header footer td form noscript table".split())
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*["']?([^"'>\s][^"'>]*)""", re.I)
_SPACES = re.compile(r"\s+")


class Block(NamedTuple):
    """A run of text without a block element inside."""

    text: str
    tag: str
    words: int
    linked: int
    hold: str  # innermost holding element and its class, as "tag.class"; a div that has neither class nor id holds nothing of its own
    path: str  # all of them, outermost first
    level: int


def blocks_of(page: str) -> list[Block]:
    """The visible blocks of a page in order. ``noscript`` is kept and recognisable by its path. Text without tags gives a block per line."""
    if "<" not in page:
        return [Block(t, "p", len(t.split()), 0, "", "", 0) for line in page.split("\n") if (t := _SPACES.sub(" ", line).strip())]
    out: list[Block] = []
    holds: list[tuple[str, str]] = []
    parts: list[str] = []
    linked: list[str] = []
    tag, link, level = "", 0, 0
    at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACES.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                names = [c for _, c in holds if c]
                out.append(Block(text, tag, len(text.split()), len(_SPACES.sub(" ", html.unescape(" ".join(linked))).split()) if linked else 0, names[-1] if names else "", "/".join(names), level))
            parts, linked = [], []

    for m in _TOKEN.finditer(page):
        a = m.start()
        if a > at:
            chunk = page[at:a]
            parts.append(chunk)
            if link:
                linked.append(chunk)
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        closing = m.group(2)
        if name == "a":
            link = 0 if closing else 1
        elif name in _BLOCK:
            flush()
            if name in _HOLD:
                if closing:
                    for k in range(len(holds) - 1, -1, -1):
                        if holds[k][0] == name:
                            del holds[k:]
                            break
                else:
                    c = _CLASS.search(m.group(4))
                    holds.append((name, f"{name}.{c.group(1).lower()}" if c else "" if name == "div" else name))
                tag = "" if closing else name
            else:
                tag = "" if closing else name
                if name == "title":
                    tag = "title" if not closing else ""
            level = len(holds)
        elif name in ("img", "input", "span", "b", "i", "em", "strong"):
            pass
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out
