"""Leaf blocks of an HTML page: the text between block-level tags, with the path of open elements.

A small tolerant tokeniser: comments, declarations and the content of raw
elements are markup; unclosed elements end where HTML says they do (a paragraph
at the next block, a list item at the next item) or at the end of an ancestor.
Formulas, objects and noscript belong to the text around them; a graphic or a
template inside a paragraph is blocks of its own, and the paragraph goes on behind it.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

#: Fixed sets of element names (HTML standard).
RAW = {"script", "style", "iframe", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
          "time", "tt", "u", "var", "wbr", "label", "object", "noscript", "param", "tspan", "textpath",
          "math", "semantics", "annotation", "annotation-xml", "maction", "menclose", "merror", "mfenced", "mfrac", "mi",
          "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace",
          "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none"}
#: Inline elements whose content may be whole sentences: a space keeps it apart.
APART = {"object", "noscript", "mtd"}
#: Elements whose text is kept apart from the block they stand in.
SIDE = {"svg", "template"}
#: A start tag that ends an open graphic (HTML standard, its block-level names).
BREAKOUT = {"blockquote", "body", "center", "dd", "div", "dl", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "li",
            "menu", "ol", "p", "pre", "table", "ul"}
#: A start tag of the key ends an open element of the values, unless one of ``SCOPE`` is nearer.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "html", "body", "article", "section", "div", "template"}

#: A deeper path holds so many of the outermost and of the innermost open elements, and between them each other open name once.
OUTER, INNER = 8, 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _name(tag: str, attrs: str) -> str:
    """Element name with the words of its class, id and role: ``div.side.bar``."""
    if not attrs or ("class" not in attrs and "id" not in attrs and "role" not in attrs and "CLASS" not in attrs):
        return tag
    words = []
    for m in _HINT.finditer(attrs):
        words += [w for w in _SPLIT.split(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()) if w]
    return ".".join([tag, *words])


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of every leaf with text, in page order."""
    out, stack, names, parts = [], [], [], []
    # depths at which each element is open, and how often each name of a path is
    held, seen = defaultdict(list), Counter()
    links = link_chars = 0
    # of the open ``SIDE`` elements: depth, name, and what is held of the block around; ``place``: where a block goes that has one inside
    side, place = [], None
    page = page or ""

    def where():
        if len(names) <= OUTER + INNER:
            return tuple(names)
        ends = {*names[:OUTER], *names[-INNER:]}
        return (*names[:OUTER], *[x for x in seen if x not in ends], *names[-INNER:])

    def push(tag, attrs):
        held[tag].append(len(stack))
        stack.append(tag)
        names.append(_name(tag, attrs))
        seen[names[-1]] += 1

    def flush():
        nonlocal link_chars, place
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.insert(len(out) if place is None else place, (where(), text, min(link_chars, len(text))))
            parts.clear()
        link_chars, place = 0, None

    def pop(n):
        nonlocal parts, link_chars, place
        while side and side[-1][0] >= n:
            flush()
            depth, _, parts, link_chars, place = side.pop()
            cut(depth)
            if depth > n:
                flush()
        cut(n)

    def cut(n):
        for tag, name in zip(stack[n:], names[n:]):
            held[tag].pop()
            seen[name] -= 1
            if not seen[name]:
                del seen[name]
        del stack[n:]
        del names[n:]

    pos, end = 0, len(page)
    while pos < end:
        lt = page.find("<", pos)
        m = _TOKEN.match(page, lt) if lt >= 0 else None
        if lt < 0 or m is None:
            # text up to the next tag, or a bare "<"
            stop = end if lt < 0 else lt + 1
            chunk = page[pos:stop]
            parts.append(chunk)
            link_chars += len(chunk) if links else 0
            pos = stop
            continue
        if lt > pos:
            chunk = page[pos:lt]
            parts.append(chunk)
            link_chars += len(chunk) if links else 0
        pos = m.end()
        close, tag, attrs = m[1], m[2] or m[4], m[3] or m[5] or ""
        if close:
            close = close.lower()
            if close in INLINE:
                if close == "a":
                    links = max(0, links - 1)
                elif close in APART:
                    parts.append(" ")
                continue
            flush()
            if held[close]:
                pop(held[close][-1])
                links = links if close in SIDE else 0
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not attrs.endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
                pos = shut.end() if shut else end
            continue
        graphic = bool(side) and side[-1][1] == "svg"
        if graphic and tag in BREAKOUT and not held["foreignobject"]:
            pop(side[-1][0])
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            links += tag == "a"
            if tag in APART:
                parts.append(" ")
            continue
        if tag in SIDE:
            if not attrs.endswith("/"):
                side.append((len(stack), tag, parts, link_chars, len(out) if place is None and parts else place))
                parts, link_chars, place = [], 0, None
                push(tag, attrs)
            continue
        flush()
        if tag in VOID or graphic and attrs.endswith("/"):
            continue
        if stack and stack[-1] == "p":
            pop(len(stack) - 1)
        if tag in ENDS:
            near = max((held[x][-1] for x in ENDS[tag] if held[x]), default=-1)
            if near > max((held[x][-1] for x in SCOPE if held[x]), default=-1):
                pop(near)
        push(tag, attrs)
    flush()
    pop(0)
    flush()
    return out
