"""Flat scan of a page's markup (the only Python step; one pass, no tree).

``scan`` walks the tags of a page once with a stack of open elements and returns numbers and
links only: for every element its parent, its last descendant, its previous sibling and a
digest of its markup, and the links, reference elements and headings by element number.
Everything about them - neighbours, sections, pairing, flags - is expressed over these arrays in
Spark (``operators.extraction``, ``operators.pairing``).

Element rules, which fix the results: names are case-insensitive; void elements hold nothing; an
end tag closes the nearest open element of its name with all inside it and is ignored if none is
open; nothing else is closed before its container. After a void element written without a
slash, the next end of that name - a slash counts as one - is swallowed. Script and style hold
text. Element 0 is the document.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape
from itertools import accumulate

# ---- fixed values --------------------------------------------------------------------------
VOID_ELEMENTS = frozenset("""area base basefont bgsound br col command embed frame hr image img
input isindex keygen link menuitem meta nextid param source spacer track wbr""".split())
RAW_TEXT = ("script", "style")
REFERENCE_LIST_CLASS = "references"
SECTION_HEADINGS = ("h2", "h3", "h4")
# Elements whose text is not visible text.
UNSEEN = r"(?is)<(script|style|template|rt|rp)\b.*?</\1\s*+>"
# --------------------------------------------------------------------------------------------

_NAME = r"[^\s/>=][^\s/>=]*+|=[^\s/>=]*+"
_VALUE = r"""\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+)"""
_ATTRIBUTE = re.compile(rf"""[\s/]*+({_NAME})(?:\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))?""")
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    rf"|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[\s/]*+(?:{_NAME})(?:{_VALUE})?)*+[\s/]*+)>",
    re.S)


def _attributes(text: str) -> dict[str, str]:
    """Names lower-cased; of repeated names the last counts; a bare name is empty."""
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found[name.lower()] = unescape(value) if "&" in value else value
    return found


def visible_text(markup: str) -> str:
    """The visible text of an element's markup, lower-cased."""
    return unescape(_MARKUP.sub("", re.sub(UNSEEN, "", markup))).strip().lower()


def scan(page: str | None) -> dict | None:
    """Flat facts of one page (see ``schemas.MARKUP``); None without markup."""
    if not page:
        return None
    parent, last, previous, keys, starts, ends = [-1], [0], [-1], [0], [0], [len(page)]
    names = [""]
    youngest = [-1]                 # last child so far, by element
    parts: dict[int, list[bytes]] = {0: []}     # of open elements: texts and children's digests
    stack = [0]
    swallow: Counter = Counter()
    links, lists, refs, headings = [], [], [], []
    open_refs = 0
    raw = None                      # name of an open script or style element

    def close(upto: int, at: int) -> None:
        """Close open elements down to and including stack position ``upto``."""
        nonlocal open_refs
        while len(stack) > upto:
            element = stack.pop()
            last[element], ends[element] = len(parent) - 1, at
            open_refs -= names[element] == "ref"
            digest = blake2b(b"\x1f".join(parts.pop(element)), digest_size=8).digest()
            keys[element] = int.from_bytes(digest, "big", signed=True)
            if stack:
                parts[stack[-1]].append(digest)

    at = 0
    for m in _MARKUP.finditer(page):
        if raw and (m["end"] or "").lower() != raw:
            continue
        if m.start() > at:
            parts[stack[-1]].append(page[at:m.start()].encode("utf-8", "surrogatepass"))
        at, raw = m.end(), None
        if m["tag"]:
            name = m["tag"].lower()
            attributes = _attributes(m["attributes"])
            element, own = len(parent), stack[-1]
            parent.append(own)
            last.append(element)
            previous.append(youngest[own])
            youngest[own] = element
            youngest.append(-1)
            keys.append(0)
            names.append(name)
            starts.append(m.start())
            ends.append(at)
            markup = [name.encode("utf-8", "surrogatepass")]
            for k, v in sorted(attributes.items()):
                v = " ".join(v.split()) if k == "class" else v
                markup.append(f"{k}={v}".encode("utf-8", "surrogatepass"))
            parts[element] = [b"\x1e".join(markup)]
            if name == "a" and "href" in attributes:
                classes = attributes["class"].split() if "class" in attributes else None
                links.append((element, attributes["href"], classes, attributes.get("id"),
                              open_refs > 0))
            elif name == "ol" and REFERENCE_LIST_CLASS in attributes.get("class", "").split():
                lists.append(element)
            elif name == "ref":
                refs.append(element)
            elif name in SECTION_HEADINGS:
                headings.append(element)
            stack.append(element)
            open_refs += name == "ref"
            if m["attributes"].endswith("/"):
                if swallow[name]:
                    swallow[name] -= 1
                else:
                    close(len(stack) - 1, at)
            elif name in VOID_ELEMENTS:
                close(len(stack) - 1, at)
                swallow[name] += 1
            elif name in RAW_TEXT:
                raw = name
        elif m["end"]:
            name = m["end"].lower()
            if swallow[name]:
                swallow[name] -= 1
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if names[stack[i]] == name), 0)
            if depth:
                close(depth, at)
        else:
            parts[stack[-1]].append(m[0].encode("utf-8", "surrogatepass"))
    if at < len(page):
        parts[stack[-1]].append(page[at:].encode("utf-8", "surrogatepass"))
    close(0, len(page))

    by_list: dict[int, list[int]] = {x: [] for x in lists}
    for element, name in enumerate(names):
        if name == "li" and parent[element] in by_list:
            by_list[parent[element]].append(element)
    linked = set(x[0] for x in links)
    seen = list(accumulate(int(x in linked) for x in range(len(parent))))

    def reference(element: int, kind: str) -> tuple:
        return element, kind, starts[element], ends[element]

    return {"parent": parent, "last": last, "previous": previous, "seen": seen, "key": keys,
            "links": links,
            "refs": [reference(x, "list") for o in lists for x in by_list[o]]
            + [reference(x, "ref") for x in refs],
            "headings": [(x, visible_text(page[starts[x]:ends[x]])) for x in headings]}
