"""The flat scan of ``functions.markup`` for many pages at once.

Pages are cut into texts and tags by one regular expression. Every distinct tag is read once; what
follows is numpy over all tags of the pages together, with no stack and no step per element:

* the depth of a tag is a prefix sum of opening and closing tags;
* sorted by (page, depth, place) an opening tag is followed by the tag that closes it;
* the parent of an element is the tag last seen at the depth above, found by bisection;
* the last descendant follows from the count of elements before the closing tag, the previous
  sibling from the elements sorted by parent;
* the digest of an element is a polynomial over the hashes of its texts and tags, taken from prefix
  sums, so equal markup has equal digests wherever it stands.

That holds for pages whose tags are properly nested: every end tag closes the element opened last.
Where they are not, one pass over the page's tags makes them so by the rules of ``markup``: an end
tag is put in for every element that another end tag, or the end of the page, closes with it, and
what those rules ignore is taken for no tag. The arrays are those of ``markup.scan``.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pandas.util import hash_array
from pyspark.sql.pandas.types import to_arrow_schema

from citescope.functions import markup
from citescope.schemas import MARKUP

CHUNK_CHARS = 1 << 20   # characters of pages scanned together (one page at least)
MEMO_TAGS = 20_000      # distinct tags remembered from chunk to chunk
OTHER, OPEN, LEAF, END = range(4)

_CUT = re.compile("(" + re.sub(r"\?P<\w+>", "?:", markup._MARKUP.pattern) + ")", re.S)
_PLAIN_TAG = re.compile(r'<(/?)([a-z][a-z0-9]*)((?: [a-z]+(?:-[a-z]+)*="[^"<>&]*")*)>')
FLAGS = {"li": 4, "ref": 8, **dict.fromkeys(markup.SECTION_HEADINGS, 16)}
_TYPE = pa.struct(list(to_arrow_schema(MARKUP)))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Tags(dict):
    """tag as written -> its number; what it says is in the lists below, by number."""

    def __init__(self):
        super().__init__()
        self.names: dict[str, int] = {}
        self.ends: list[int] = []   # hash of a name's end tag, by number of the name
        # By number: kind, name, flag, void, length. Flags: 1 link, 2 list of references, 4 li,
        # 8 ref, 16 heading, 32 raw text, 64 put in. Void: 1 a void element without a slash, 2 an
        # end or a slash.
        self.facts = array("q")
        self.hash = array("Q")
        self.link: list[tuple | None] = []
        self.raw: set[int] = set()
        self.changed: dict[tuple[int, int], int] = {}

    def _add(self, facts: tuple[int, int, int, int, int], digest: int, link: tuple | None) -> int:
        self.facts.extend(facts)
        self.hash.append(digest)
        self.link.append(link)
        return len(self.hash) - 1

    def arrays(self) -> np.ndarray:
        return np.array(self.facts).reshape(-1, 5).T

    def taken_for(self, number: int, kind: int) -> int:
        """The same tag as another kind: an element with a slash that stays open, or an end that is
        ignored and says nothing."""
        key = (number, kind)
        if key not in self.changed:
            _, name, flag, _, length = self.facts[5 * number:5 * number + 5]
            ignored = kind == OTHER
            self.changed[key] = self._add((kind, name, 0 if ignored else flag, 0, length),
                                          0 if ignored else self.hash[number], self.link[number])
        return self.changed[key]

    def end_of(self, name: int) -> int:
        """An end tag that is not written."""
        key = (-1 - name, END)
        if key not in self.changed:
            self.changed[key] = self._add((END, name, 64, 0, 0), self.ends[name], None)
        return self.changed[key]

    def _called(self, name: str) -> int:
        if name not in self.names:
            self.names[name] = len(self.ends)
            self.ends.append(xxhash.xxh3_64_intdigest(f"</{name}>".encode("utf-8", "surrogatepass")))
        return self.names[name]

    def __missing__(self, text: str) -> int:
        kind, flag, void, link = OTHER, 0, 0, None
        name, written, slash = "", [], False  # attributes as name="value without the last quote
        plain = _PLAIN_TAG.fullmatch(text)    # most tags are written like this
        if plain:
            end, name, said = plain.groups()
            kind = END if end else OPEN
            written = said[1:-1].split('" ') if said else []
        else:
            m = markup._MARKUP.match(text)
            name = (m["tag"] or m["end"] or "").lower()
            if m["end"]:
                kind = END
            elif m["tag"]:
                kind = OPEN
                slash = m["attributes"].endswith("/")
                written = [f'{k}="{v}' for k, v in markup._attributes(m["attributes"]).items()]
        called = self._called(name)
        if kind == END:
            void, digest = 2, self.ends[called]
        elif kind == OTHER:
            digest = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
        else:
            if slash or name in markup.VOID_ELEMENTS:
                kind, void = LEAF, 2 if slash else 1
            flag = 32 if name in markup.RAW_TEXT and kind == OPEN else FLAGS.get(name, 0)
            if written:
                if len(written) > 1 or written[0].startswith("class="):
                    attributes = dict([x.split('="', 1) for x in written])
                    if "class" in attributes:
                        attributes["class"] = " ".join(attributes["class"].split())
                    written = sorted(map('="'.join, attributes.items()))
                if name == "a" or name == "ol":
                    attributes = dict([x.split('="', 1) for x in written])
                    if name == "a" and "href" in attributes:
                        classes = attributes["class"].split() if "class" in attributes else None
                        flag, link = 1, (attributes["href"], classes, attributes.get("id"))
                    elif name == "ol" and markup.REFERENCE_LIST_CLASS in attributes.get("class", "").split():
                        flag = 2
            digest = xxhash.xxh3_64_intdigest("\x1e".join([name, *written]).encode("utf-8", "surrogatepass"))
        number = self[text] = self._add((kind, called, flag, void, len(text)), digest, link)
        if flag == 32:
            self.raw.add(number)
        return number


def _cut(page: str, tags: _Tags) -> tuple[list[str], list[int]]:
    """The texts of a page, and the tags between them by number; what stands in a raw text element
    is text."""
    parts = _CUT.split(page)
    texts, written = parts[::2], parts[1::2]
    numbers = list(map(tags.__getitem__, written))
    if not tags.raw.isdisjoint(numbers):
        skip = -1
        starts = [i for i, n in enumerate(numbers) if n in tags.raw]
        inside = []
        for i in starts:
            if i < skip:  # within the one before
                continue
            ending = END, tags.facts[5 * numbers[i] + 1]
            skip = next((k for k in range(i + 1, len(numbers))
                         if tuple(tags.facts[5 * numbers[k]:5 * numbers[k] + 2]) == ending), len(numbers))
            inside.append((i, skip))
        for i, end in reversed(inside):
            texts[i + 1:end + 1] = [texts[i + 1] + "".join(
                w + t for w, t in zip(written[i + 1:end], texts[i + 2:end + 1]))]
            del numbers[i + 1:end]
    return texts, numbers


def _nested(texts: list[str], numbers: list[int], tags: _Tags) -> tuple[list[str], list[int]]:
    """The same page properly nested (see above)."""
    facts, end_of = tags.facts, tags.end_of
    out_texts, out = [texts[0]], []
    open_names: list[int] = []
    swallow: dict[int, int] = {}
    for number, text in zip(numbers, texts[1:]):
        what, called = facts[5 * number], facts[5 * number + 1]
        if what == OPEN:
            open_names.append(called)
        elif what == END:
            if swallow.get(called):
                swallow[called] -= 1
                number = tags.taken_for(number, OTHER)
            elif open_names and open_names[-1] == called:
                open_names.pop()
            elif called in open_names:
                while open_names[-1] != called:
                    out.append(end_of(open_names.pop()))
                    out_texts.append("")
                open_names.pop()
            else:
                number = tags.taken_for(number, OTHER)
        elif what == LEAF:
            if facts[5 * number + 3] == 1:
                swallow[called] = swallow.get(called, 0) + 1
            elif swallow.get(called):
                swallow[called] -= 1
                number = tags.taken_for(number, OPEN)
                open_names.append(called)
        out.append(number)
        out_texts.append(text)
    while open_names:
        out.append(end_of(open_names.pop()))
        out_texts.append("")
    return out_texts, out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)),
                                    pa.array(values).cast(kind))


class _Batch:
    """The tags of several pages as arrays: of a tag its page, what it says, its place."""

    def __init__(self, cut: list[tuple[list[str], list[int]]], tags: _Tags):
        self.texts = list(chain.from_iterable([texts for texts, _ in cut]))
        n_tags = np.array([len(numbers) for _, numbers in cut], np.int64)
        self.number = np.fromiter(chain.from_iterable([numbers for _, numbers in cut]), np.int64,
                                  int(n_tags.sum()))
        self.page = np.repeat(np.arange(len(cut)), n_tags)
        self.first = np.r_[0, np.cumsum(n_tags)]
        self.kind, self.name, self.flag, self.void, self.length = (
            x[self.number] for x in tags.arrays())
        step = (self.kind == OPEN).astype(np.int64) - (self.kind == END)
        depth = np.r_[0, np.cumsum(step)]
        self.after = depth[1:] - depth[self.first[:-1]][self.page]
        self.left_open = depth[self.first[1:]] - depth[self.first[:-1]]
        self.level = self.after + (self.kind != OPEN)  # of an element; of an end, its element's

    def pairs(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Opening tags and the tags that stand where their ends should, of pages whose depth never
        falls below 0 and ends there."""
        tag = np.flatnonzero(((self.kind == OPEN) | (self.kind == END)) & good[self.page])
        tag = tag[np.lexsort((tag, self.level[tag], self.page[tag]))]
        return tag[::2], tag[1::2]

    def nested(self) -> np.ndarray:
        """Which pages are properly nested."""
        good = self.left_open == 0
        good[self.page[self.after < 0]] = False
        # A void element that is left to be closed: an end, or a slash, of its name.
        width = int(self.name.max(initial=0)) + 1
        called = self.page * width + self.name
        odd = np.intersect1d(called[self.void == 1], called[(self.void == 2) & (self.kind != OTHER)])
        good[odd // width] = False
        opens, ends = self.pairs(good)
        wrong = ((self.kind[opens] != OPEN) | (self.kind[ends] != END)
                 | (self.name[opens] != self.name[ends]))
        good[self.page[opens[wrong]]] = False
        return good


def _scan_chunk(pages: list[str], tags: _Tags) -> pa.Array:
    """The facts of several pages."""
    cut = [_cut(page, tags) for page in pages]
    batch = _Batch(cut, tags)
    good = batch.nested()
    if not good.all():
        cut = [c if ok else _nested(*c, tags) for c, ok in zip(cut, good)]
        batch = _Batch(cut, tags)
    texts, number, length, page, first_tag = batch.texts, batch.number, batch.length, batch.page, batch.first
    kind, flag, level = batch.kind, batch.flag, batch.level
    at = np.arange(len(number))
    n_tags = np.diff(first_tag)
    # A page has one text more than tags: text i stands before tag i - page.
    text_length = np.fromiter(map(len, texts), np.int64, len(texts))
    before = np.cumsum(text_length[at + page]) + np.r_[0, np.cumsum(length)][:-1]
    size = np.array(list(map(len, pages)), np.int64)
    gone = np.zeros(len(pages), np.int64)  # characters and last texts of earlier pages
    some = n_tags > 0
    gone[some] = before[first_tag[:-1][some]] - text_length[first_tag[:-1][some] + np.flatnonzero(some)]
    start = before - gone[page]
    end = start + length

    # An end that is not written stands where the tag that brings it, or the page, ends.
    written = np.where(flag == 64, len(number), at)
    following = np.minimum.accumulate(written[::-1])[::-1]
    known = following < len(number)
    known[known] = page[following[known]] == page[known]
    end = np.where(flag == 64, np.where(known, end[np.minimum(following, len(number) - 1)], size[page]), end)

    # ---- elements; element 0 of a page is the document
    opens, ends = batch.pairs(np.ones(len(pages), bool))
    closes = np.full(len(number), -1)
    closes[opens] = ends
    tag = np.flatnonzero((kind == OPEN) | (kind == LEAF))
    owner = page[tag]
    of = np.arange(len(pages))
    count = np.bincount(owner, minlength=len(of))  # elements of a page, without the document
    root = np.r_[0, np.cumsum(count + 1)][:-1]
    index = np.arange(len(tag)) + owner + 1        # of an element among all, documents included
    own = index - root[owner]                      # within its page
    total = len(tag) + len(of)

    deep = int(level.max(initial=0)) + 2
    key = (page * deep + level) * max(1, len(number)) + at
    holder = tag[kind[tag] == OPEN]
    holder = holder[np.argsort(key[holder])]
    wanted = (page[tag] * deep + level[tag] - 1) * max(1, len(number)) + at[tag]
    above = np.searchsorted(key[holder], wanted) - 1
    local = np.zeros(len(number), np.int64)
    local[tag] = own
    parent = np.full(total, -1)
    parent[index] = np.where(level[tag] == 1, 0, local[holder[np.maximum(above, 0)]] if len(holder) else 0)
    made = np.cumsum((kind == OPEN) | (kind == LEAF))  # elements up to a tag
    last = np.zeros(total, np.int64)
    last[root] = count
    started = np.r_[0, made][first_tag[:-1]][page[tag]]
    last[index] = np.where(kind[tag] == LEAF, own, made[closes[tag]] - started)
    previous = np.full(total, -1)
    family = root[owner] + parent[index]
    order = np.lexsort((index, family))
    same = family[order][1:] == family[order][:-1]
    previous[index[order][1:][same]] = own[order][:-1][same]
    is_link = np.zeros(total, bool)
    is_link[index] = flag[tag] == 1
    links_before = np.cumsum(is_link)
    seen = links_before - np.repeat((links_before - is_link)[root], count + 1)

    # ---- digests: item 2 i is a text, item 2 i + 1 the tag behind it
    hashes = np.zeros(2 * len(texts), np.uint64)
    hashes[::2] = hash_array(np.array(texts, object), categorize=False)
    hashes[::2][text_length == 0] = 0
    item = 2 * (at + page) + 1
    hashes[item] = np.array(tags.hash)[number]
    # Empty texts and ignored tags are no items.
    item_at = np.r_[0, np.cumsum(hashes != 0)]
    hashes = hashes[hashes != 0]
    powers = np.full(len(hashes) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    back = np.full(len(hashes) + 1, _INVERSE, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1])]
    a, b = np.zeros(total, np.int64), np.zeros(total, np.int64)
    a[root] = item_at[2 * (first_tag[of] + of)]
    b[root] = item_at[2 * (first_tag[of + 1] + of + 1) - 1]
    a[index] = item_at[item[tag]]
    b[index] = item_at[np.where(kind[tag] == LEAF, item[tag] + 1, item[closes[tag]])]
    keys = (sums[b] - sums[a]) * back[a]
    keys ^= keys >> np.uint64(29)
    keys[root] = ~keys[root]  # the document is no element

    # ---- links, references, headings
    linked = np.flatnonzero(flag[tag] == 1)
    is_ref = (flag[tag] == 8) & (kind[tag] == OPEN)
    depth_of_refs = np.zeros(len(number) + 1, np.int64)
    depth_of_refs[tag[is_ref]] += 1
    np.add.at(depth_of_refs, closes[tag[is_ref]], -1)
    in_ref = np.cumsum(depth_of_refs)[tag[linked]] > 0
    said = [tags.link[n] for n in number[tag[linked]].tolist()]
    links = pa.StructArray.from_arrays(
        [pa.array(own[linked], pa.int32()), pa.array([x[0] for x in said], pa.string()),
         pa.array([x[1] for x in said], pa.list_(pa.string())), pa.array([x[2] for x in said], pa.string()),
         pa.array(in_ref)], ["at", "href", "classes", "id", "in_ref"])
    links = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(
        owner[linked], minlength=len(of)))].astype(np.int32)), links)

    refs: list[list] = [[] for _ in of]
    listed = np.zeros(total, bool)
    listed[index] = flag[tag] == 2
    items = np.flatnonzero(flag[tag] == 4)
    items = items[listed[family[items]]]
    items = items[np.lexsort((own[items], parent[index[items]], owner[items]))]
    finish = np.where(kind[tag] == LEAF, end[tag], end[closes[tag]])
    for group, label in ((items, "list"), (np.flatnonzero(flag[tag] == 8), "ref")):
        for o, x, s, e in zip(owner[group].tolist(), own[group].tolist(), start[tag[group]].tolist(),
                              finish[group].tolist()):
            refs[o].append({"at": x, "kind": label, "start": s, "end": e})
    headings: list[list] = [[] for _ in of]
    for k in np.flatnonzero(flag[tag] == 16).tolist():
        whole = pages[owner[k]][start[tag[k]]:finish[k]]
        headings[owner[k]].append({"at": int(own[k]), "text": markup.visible_text(whole)})

    facts = {"parent": _lists(parent, count + 1, pa.int32()), "last": _lists(last, count + 1, pa.int32()),
             "previous": _lists(previous, count + 1, pa.int32()), "seen": _lists(seen, count + 1, pa.int32()),
             "key": _lists(keys.view(np.int64), count + 1, pa.int64()), "links": links,
             "refs": pa.array(refs, _TYPE.field("refs").type),
             "headings": pa.array(headings, _TYPE.field("headings").type)}
    return pa.StructArray.from_arrays([facts[f.name].cast(f.type) for f in _TYPE], fields=list(_TYPE))


def scan_pieces(columns: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """``markup.scan`` of every page of some string columns, in order; null without markup. What is
    held at a time is a chunk of pages and its facts, however many pages a column has."""
    tags = _Tags()
    for html in columns:
        html = html.cast(pa.string())
        ends = np.cumsum(pc.fill_null(pc.utf8_length(html), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(html):
            gone = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, gone + CHUNK_CHARS, side="right")))
            pages = html.slice(start, stop - start).to_pylist()
            some = [page for page in pages if page]
            facts = _scan_chunk(some, tags) if some else pa.nulls(len(pages), _TYPE)
            if 0 < len(some) < len(pages):
                place = np.cumsum([bool(page) for page in pages]) - 1
                facts = facts.take(pa.array(place, mask=np.array([not page for page in pages])))
            yield facts
            if len(tags) > MEMO_TAGS:
                tags = _Tags()
            start = stop
    pa.default_memory_pool().release_unused()  # the worker is kept, its peak need not be


def scan_pages(html: pa.Array) -> pa.Array:
    """``markup.scan`` of every page of a string column; null without markup."""
    return pa.concat_arrays([pa.nulls(0, _TYPE), *scan_pieces([html])])
