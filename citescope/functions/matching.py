"""Matching of links inside one row by indexes (Arrow batches; called from ``operators.pairing``).

``first_matches`` (D2): for each archive of an article the first original equivalent to the URL
it embeds. ``pair_reference`` (P1): the greedy pairing of one reference element. URL forms are
computed in Spark; here they are only looked up:

* equal forms are dictionary keys with the places that have them, in list order;
* path containment on one host is an index over the paths: a keyword automaton of one side's
  paths reads every path of the other side once, in both directions, so it meets the pairs that
  hold and no others;
* the archives that are left are free lists, one per key they can be asked for by, in list
  order. A used archive is dropped from a list when it comes to its head.

Time is linear in the links, their length and the pairs of paths that hold one another.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterable

import ahocorasick


def _automaton(words: Iterable[str]):
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def containing(left: set[str], right: set[str]) -> dict[str, set[str]]:
    """For texts of ``left`` (no empty ones on either side) those of ``right`` that hold them or
    are held by them; texts with none are left out."""
    found: dict[str, set[str]] = defaultdict(set)
    if not left or not right:
        return found
    inside = _automaton(right)
    for text in left:
        for _, held in inside.iter(text):
            found[text].add(held)
    inside = _automaton(left)
    for text in right:
        for _, held in inside.iter(text):
            found[held].add(text)
    return found


def first_matches(originals: list[dict], archives: list[dict]) -> list[int | None]:
    """Place of the first original equivalent to each archive's embedded URL (``ex``)."""
    basic: dict[str, int] = {}
    norm: dict[str, int] = {}
    place: dict[tuple[str, str], int] = {}      # (host, path)
    paths: dict[str, dict[str, int]] = defaultdict(dict)
    for i, o in enumerate(originals):
        basic.setdefault(o["basic"], i)
        norm.setdefault(o["norm"], i)
        place.setdefault((o["dom"], o["path"]), i)
        if o["path"]:
            paths[o["dom"]].setdefault(o["path"], i)
    asked: dict[str, set[str]] = defaultdict(set)
    for a in archives:
        if a["ex"] and a["path"] and a["dom"] in paths:
            asked[a["dom"]].add(a["path"])
    held = {host: containing(wanted, set(paths[host])) for host, wanted in asked.items()}
    least = {(host, path): min(paths[host][x] for x in related)
             for host, found in held.items() for path, related in found.items()}
    out: list[int | None] = []
    for a in archives:
        here = (a["dom"], a["path"])
        hits = [x for x in (basic.get(a["basic"]), norm.get(a["norm"]), place.get(here),
                            least.get(here)) if x is not None]
        out.append(min(hits) if a["ex"] and hits else None)
    return out


class _Free:
    """The archives of a reference that are left, by every key they can be asked for."""

    def __init__(self, archives: list[dict], originals: list[dict]):
        self.archives = archives
        self.used = [False] * len(archives)
        self.lists: dict[tuple, deque[int]] = defaultdict(deque)
        self.asked = {(o["dom"], o["path"]) for o in originals if o["path"]}
        self.related: dict[str, dict[str, list[str]]] = {}
        self.paths: dict[str, set[str]] = defaultdict(set)
        for i, a in enumerate(archives):
            keys = [("any",), ("element", a["elem_key"]), ("parent", a["parent_key"]),
                    ("grandparent", a["grandparent_key"])]
            if a["ex"]:
                keys += [("basic", a["basic"]), ("norm", a["norm"]),
                         ("place", a["dom"], a["path"])]
                if a["path"]:
                    self.paths[a["dom"]].add(a["path"])
            for key in keys:
                if None not in key:
                    self.lists[key].append(i)

    def first(self, keys: Iterable[tuple]) -> int | None:
        """The first archive left that one of the keys asks for."""
        best = None
        for key in keys:
            places = self.lists.get(key)
            while places and self.used[places[0]]:
                places.popleft()
            if places and (best is None or places[0] < best):
                best = places[0]
        return best

    def holding(self, o: dict) -> Iterable[tuple]:
        """The keys of archives on the host of ``o`` whose path holds its path or is held."""
        host = o["dom"]
        if not o["path"] or host not in self.paths:
            return ()
        if host not in self.related:
            wanted = {path for dom, path in self.asked if dom == host}
            self.related[host] = containing(wanted, self.paths[host])
        return [("place", host, x) for x in self.related[host].get(o["path"], ())]

    def choose(self, o: dict) -> tuple[str | None, int | None]:
        """Address and element of the archive for ``o``: one that is near by, one of an equivalent
        URL, the one inside the next or the previous element, the first that is left."""
        found = self.first([("parent", o["parent_key"]), ("grandparent", o["grandparent_key"]),
                            *(("element", k) for k in o["near_keys"])])
        if found is None:
            found = self.first([("basic", o["basic"]), ("norm", o["norm"]),
                                ("place", o["dom"], o["path"]), *self.holding(o)])
        if found is None:
            left = self.first([("any",)])
            for side in ("next", "prev"):
                if left is not None and o[f"{side}_href"] is not None:
                    return o[f"{side}_href"], o[f"{side}_key"]
            found = left
        if found is None:
            return None, None
        return self.archives[found]["href"], self.archives[found]["elem_key"]

    def take(self, element: int) -> None:
        """Drop the first archive left that equals the element (none: nothing is dropped)."""
        found = self.first([("element", element)])
        if found is not None:
            self.used[found] = True


def pair_reference(originals: list[dict], archives: list[dict]) -> list[tuple[str, str]]:
    """(original, archive) of one reference: originals in order with the archive chosen for
    each ('' for none), then the archives left over with the URL they embed. Without any archive,
    or without any original, originals count once each."""
    if not originals or not archives:
        return ([(href, "") for href in dict.fromkeys(o["href"] for o in originals)]
                + [(a["ex"], a["href"]) for a in archives])
    free = _Free(archives, originals)
    pairs = []
    for o in originals:
        href, element = free.choose(o)
        pairs.append((o["href"], href or ""))
        if href is not None:
            free.take(element)
    return pairs + [(a["ex"], a["href"]) for a, used in zip(archives, free.used) if not used]
