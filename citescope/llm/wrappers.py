"""Main-text extraction by union-free wrapper inference.

A page becomes a stream of tokens: block-level tags with their classes, and text slots (``#``,
or ``@`` where all text is link text). Runs of equal token groups in one page become a repeated
group. The streams of one host are aligned one after another into its wrapper: tokens that
agree stay, tokens that only some pages have become optional, a group that repeats in any page
is a repeated group, and groups that differ inside are aligned inside. Texts are slots and
never part of a token, so differing texts align by themselves.

Pages are aligned with their host's wrapper, and each slot is decided over all pages of the
host that fill it (under the same path of tag names; a text aligned under another path says
nothing about the slot). The containers around the text vote: main text (``article``, ``main``)
or page furniture (navigation, header, footer, sidebar, notice, advert, form, comments). Where
more than half the pages agree, the slot is that on every page; else the page's own containers
count. A main slot that holds one and the same text on pages that differ otherwise, or
is a repeated list of nothing but links, is furniture too. A page's text is that of its main
slots. A page without any falls back on the slots that are neither furniture nor link lists nor
the same text on all such pages of the host.

Distinct streams are counted before anything is aligned, so a host that holds a third of all
pages costs its distinct streams; those are folded in salted parts that merge per host, each
part a stream that keeps only the wrapper.

Defined cases: null or empty HTML has the empty text; a null URL or one without ``://`` belongs
to the host ""; unclosed tags end with their container, stray signs are text; repeated rows
are extracted alike, one by one; an empty table gives no rows; other columns are ignored;
pages are read whole.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citescope.llm.batches import chunks, in_arrow
from citescope.llm.joins import broadcast_if_small
from citescope.session import scratch_path

SALTS = 16
CELLS = 1 << 22      # of an alignment table; longer streams are aligned greedily
LONGEST_GROUP = 24   # tokens of a repeated group

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div
dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main
menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul
""".split())
# Their end tags may be left out, so they are no containers.
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup hr".split())
FURNITURE = frozenset("nav menu footer aside form select dialog head fieldset".split())
MAIN = frozenset("article main".split())
FURNITURE_WORDS = frozenset("""ad ads advert advertisement advertising banner breadcrumb
breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form header menu
modal nav navbar navigation newsletter notice pagination popup promo promoted related replies
reply share sharing sidebar social sponsor sponsored subscribe toolbar widget""".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(script|style|noscript|template|textarea|title|iframe|object|svg|math|button|canvas"
    r"|audio|video)\b(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+(?:(?<=/)>|>.*?(?:</\1\b[^>]*+>|\Z))"
    r"|<(/?)([a-z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>", re.S | re.I)
LABELS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[a-z]+")


@functools.lru_cache(maxsize=4096)
def tag_token(name: str, attributes: str, in_main: bool = False) -> str:
    """The tag with its label words that tell furniture from text; others would only make
    streams differ. Labels say nothing against an element that is main text by its name, or that
    holds the whole page; a ``header`` is a page's furniture, but the title of a main text."""
    words = {w for m in LABELS.finditer(attributes) for w in PARTS.findall("".join(
        x for x in m.groups() if x).lower())}
    if name in MAIN:
        return f"*<{name}>"
    labelled = words & FURNITURE_WORDS and name not in ("html", "body")
    kind = "!" if name in FURNITURE or labelled or (name == "header" and not in_main) else (
        "*" if words & MAIN else "")
    return f"{kind}<{name}>"


def page_tokens(page: str) -> tuple[list[str], list[str]]:
    """(tokens, text of each slot in order)."""
    tokens: list[str] = []
    texts: list[str] = []
    parts: list[str] = []
    plain = linked = False
    in_link = in_main = 0

    def close_slot() -> None:
        nonlocal plain, linked
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            tokens.append("@" if linked and not plain else "#")
            texts.append(text)
        plain = linked = False

    def add(text: str) -> None:
        nonlocal plain, linked
        if text:
            parts.append(text)
            if not text.isspace():
                plain, linked = plain or not in_link, linked or in_link > 0

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at:m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name, end = name.lower(), m[2]
        if name in BLOCKS:
            close_slot()
            if name in MAIN:
                in_main = max(0, in_main + (-1 if end else 1))
            if not end:
                tokens.append(tag_token(name, m[4], in_main > 0))
            elif name not in OPEN_ENDED:
                tokens.append(f"</{name}>")
        elif name == "a":
            in_link = max(0, in_link + (-1 if end else 1))
        elif name in ("br", "img", "input", "wbr"):
            parts.append(" " if name == "br" else "")
    add(page[at:])
    close_slot()
    return tokens, texts


# A stream or wrapper is a list of items [what, optional]; what is a token or, for a repeated
# group, a list of items.

def fold(tokens: list[str]) -> list[list]:
    """Items of one page, runs of equal groups folded into repeated groups."""
    out: list = []  # tokens and tuples (groups)
    for token in tokens:
        out.append(token)
        again = True
        while again:
            again = False
            for k in range(1, min(LONGEST_GROUP, len(out) - 1) + 1):
                tail = tuple(out[-k:])
                if out[-k - 1] == tail:       # one more of the group before
                    del out[-k:]
                    again = True
                elif len(out) >= 2 * k and tuple(out[-2 * k:-k]) == tail and not (
                        k == 1 and isinstance(tail[0], tuple)):
                    del out[-2 * k:]
                    out.append(tail)
                    again = True
                if again:
                    break

    def items(nodes) -> list[list]:
        return [[items(n) if isinstance(n, tuple) else n, 0] for n in nodes]

    return items(out)


def slots(items: list[list], path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, what) of every token of a wrapper, in order."""
    for i, (what, _) in enumerate(items):
        if isinstance(what, list):
            yield from slots(what, (*path, i))
        else:
            yield (*path, i), what


def alike(a, b) -> bool:
    """Same token, or groups that begin and end alike (they are aligned inside)."""
    while isinstance(a, list) and isinstance(b, list):
        if a[-1][0] != b[-1][0] and not (isinstance(a[-1][0], list) and isinstance(b[-1][0], list)):
            return False
        a, b = a[0][0], b[0][0]
    return a == b


def grouped(items: list[list], groups: list[list]) -> list[list]:
    """``items`` with single occurrences of ``groups`` written as groups."""
    for group in groups:
        want = [x for x, optional in group if not optional]
        n, i, out = len(want), 0, []
        while i < len(items):
            if n and [x for x, _ in items[i:i + n]] == want:
                out.append([[list(x) for x in items[i:i + n]], 0])
                i += n
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def matches(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence."""
    head = 0
    while head < min(len(a), len(b)) and alike(a[head][0], b[head][0]):
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and alike(a[-1 - tail][0], b[-1 - tail][0]):
        tail += 1
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    middle: list[tuple[int, int]] = []
    if len(x) * len(y) <= CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = (best[i + 1][j + 1] + 1 if alike(x[i][0], y[j][0])
                              else max(best[i + 1][j], best[i][j + 1]))
        i = j = 0
        while i < len(x) and j < len(y):
            if alike(x[i][0], y[j][0]):
                middle.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:  # first later occurrence of each token
        at: dict[str, list[int]] = {}
        for j in range(len(y) - 1, -1, -1):
            at.setdefault(json.dumps(y[j][0]), []).append(j)
        last = -1
        for i, (what, _) in enumerate(x):
            later = at.get(json.dumps(what), [])
            while later and later[-1] <= last:
                later.pop()
            if later:
                last = later.pop()
                middle.append((i, last))
    return ([(i, i) for i in range(head)] + [(head + i, head + j) for i, j in middle]
            + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)])


def align(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two wrappers or streams."""
    groups = [x for x, _ in a if isinstance(x, list)], [x for x, _ in b if isinstance(x, list)]
    a, b = grouped(a, groups[1]), grouped(b, groups[0])
    out, i, j = [], 0, 0
    for m, n in [*matches(a, b), (len(a), len(b))]:
        out += [[what, 1] for what, _ in a[i:m]] + [[what, 1] for what, _ in b[j:n]]
        if m < len(a):
            what = align(a[m][0], b[n][0]) if isinstance(a[m][0], list) else a[m][0]
            out.append([what, a[m][1] | b[n][1]])
        i, j = m + 1, n + 1
    return out


def kinds(items: list[list]) -> list[str]:
    """What each slot of a wrapper or stream is by its containers, in order: ``main``,
    ``furniture`` or ``other``."""
    return [kind for kind, _ in placed(items)]


def placed(items: list[list]) -> list[tuple[str, str]]:
    """(kind, path of tag names) of each slot by its containers, in order."""
    stack: list[str] = []
    found = []
    for _, token in slots(items):
        if token in ("#", "@"):
            marks = {t[0] for t in stack}
            found.append(("furniture" if "!" in marks else "main" if "*" in marks else "other",
                          "/".join(t.strip("!*<>") for t in stack)))
        elif token.startswith("</"):
            name = f"<{token[2:]}"
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].endswith(name):
                    del stack[i:]
                    break
        elif token.strip("!*<>") not in OPEN_ENDED:
            stack.append(token)
    return found


def slot_numbers(wrapper: list[list], tokens: list[str]) -> list[int]:
    """The wrapper slot of each text of a page (-1: none)."""
    numbers: dict[tuple, int] = {}
    for path, token in slots(wrapper):
        if token in ("#", "@"):
            numbers[path] = len(numbers)

    def lay(items: list[list], own: list[list], path: tuple, out: list[int]) -> None:
        pairs = dict((j, i) for i, j in matches(items, own))
        for j, (what, _) in enumerate(own):
            i = pairs.get(j)
            if isinstance(what, list):
                lay(items[i][0] if i is not None else [], what,
                    (*path, i) if i is not None else (), out)
            elif what in ("#", "@"):
                out.append(numbers.get((*path, i), -1) if i is not None else -1)

    folded = grouped(fold(tokens), [x for x, _ in wrapper if isinstance(x, list)])
    flat: list[int] = []
    lay(wrapper, folded, (), flat)
    if len(flat) == sum(t in ("#", "@") for t in tokens):
        return flat

    # texts of repeated groups: walk the page's tokens through the folded items once more
    out: list[int] = []

    def walk(items: list[list], at: int, first: int) -> tuple[int, int]:
        """Consume tokens from ``at``; ``first`` is the number of the first slot in ``flat``."""
        for what, _ in items:
            if isinstance(what, list):
                size = sum(t in ("#", "@") for _, t in slots(what))
                while True:
                    mark = len(out)
                    end, _ = walk(what, at, first)
                    if end < 0:
                        del out[mark:]
                        break
                    at = end
                first += size
            elif at < len(tokens) and tokens[at] == what:
                if what in ("#", "@"):
                    out.append(flat[first])
                    first += 1
                at += 1
            else:
                return -1, first
        return at, first

    walk(folded, 0, 0)
    return out


class HostPages:
    """Slots of pages under one host's wrapper, remembered per distinct stream. ``decided``
    (JSON) has the slots that are not what each page's own containers make them."""

    def __init__(self, wrapper: str | None, decided: str | None = None):
        self.wrapper = json.loads(wrapper) if wrapper else []
        self.decided = {(d["slot"], d["path"]): d["kind"]
                        for d in (json.loads(decided) if decided else [])}
        self.seen: dict[tuple, tuple[list[int], list[tuple[str, str]]]] = {}

    def places(self, tokens: list[str]) -> tuple[list[int], list[tuple[str, str]]]:
        """(slot number, (kind, path) by the page's own containers) of each text of the page."""
        key = tuple(tokens)
        if key not in self.seen:
            if len(self.seen) >= 1000:
                self.seen.clear()
            own = placed([[t, 0] for t in tokens])
            number = slot_numbers(self.wrapper, tokens)
            number += [-1] * (len(own) - len(number))
            self.seen[key] = number, own
        return self.seen[key]

    def of(self, tokens: list[str]) -> tuple[list[int], list[str]]:
        """(slot number, kind) of each text of the page: as decided for the host; the page's own
        containers where it has no such slot."""
        number, own = self.places(tokens)
        return number, [self.decided.get((n, path), kind)
                        for n, (kind, path) in zip(number, own)]


def _pages(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
        .alias("host"), F.col("html").cast("string").alias("html"))


def _fold_hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, salt, wrapper) sorted by host and salt -> one wrapper per (host, salt)."""
    names = ["host", "salt", "wrapper"]
    last, wrapper = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([last[0]]), pa.array([last[1]], pa.int32()), pa.array([json.dumps(wrapper)])],
            names=names)

    for batch in batches:
        for host, salt, stream in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, salt) != last:
                if last:
                    yield row()
                last, wrapper = (host, salt), json.loads(stream)
            else:
                wrapper = align(wrapper, json.loads(stream))
    if last:
        yield row()


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): the wrapper of every host, written to the shared folder."""
    spark = pages.sparkSession
    schema = "host string, salt int, wrapper string"

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            count: dict[tuple, int] = {}
            memo: dict[tuple, str] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = tuple(page_tokens(page)[0])
                if tokens not in memo:
                    memo[tokens] = json.dumps(fold(list(tokens)))
                count[host, memo[tokens]] = count.get((host, memo[tokens]), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in count]), pa.array([s for _, s in count]),
                 pa.array(list(count.values()), pa.int64())], names=["host", "wrapper", "n"])

    distinct = (_pages(pages).where("html IS NOT NULL").select("host", "html")
                .transform(in_arrow, streams, "host string, wrapper string, n long")
                .groupBy("host", "wrapper").agg(F.sum("n").alias("n"))
                .withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int")))
    parts = (distinct.repartition("host", "salt")
             .sortWithinPartitions("host", "salt", F.desc("n"), "wrapper")
             .select("host", "salt", "wrapper").transform(in_arrow, _fold_hosts, schema))
    whole = (parts.repartition("host").sortWithinPartitions("host", "salt")
             .select("host", F.lit(0).alias("salt"), "wrapper").transform(in_arrow, _fold_hosts, schema))
    path = scratch_path(spark, "wrappers")
    whole.select("host", "wrapper").write.parquet(path)
    return spark.read.schema("host string, wrapper string").parquet(path)


EVIDENCE = ("host string, slot int, path string, main int, furniture int, other int, plain boolean, "
            "links boolean, least long, most long, page long, longest long, second long")


def _evidence(host: str, tokens: list[str], texts: list[str], host_pages: HostPages
              ) -> Iterator[tuple]:
    """A row of EVIDENCE for each slot (and path) that a page fills."""
    def digest(text: str) -> int:
        value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        return value - (1 << 64) if value >> 63 else value

    number, own = host_pages.places(tokens)
    plain = all(kind != "main" for kind, _ in own)
    links = [t == "@" for t in tokens if t in ("#", "@")]
    filled: dict[tuple[int, str], list[int]] = {}
    for i, n in enumerate(number):
        if n >= 0:
            filled.setdefault((n, own[i][1]), []).append(i)
    page = digest("\n".join(texts))
    by_length = sorted(set(texts), key=lambda t: (-len(t), t))[:3]
    for (n, path), at in filled.items():
        here = [own[i][0] for i in at]
        kind = max(("main", "furniture", "other"), key=here.count)
        held = {texts[i] for i in at}
        hashes = [digest(t) for t in held]
        others = [digest(t) for t in by_length if len(held) > 1 or t not in held]
        yield (host, n, path, *(int(kind == k) for k in ("main", "furniture", "other")),
               plain and kind == "other", len(at) > 1 and all(links[i] for i in at),
               min(hashes), max(hashes), page, others[0] if others else None,
               others[min(1, len(others) - 1)] if others else None)


def decide(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, decided (JSON): the slots that the pages of a host decide otherwise than some page's
    own containers do."""
    names = [x.split()[0] for x in EVIDENCE.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64()}
             [x.split()[1]] for x in EVIDENCE.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, HostPages] = {}
        for batch in chunks(batches, "html"):
            out: list[tuple] = []
            for host, page, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                if host not in hosts:
                    hosts[host] = HostPages(wrapper)
                out += _evidence(host, *page_tokens(page), hosts[host])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(types)], names=names)

    slot = (pages.where("html IS NOT NULL").join(wrappers, "host")
            .select("host", "html", "wrapper").transform(in_arrow, rows, EVIDENCE)
            .groupBy("host", "slot", "path")
            .agg(*[F.sum(k).alias(k) for k in ("main", "furniture", "other")],
                 F.min("least").alias("least"), F.max("most").alias("most"),
                 F.min(F.when(F.col("plain"), F.col("least"))).alias("plain_least"),
                 F.max(F.when(F.col("plain"), F.col("most"))).alias("plain_most"),
                 F.approx_count_distinct(F.when(F.col("plain"), F.col("page"))).alias("plain_pages"),
                 F.sum(F.col("links").cast("int")).alias("links"),
                 F.approx_count_distinct("page").alias("pages"),
                 F.approx_count_distinct("longest").alias("longest"),
                 F.approx_count_distinct("second").alias("second")))
    pages_of = F.col("main") + F.col("furniture") + F.col("other")
    voted = F.coalesce(*[F.when(2 * F.col(k) > pages_of, F.lit(k))
                         for k in ("main", "furniture", "other")])
    # pages that differ in their longest and in their second text are no copies of each other
    differ = (F.col("longest") >= 3) & (F.col("second") >= 3)
    template = (differ & (F.col("least") == F.col("most"))
                | (F.col("pages") >= 3) & (2 * F.col("links") > pages_of))
    constant = (F.col("plain_least") == F.col("plain_most")) & (F.col("plain_pages") >= 3)
    kind = (F.when((voted == "main") & template, F.lit("furniture"))
            .when(F.coalesce(voted, F.lit("other")).eqNullSafe("other") & constant, F.lit("constant"))
            .when(F.greatest("main", "furniture", "other") < pages_of, voted))
    return (slot.select("host", "slot", "path", kind.alias("kind")).where("kind IS NOT NULL")
            .groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(
                F.struct("slot", "path", "kind")))).alias("decided")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per row of ``pages``."""
    spark = pages.sparkSession
    wrappers = infer(pages)
    rows_in = _pages(pages)
    size = wrappers.agg(F.coalesce(F.max(F.length("wrapper") + F.length("host")), F.lit(1))).first()[0]
    path = scratch_path(spark, "decided")
    decide(rows_in, broadcast_if_small(wrappers, size)).write.parquet(path)
    decided = spark.read.schema("host string, decided string").parquet(path)
    size += decided.agg(F.coalesce(F.max(F.length("decided")), F.lit(0))).first()[0]
    known = broadcast_if_small(wrappers.join(decided, "host", "left"), size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, HostPages] = {}
        for batch in chunks(batches, "html"):
            texts_out = []
            columns = [batch.column(i).to_pylist() for i in (2, 3, 4, 5)]
            for host, page, wrapper, decided in zip(*columns):
                if not page:
                    texts_out.append("")
                    continue
                if host not in hosts:
                    hosts[host] = HostPages(wrapper, decided)
                tokens, texts = page_tokens(page)
                _, kind = hosts[host].of(tokens)
                if "main" in kind:
                    kept = [t for t, k in zip(texts, kind) if k == "main"]
                else:
                    links = [t == "@" for t in tokens if t in ("#", "@")]
                    kept = [t for t, k, link in zip(texts, kind, links)
                            if k == "other" and not link]
                texts_out.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts_out, pa.string()),
                 pa.array([len(t) for t in texts_out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return (rows_in.join(known, "host", "left")
            .select("page_id", "url", "host", "html", "wrapper", "decided")
            .transform(in_arrow, rows, "page_id long, url string, text string, n_chars long"))
