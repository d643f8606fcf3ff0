import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citescope.llm import wrappers as W


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows],
                                 "page_id long, url string, html string, wrapper string, "
                                 "host string, text string")


def shape(items):
    return [[shape(w) if isinstance(w, list) else w, o] for w, o in items]


def test_tokens_slots_and_texts():
    tokens, texts = W.page_tokens(
        "<!DOCTYPE html><!-- c <p>no</p> --><title>T</title><script>if (a<b) '<p>'</script>"
        "<div class='x sidebar'>a &amp; b <b>c</b>d<br>e</div><p>one\n two<p>three"
        "<ul><li><a href=\"/x>y\">link</a><li>5 < 6</ul><style>p{}</style>&lt;p&gt; &nbsp; end")
    assert texts == ["a & b cd e", "one two", "three", "link", "5 < 6", "<p> end"]
    assert tokens == ["!<div>", "#", "</div>", "<p>", "#", "<p>", "#", "<ul>", "<li>", "@",
                      "<li>", "#", "</ul>", "#"]


def test_fold_repeats():
    assert W.fold(list("abab") + ["c"]) == [[[["a", 0], ["b", 0]], 0], ["c", 0]]
    assert W.fold(list("aaa")) == [[[["a", 0]], 0]]
    nested = W.fold("u l a l a v u l a v".split())
    assert nested[0][0] == "u" and any(isinstance(w, list) for w, _ in nested)
    assert W.fold([]) == []


def test_align_makes_optional_and_repeated_groups():
    one = W.fold(["<div>", "<p>", "#", "<p>", "#", "</div>"])
    two = W.fold(["<div>", "<h1>", "#", "</h1>", "<p>", "#", "</div>", "<footer>"])
    assert shape(W.align(one, two)) == [
        ["<div>", 0], ["<h1>", 1], ["#", 1], ["</h1>", 1], [[["<p>", 0], ["#", 0]], 0],
        ["</div>", 0], ["<footer>", 1]]
    inner = W.align(W.fold("l a # z l a # z".split()), W.fold("l # z l # z".split()))
    assert shape(inner) == [[[["l", 0], ["a", 1], ["#", 0], ["z", 0]], 0]]


TOKENS = st.lists(st.sampled_from(["<div>", "</div>", "<p>", "#", "@", "<li>", "*<main>",
                                   "</main>", "!<nav>", "</nav>"]), max_size=24)


@settings(max_examples=300, deadline=None)
@given(TOKENS, TOKENS)
def test_every_text_gets_one_slot_number(a, b):
    wrapper = W.align(W.fold(a), W.fold(b))
    for tokens in (a, b):
        numbers = W.slot_numbers(wrapper, tokens)
        assert len(numbers) == sum(t in ("#", "@") for t in tokens)
        known = [t for _, t in W.slots(wrapper) if t in ("#", "@")]
        assert all(-1 <= n < len(known) for n in numbers)
    number, kind = W.HostPages(json.dumps(wrapper)).of(a)
    assert kind == W.kinds([[t, 0] for t in a])


@pytest.mark.parametrize("cells", [1 << 22, 0])
def test_matches_are_common_subsequences(monkeypatch, cells):
    monkeypatch.setattr(W, "CELLS", cells)
    a, b = W.fold(list("axbyc")), W.fold(list("abzyc"))
    pairs = W.matches(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
    assert len(pairs) == 4


PAGE = """<html><head><title>t</title></head><body><header><a href=/>Home</a> site</header>
<nav><ul>{nav}</ul></nav><div class="cookie-notice">We use cookies</div>
<aside>side {i}</aside><article><h1>Title {i}</h1>{body}</article>
<section id="comments"><p>comment {i}</section><form>mail <input></form>
<footer>foot</footer></body></html>"""


def test_article_without_furniture(spark):
    rows = []
    for i in range(12):
        nav = "".join(f"<li><a href=/{k}>n{k}</a></li>" for k in range(i % 4 + 1))
        body = "".join(f"<p>par {i} {k}&eacute;</p>" for k in range(i % 3)) + (
            "<div class=ad>buy</div><ul><li>x<li>y</ul>" if i % 2 else "")
        rows.append((i, f"http://h{i % 2}.org/{i}", PAGE.format(i=i, nav=nav, body=body)))
    got = {r.page_id: r for r in W.extract(frame(spark, rows).repartition(3)).collect()}
    for i, url, _ in rows:
        want = [f"Title {i}"] + [f"par {i} {k}é" for k in range(i % 3)] + (
            ["x", "y"] if i % 2 else [])
        assert got[i].text == "\n".join(want) and got[i].n_chars == len(got[i].text)
        assert got[i].url == url


def test_pages_without_main_region_drop_constant_and_link_slots(spark):
    rows = [(i, "http://plain.org/", f"<body><div>Site name</div><div><a href=/>all {i}</a></div>"
                f"<div>Text {i}</div><p>More {i}</p></body>") for i in range(6)]
    rows.append((9, "http://single.org/", "<p>Only page</p>"))
    got = {r.page_id: r.text for r in W.extract(frame(spark, rows)).collect()}
    assert all(got[i] == f"Text {i}\nMore {i}" for i in range(6)) and got[9] == "Only page"


def test_odd_rows(spark):
    long = "<article>" + "".join(f"<p>part {i}</p><hr>" for i in range(20_000)) + "</article>"
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://a/", "<"), (4, None, "plain text"),
            (4, None, "plain text"), (None, "http://b/", "<article>x"),
            (6, "http://b/", "<article><p>unclosed <b>bold<p>next<nav>menu"), (7, "http://c/", long),
            (8, "http://d/", "<a href='x" * 50)]
    got = W.extract(frame(spark, rows)).collect()
    texts = {}
    for r in got:
        texts.setdefault(r.page_id, []).append(r.text)
    assert texts[1] == [""] and texts[2] == [""] and texts[3] == ["<"]
    assert texts[4] == ["plain text"] * 2 and texts[None] == ["x"]
    assert texts[6] == ["unclosed bold\nnext"] and texts[7][0].count("\n") == 19_999
    assert W.extract(frame(spark, [])).collect() == []


def test_salted_parts_merge_to_one_wrapper_per_host(spark):
    rows = [(i, "http://hot.org/", "<article>" + "".join(
        f"<{t}>x</{t}>" for t, bit in (("h2", 1), ("p", 2), ("table", 4), ("pre", 8)) if i & bit)
        + "</article>") for i in range(64)]
    wrappers = W.infer(frame(spark, rows).repartition(5)).collect()
    assert [r.host for r in wrappers] == ["hot.org"]
    assert all(W.slot_numbers(json.loads(wrappers[0].wrapper), W.page_tokens(h)[0]) is not None
               for _, _, h in rows)


def test_the_host_decides_a_slot_against_a_page_s_own_containers(spark):
    def page(i, share="<div class=share>"):
        return (f"<body><article><h1>Title {i}</h1>{share}Send {i}</div><section>Read more below</section>"
                f"<p>Body {i} of the page</p><ul><li><a href=/{i}>see {i}</a><li><a href=/x{i}>and {i}</a>"
                f"</ul></article></body>")

    rows = [(i, "http://h.org/", page(i, "<div>" if i == 3 else "<div class=share>"))
            for i in range(8)]
    rows += [(20, "http://one.org/", page(20, "<div>"))]  # nothing but its own containers
    got = {r.page_id: r.text for r in W.extract(frame(spark, rows).repartition(3)).collect()}
    # page 3 has no class that tells, 'Read more below' and the link list are in every article
    assert all(got[i] == f"Title {i}\nBody {i} of the page" for i in range(8))
    assert got[20] == "Title 20\nSend 20\nRead more below\nBody 20 of the page\nsee 20\nand 20"


def test_near_copies_and_other_paths_decide_nothing(spark):
    rows = [(i, "http://copies.org/", "<article><h1>Same title</h1><p>The same long text of all "
             f"copies</p><p>and a second one</p><p>no. {i}</p></article>") for i in range(6)]
    rows += [(10 + i, "http://mixed.org/", f"<article><p>Text {i}</article>") for i in range(8)]
    rows += [(30, "http://mixed.org/", "<nav><p>menu</nav><div>Only <b>plain</b></div>")]
    got = {r.page_id: r.text for r in W.extract(frame(spark, rows)).collect()}
    assert got[2] == "Same title\nThe same long text of all copies\nand a second one\nno. 2"
    assert got[11] == "Text 1" and got[30] == "Only plain"


def test_constant_texts_of_a_host_that_has_a_main_region_elsewhere(spark):
    rows = [(i, "http://mixed.org/", f"<body><section>Site name</section><div>Text {i}</div><p>More {i}</p></body>")
            for i in range(6)]
    rows.append((9, "http://mixed.org/", "<body><article><p>Main text</p></article></body>"))
    got = {r.page_id: r.text for r in W.extract(frame(spark, rows)).collect()}
    assert all(got[i] == f"Text {i}\nMore {i}" for i in range(6)) and got[9] == "Main text"


def test_headers_and_labels_of_the_text_itself(spark):
    rows = [(i, "http://h.org/", f"<body class='has-sidebar'><header><p>Visit {i}</p></header>"
             f"<p>Body {i}</p></body>") for i in range(4)]
    rows += [(10 + i, "http://g.org/", f"<article class='post-share-ready'><header><h1>Title {i}</h1></header>"
              f"<p>Text {i}</p><div class='share'>Send {i}</div></article>") for i in range(4)]
    got = {r.page_id: r.text for r in W.extract(frame(spark, rows)).collect()}
    assert got == {**{i: f"Body {i}" for i in range(4)}, **{10 + i: f"Title {i}\nText {i}" for i in range(4)}}
