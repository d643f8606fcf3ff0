import hashlib
import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citescope.llm import privacy as P

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
            "card": 14 <= len(digits) <= 19 and luhn(digits),
            "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS)
             for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)


CASES = ["a@b.c, x.y+z@d-e.f.g. a@b@c.d a@b a@b.c_x@y.z", "1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8 1..2.3.4.5",
         "4111 1111 1111 1111 4111-1111-1111-1112 79927398713 4111111111111111", "+1 (017) 555-7713 +1 (2 +12345678901234567 ++1234567890.",
         "日é a@b.com é 10.0.0.1", "x" * 50 + "@" + "y" * 50 + ".zz", "1" * 3000, "1 " * 3000, "+1" * 500, "a." * 2000 + "@b",
         "00000000000000 0.0.0.0", "", "4111 1111 1111 1111@b.com +1.2.3.4"]


def test_base_spans_against_python(make_docs):
    rows = list(enumerate(CASES)) + [(100, None)]
    got = {r.doc_id: r for r in P.find(make_docs(rows)).collect()}
    for i, text in rows:
        spans = brute(text)
        counts = [sum(k == n for _, k, _ in spans) for n in range(4)]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, (i, text)
        assert r.base == joined(spans) and r.spans == joined(spans)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("a1.@+-_ ()4é\n", max_size=60), min_size=30, max_size=30))
def test_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.s for r in df.select("i", P.base_spans(F.col("text")).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert [(x.start, x.kind, x.end) for x in got[i]] == brute(text)


def disclosure_rows():
    rows = []
    for i in range(8):  # 'hotline' stands next to phones only; 'the' everywhere
        rows.append((i, f"please call hotline +1 (555) 010-{1000 + i} the office and write the text"))
    rows += [(50 + i, "the text of the page and the office") for i in range(40)]
    rows += [(100 + i, "only copy secretword +1 (555) 999-0000 end") for i in range(10)]  # copies
    return rows


def test_disclosing_terms_are_added_next_to_entities(make_docs):
    rows = disclosure_rows()
    got = {r.doc_id: r for r in P.find(make_docs(rows)).collect()}
    for i, text in rows:
        names = [x.split(":") for x in got[i].spans.split(",") if x]
        added = {text[int(a):int(b)] for kind, a, b in names if kind.endswith("_term")}
        assert added == ({"please", "call", "hotline"} if i < 8 else set()), (i, added)
        assert got[i].base == joined(brute(text))


def test_disclosure_equals_its_definition(make_docs):
    docs = make_docs(disclosure_rows())
    near = P.contexts(docs)
    texts = [t for _, t in disclosure_rows()]
    words = [w for t in texts for w in re.findall(r"[^\W\d_]+", t)]
    found = set()
    for term in set(words):
        joint, entities = 0, set()
        for t in texts:
            spans = brute(t)
            places = set()
            for a, _, b in spans:
                left = [m for m in re.finditer(r"[^\W\d_]+", t[:a])][-P.WINDOW:]
                right = [m for m in re.finditer(r"[^\W\d_]+", t[b:])][:P.WINDOW]
                hits = [m.start() for m in left if m[0] == term] + [
                    b + m.start() for m in right if m[0] == term]
                places.update(hits)
                entities.update([t[a:b]] * bool(hits))
            joint += len(places)
        if len(entities) >= P.MIN_ENTITIES:
            all_joint = near.select("kind", "term", "doc_id", "mark", "term_start").distinct().count()
            value = 1 - math.log(joint / words.count(term)) / math.log(all_joint / len(words))
            if value >= P.THRESHOLD:
                found.add(term)
    assert {r.term for r in P.disclosing(docs, near).collect()} == found != set()


def test_odd_rows_and_sanitised_texts(make_docs, odd_rows):
    rows = odd_rows + [(40, "mail a.b@c.de, card 4111 1111 1111 1111!"), (40, "x 1.2.3.4"),
                       (41, "4111 1111 1111 1111@b.com")] + [
        (1000 + i, t) for i, t in disclosure_rows()]
    docs = make_docs(rows)
    assert P.find(docs).count() == len(rows)
    clean = P.sanitise(docs)
    assert clean.schema.names == docs.schema.names
    assert [f.dataType for f in clean.schema] == [f.dataType for f in docs.schema]
    got = sorted(((str(r.doc_id), r.text, r.n_chars) for r in clean.collect()), key=str)
    texts: dict = {}
    for i, t, n in got:
        assert n == (len(t) if t is not None else None)
        texts.setdefault(i, []).append(t)
    assert sorted(texts["40"]) == ["mail [EMAIL], card [CARD]!", "x [IP]"]
    assert texts["41"] == ["[CARD]"] and texts["1"] == [None] and texts["2"] == [""]
    assert texts["1000"] == ["   [PHONE] the office and write the text"]
    assert len(got) == len(rows)


def test_very_many_matches(make_docs):
    text = " ".join(f"u{i}@h{i % 7}.org +1 (555) 010-{1000 + i % 9000}" for i in range(3000))
    r = P.find(make_docs([(1, text)])).first()
    assert r.base == joined(brute(text)) and (r.n_email, r.n_phone) == (3000, 3000)


def test_empty_table(make_docs):
    assert P.find(make_docs([])).collect() == [] and P.sanitise(make_docs([])).collect() == []


def test_no_python_in_the_plan(make_docs):
    for df in (P.find(make_docs(disclosure_rows()[:3])), P.sanitise(make_docs([(1, "a")]))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_query_digest(spark):
    from citescope.llm.queries import op9_privacy

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_privacy(spark, sf).collect():
        base = joined(brute(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


@pytest.mark.parametrize("value, good", [("4111111111111111", True), ("4111111111111112", False),
                                         ("4" * 13, False), ("0" * 19, True), ("0" * 20, False)])
def test_card_check(spark, value, good):
    assert spark.range(1).select(P.VALID["card"](F.lit(value))).first()[0] is good


def added_words(row, text):
    return [text[int(a):int(b)] for kind, a, b in (x.split(":") for x in row.spans.split(",") if x)
            if kind.endswith("_term")]


def test_a_term_that_discloses_one_entity_is_added(make_docs):
    rows = [(i, f"page {'abcd'[i]} by Zoltan a.b@c.de on {'wxyz'[i]}") for i in range(4)]
    rows += [(20 + i, f"the page by nobody on {'klmnopqrst'[i]} day") for i in range(10)]
    rows += [(40 + i, "copy of Onlyonce x@y.org") for i in range(6)]  # one text
    got = {r.doc_id: r for r in P.find(make_docs(rows)).collect()}
    for i, text in rows:
        assert added_words(got[i], text) == (["Zoltan"] if i < 4 else []), text


def test_every_occurrence_of_a_disclosing_term_goes(make_docs):
    rows = disclosure_rows() + [(200, "HOTLINE? " + "- " * 60 + "a page about the Hotline"),
                                (201, "no entity but hotline")]
    got = {r.doc_id: r.text for r in P.sanitise(make_docs(rows), threshold=0.5).collect()}
    assert "hotline" not in " ".join(got.values()).lower()
    found = {r.doc_id: r for r in P.find(make_docs(rows), threshold=0.5).collect()}
    assert [w for w in added_words(found[200], rows[-2][1]) if w.lower() == "hotline"] == [
        "HOTLINE", "Hotline"]


def test_contexts_have_no_character_bound(make_docs):
    text = "éone two three four" + " 1" * 200 + " a@b.co" + "." * 300 + "é five 10.0.0.1 six é"
    near = P.contexts(make_docs([(1, text)])).collect()
    for k, value in ((0, "a@b.co"), (1, "10.0.0.1")):
        a = text.index(value)
        want = [m[0] for m in re.finditer(r"[^\W\d_]+", text[:a])][-P.WINDOW:] + [
            m[0] for m in re.finditer(r"[^\W\d_]+", text[a + len(value):])][:P.WINDOW]
        assert [r.term for r in near if r.kind == k] == want


def test_near_copies_are_no_second_context(make_docs):
    rows = [(1, "please from Marlow write before a@b.org friday at noon today"),
            (2, "please from Marlow write before a@b.org friday at noon tomorrow")]
    rows += [(10 + i, f"some plain text number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} "
                      f"about nothing at all {'uvwxyz'[i % 6]}") for i in range(200)]
    for r in P.find(make_docs(rows)).collect():
        assert "_term" not in r.spans


def test_texts_and_occurrences_of_terms(spark, make_docs):
    """Copies of a text are one text; every occurrence counts."""
    rng = random.Random(3)
    words = ["Ab", "ab", "cd", "Ef", "gh", "zz"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(25)]
    rows = [(rng.choice([None, i]), rng.choice(texts)) for i in range(150)]
    known = spark.createDataFrame([("ab",), ("cd",), ("ef",), ("nowhere",)], "term string")
    got = {r.term: (r.n, r.texts) for r in P._counted(make_docs(rows), known).collect()}
    lowered = [t.lower().split() for _, t in rows]
    assert got == {t: (sum(w.count(t) for w in lowered),
                       len({x for x in texts if any(x == y for _, y in rows) and t in x.lower().split()}))
                   for t in ("ab", "cd", "ef")}


def test_planted_terms_are_found_and_no_others(make_docs):
    """Recall and precision on a corpus with planted names: each name stands by one e-mail in
    several texts of its own wording; common words stand by many."""
    rng = random.Random(21)
    common = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 6))) for _ in range(60)]
    names = [f"Name{''.join(rng.choices('bcdfgkmpvz', k=6))}" for _ in range(12)]
    rows = []
    for i, name in enumerate(names):
        for _ in range(rng.randint(3, 6)):
            a, b = (" ".join(rng.choices(common, k=rng.randint(3, 8))) for _ in range(2))
            rows.append((len(rows), f"{a} {name} u{i}@mail.org {b}"))
    for _ in range(40):
        a, b = (" ".join(rng.choices(common, k=rng.randint(3, 8))) for _ in range(2))
        rows.append((len(rows), f"{a} x{len(rows)}@mail.org {b}"))
    for _ in range(600):
        rows.append((len(rows), " ".join(rng.choices(common, k=rng.randint(5, 25)))))
    rows += [(len(rows) + i, rows[3][1]) for i in range(30)]  # exact copies
    added = {w for r in P.find(make_docs(rows)).collect() for w in added_words(r, dict(rows)[r.doc_id])}
    assert len(added & set(names)) / len(names) >= 0.9  # recall
    assert len(added & set(names)) / len(added) >= 0.9  # precision
