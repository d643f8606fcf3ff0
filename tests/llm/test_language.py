import numpy as np

from citescope.llm import language as L

WORDS = {"aa": "tion ing the and ment", "bb": "schau keit und die verb", "cc": "çion eaux que les é"}


def training(n=40):
    return [(i, " ".join(WORDS[x].split()[(i + k) % 5] for k in range(30)), x)
            for x in WORDS for i in range(n)]


def model(make_docs, extra=()):
    return L.fit(make_docs([*training(), *extra]).select("text", "lang"))


def test_pure_mixed_and_letterless_texts(make_docs):
    fitted = model(make_docs, [(1, "some text", None), (2, None, "aa")])
    assert fitted.languages == ["aa", "bb", "cc"]
    texts = [t.encode() for t in ("the and tion the ing and", "und die keit schau und",
                                  "the and tion ing " * 6 + "und die keit schau " * 4,
                                  "", "123 ... ###", "é")]
    pred, share, sets = fitted.predict(texts)
    assert pred == ["aa", "bb", "aa", "und", "und", "cc"]
    assert share[3] == share[4] == 0 and 0.45 < share[2] < 0.75
    assert [len(s.split(",")) for s in sets[:3]] == [1, 1, 2] and sets[3] == ""


def test_mixture_equals_a_plain_em(make_docs):
    fitted = model(make_docs)
    text = b"the and tion ing the " * 3 + b"und die keit schau " * 2
    doc, bucket, count, _ = L.trigram_counts([text])
    pi = np.full(3, 1 / 3)
    for _ in range(L.STEPS):
        joint = pi[:, None] * fitted.probability[:, bucket]
        pi = (joint / joint.sum(axis=0) * count).sum(axis=1) / count.sum()
    order = np.argsort(-pi)
    two = np.zeros(3)
    two[order[:2]] = 0.5
    for _ in range(L.STEPS):
        joint = two[:, None] * fitted.probability[:, bucket]
        two = (joint / joint.sum(axis=0) * count).sum(axis=1) / count.sum()
    pred, share, _ = fitted.predict([b"x y", text, b"die und"])
    assert pred[1] == fitted.languages[order[0]] and abs(share[1] - two[order[0]]) < 1e-5


def test_trigram_counts_equal_a_plain_count():
    texts = ["Ab c", "", "é-é!", "  x\0y ", "12"]
    doc, bucket, count, has = L.trigram_counts([t.encode() for t in texts])
    assert has.tolist() == [True, False, True, True, False]

    def total(text):
        runs, last = [], " "
        for ch in text.lower():
            ch = ch if ch.isalpha() else " "
            if ch != " " or last != " ":
                runs.append(ch)
            last = ch
        padded = " " + "".join(runs).strip() + " "
        return sum(padded[i + 1] != " " or (padded[i] != " " and padded[i + 2] != " ")
                   for i in range(len(padded) - 2))

    sums = np.bincount(doc, weights=count, minlength=len(texts))
    assert sums.tolist() == [total(t) for t in texts]


def test_odd_rows_and_row_groups(make_docs, odd_rows):
    fitted = model(make_docs)
    got = L.predict(make_docs(odd_rows).coalesce(1), fitted).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 7))
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (4, 5)}) == 1


def test_no_training_rows_and_empty_table(make_docs):
    nothing = L.fit(make_docs([]).select("text", "lang"))
    assert [r.lang_pred for r in L.predict(make_docs([(1, "abc")]), nothing).collect()] == ["und"]
    assert L.predict(make_docs([]), model(make_docs)).collect() == []


def test_held_out_accuracy(spark):
    import citescope.llm.queries as Qs

    sf = "/root/testdata/sf0.001"
    rows = Qs.op4_language(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "lang")
    held = rows.join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    right = held.where("lang = lang_pred").count()
    assert right >= 0.9 * held.count() > 0
    assert rows.where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_a_text_of_four_languages_gets_all_four():
    import numpy as np

    from citescope.llm import language as L

    texts = [" ".join(f"{a}{b}{a}{c}" for b in letters for c in letters for a in letters)
             for letters in ("abcd", "efgh", "ijkl", "mnop")]
    counts = np.full((4, L.BUCKETS), 0.01)
    for i, text in enumerate(texts):
        _, bucket, n, _ = L.trigram_counts([text.encode()])
        counts[i, bucket] += n
    model = L.LanguageModel(list("wxyz"), counts / counts.sum(axis=1, keepdims=True))
    pred, share, sets = model.predict([" ".join(texts).encode(), texts[2].encode()])
    assert sorted(x.split(":")[0] for x in sets[0].split(",")) == list("wxyz")
    assert share[0] < 0.3 and pred[1] == "y" and sets[1] == "y:1.000"
