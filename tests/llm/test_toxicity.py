import numpy as np

from citescope.llm import toxicity as T


def grades(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, grade int")


def corpus(n=300):
    docs, known = [], []
    for i in range(n):
        words = [f"plain{(i * 13 + k * 7) % 97}" for k in range(30)]
        grade = (i % 10 == 0) + (i % 20 == 0)
        words[3:3 + 2 * grade] = ["slur", "Vileness,"] * grade
        if grade == 2:
            words[10] = "horrible!"
        docs.append((i, " ".join(words)))
        known.append((i, grade))
    return docs, known


def test_severity_follows_grades_on_unseen_texts(spark, make_docs):
    docs, known = corpus()
    model = T.fit(make_docs(docs), grades(spark, known[:200]))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in T.score(make_docs(docs), model).collect()}
    for i, grade in known[200:]:
        assert got[i].toxic == (grade > 0)
    mean = [np.mean([got[i].severity for i, g in known if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    for r in got.values():
        assert 0 <= r.p_toxic <= 1 and 0 <= r.severity <= 2 and r.grade in (0, 1, 2)


def test_fit_reaches_the_stationary_point():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(200)]
    y = np.array([min(2, int(0 in r) + int(1 in r and rng.random() < 0.8)) for r in rows])
    w, theta = T.fit_cumulative_link(rows, y, 6, l2=0.5, steps=5000)

    def loss(w, theta):
        z = np.array([w[r].sum() for r in rows])
        cum = np.concatenate([np.zeros((len(rows), 1)),
                              1 / (1 + np.exp(-(theta[None] - z[:, None]))),
                              np.ones((len(rows), 1))], axis=1)
        return -np.log(cum[np.arange(len(y)), y + 1] - cum[np.arange(len(y)), y]).sum() + (
            0.25 * (w ** 2).sum())

    base = loss(w, theta)
    for k in range(6):
        for step in (-1e-2, 1e-2):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, theta) >= base - 1e-6
    for k in range(2):
        for step in (-1e-2, 1e-2):
            moved = theta.copy()
            moved[k] += step
            assert loss(w, moved) >= base - 1e-6
    assert w[0] > 0.5 and w[1] > 0.5 and theta[0] < theta[1]


def test_features_are_words_and_repeated_prefixes():
    words = {f for w in (b"abc", b"abd") for f in T.features_of_word(w)}
    assert len(words) == 4  # two words, two prefixes of three letters
    found = T.present(b"Abcx. abcy, (abcx)", {})
    codes = [T.features_of_word(w) for w in (b"abcx", b"abcy")]
    assert codes[0][0] in found and codes[1][0] in found and codes[0][1] in found
    assert codes[0][1] + 1 not in found
    assert codes[0][1] + 1 in T.present(b"abcx abcy abcx abcz", {})
    assert T.present(b"?! ...", {}) == []


def test_odd_rows_labels_and_sample_bound(spark, make_docs, odd_rows):
    docs, known = corpus(100)
    rows = docs + [(1000 + i if i is not None else None, t)
                   for i, t in odd_rows]
    labels = grades(spark, known + [(None, 1), (1, None), (10, 0), (10, 2), (77_777, 1)])
    model = T.fit(make_docs(rows), labels, max_labelled=60)
    got = T.score(make_docs(rows), model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    again = {(r.doc_id, r.severity) for r in got if r.doc_id in (1004, 1005)}
    assert len({s for _, s in again}) == 1
    same = T.fit(make_docs(rows).repartition(5), labels, max_labelled=60)
    assert np.array_equal(model.features, same.features)
    assert np.allclose(model.weights, same.weights)


def test_without_two_grades_everything_is_clean(spark, make_docs):
    docs, _ = corpus(10)
    for known in ([], [(1, 0), (2, 0)]):
        model = T.fit(make_docs(docs), grades(spark, known))
        assert {(r.severity, r.toxic) for r in T.score(make_docs(docs), model).collect()} == {
            (0.0, False)}
    assert T.score(make_docs([]), model).collect() == []


def test_held_out_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = "crc32(cast(doc_id as string)) % 4 = 1"
    model = T.fit(docs, T.grades_of_labels(labels.where(f"NOT {held}")))
    got = T.score(docs, model).join(labels.where(held).select("doc_id", "toxic")
                                    .withColumnRenamed("toxic", "label"), "doc_id")
    clean = got.where("label = 0")
    assert clean.where("toxic").count() <= 0.05 * clean.count()
    assert got.where("label = 1 AND toxic").count() >= 0.4 * got.where("label = 1").count() > 0
