import random
import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import corpus_pipeline as C
from citescope.llm import quality
from tests.llm import test_decontamination as D
from tests.llm import test_packing as K
from tests.llm import test_privacy as V
from tests.llm import test_quality as Q
from tests.llm import test_simhash as S

TABLES = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}


def write(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, TABLES["labels"]).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, TABLES["benchmark"]).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def corpus(spark, make_docs, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"plain{i}" for i in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(words(30))) for i in range(4)]
    docs = [(i, " ".join(words(120))) for i in range(40)]
    docs += [(100 + i, " ".join(w + "###%%%" for w in words(120))) for i in range(12)]     # junk
    docs += [(200 + i, docs[3][1]) for i in range(5)]                                      # copies
    docs += [(300 + i, " ".join(words(60)) + " " + items[i][1] + " " + " ".join(words(60)))
             for i in range(4)]                                                            # leaks
    docs += [(400, " ".join(words(60)) + " mail a.b@c.de from 10.1.2.3 " + " ".join(words(60))),
             (500, None), (501, ""), (502, "too short")]
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(100 + i, 0, 0) for i in range(6)]
    folder = str(tmp_path_factory.mktemp("corpus") / "sf")
    return write(spark, folder, make_docs(docs), labels, items), docs, items


def test_stages_against_brute_force(spark, corpus, tmp_out):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, texts = docs.columns, dict(rows)
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_out}/{k}")
        out = spark.read.parquet(f"{tmp_out}/{k}")
        before = texts
        if k == 0:
            texts = {i: t for i, t in before.items() if not Q.brute(t)[5] and "###" not in t}
        elif k == 1:
            ids = sorted(before)
            label = S.brute_components([S.brute_fingerprint(before[i]) for i in ids])
            texts = {i: before[i] for n, i in enumerate(ids) if label[n] == n}
        elif k == 2:
            leaked = {i for i, _ in D.brute(list(before.items()), items)}
            assert leaked == {300, 301, 302, 303}
            texts = {i: t for i, t in before.items() if i not in leaked}
        elif k == 3:
            texts = {}
            for i, t in before.items():
                for a, kind, b in reversed(V.brute(t)):
                    t = t[:a] + f"[{V.PATTERNS[kind][0].upper()}]" + t[b:]
                texts[i] = t
        else:
            assert K.check(out.collect(), list(before.items()), 2048) == -(-len(before) // 4)
            assert min(r.length for r in out.collect()) > 2048 // 5  # four fit, five do not
            break
        got = out.collect()
        assert out.columns == columns and {r.doc_id: r.text for r in got} == texts
        assert len(got) == len(texts) and all(r.n_chars == len(r.text) for r in got)
        docs = out
    assert set(texts) == {*range(40), 400}
    assert sorted(map(tuple, C.run(spark, folder).select("doc_id", "piece", "length").collect())) == sorted(
        map(tuple, out.select("doc_id", "piece", "length").collect()))


def broadcasts(plan):
    """The part of a plan below each of its broadcasts."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:+*()\d-]*", x)[0]) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            last = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:last])


def test_rows_made_by_explode_are_not_broadcast(spark, corpus, monkeypatch):
    """The planner takes them for as few as their source has, the driver has to hold them all."""
    plans, write_parquet = [], DataFrameWriter.parquet

    def recorded(self, *args, **options):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write_parquet(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", recorded)
    out = C.run(spark, corpus[0])
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("Generate" in x for x in plans) and any(list(broadcasts(x)) for x in plans)
    assert not [x for plan in plans for x in broadcasts(plan) if "Generate" in x]


def test_empty_tables(spark, make_docs, tmp_out):
    folder = write(spark, f"{tmp_out}/sf", make_docs([]), [], [])
    assert C.run(spark, folder).collect() == []


def test_stage_names_and_registration(spark):
    import __spark_entry__ as E
    from citescope.llm.queries import queries

    assert [n for n, _ in C.STAGES] == ["quality rules", "SimHash near-dedup",
                                        "benchmark decontamination", "PII", "best-fit packing"]
    found = E.queries()
    assert found["pipeline"] is C.run and "pipeline" not in E.oracle_sql()
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries())
    assert numbers == list(range(1, 14)) and set(queries()) <= set(found)
    assert quality.MIN_WORDS == 50
