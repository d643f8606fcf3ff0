"""Splittable JSON arrays: the same elements however the files are split."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from citescope.sources import article_lists as AL
from citescope.sources import json_arrays as J


@pytest.fixture(params=[7, 40, 300, 1 << 26])
def split_bytes(spark, request):
    """Splits of so many bytes; the smallest cut strings, escapes and characters apart."""
    conf = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return "".join(rng.choice('ab,"\\[]{}é\n:😀 ') for _ in range(rng.randint(0, 12)))
    if kind == 1:
        return rng.choice([None, True, 3, -1.5])
    if kind < 4:
        return rng.choice(["A", "B,C", 'say "x"', "\\", "[", "}"])
    if kind < 6:
        return {rng.choice(["title", "x", 'a"b']): random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


def test_elements_of_random_arrays(spark, tmp_out, split_bytes):
    rng = random.Random(split_bytes)
    arrays = {f"{i}.json": [random_value(rng) for _ in range(rng.randint(0, 12))] for i in range(8)}
    for i, (name, array) in enumerate(arrays.items()):
        write(os.path.join(tmp_out, name), json.dumps(array, indent=[None, 2][i % 2], ensure_ascii=i % 3 == 0))
    got = J.read_arrays(spark, tmp_out).select(
        F.element_at(F.split("source", "/"), -1).alias("name"), "element",
        F.to_json("value").alias("json")).collect()
    want = {(name, i): x for name, array in arrays.items() for i, x in enumerate(array)}
    assert {(r.name, r.element): json.loads(r.json) for r in got} == want and len(got) == len(want)


def test_what_is_no_array_gives_no_rows(spark, tmp_out, split_bytes):
    texts = ["{}", "no", "", "[1", "[1,]", "[1] x", "[1],[2]", '{"a": [1, 2]}', "[1, 2}", '"[1]"', "[1 2]",
             '["a, "b"]', "[,]"]
    for i, text in enumerate(texts):
        write(os.path.join(tmp_out, f"bad{i}.json"), text)
    for name, text in (("ok1.json", " \n[ 1 ,\n 2 ] \n"), ("ok2.json", "[]"), ("ok3.json", "[\n]"), ("ok4.json", "[[]]")):
        write(os.path.join(tmp_out, name), text)
    got = J.read_arrays(spark, tmp_out).select("source", "element", F.to_json("value").alias("v")).collect()
    assert sorted((os.path.basename(r.source), r.element, r.v) for r in got) == [
        ("ok1.json", 0, "1"), ("ok1.json", 1, "2"), ("ok4.json", 0, "[]")]


def test_titles_have_dense_positions(spark, tmp_out, split_bytes, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 4)
    rng = random.Random(1)
    items = [rng.choice([{"title": f"T{i}"}, f"S{i}", 3, {"title": None}, {"x": 1}, None]) for i in range(60)]
    path = write(os.path.join(tmp_out, "list.json"), json.dumps(items))
    want = [x["title"] if isinstance(x, dict) else x for x in items
            if isinstance(x, str) or isinstance(x, dict) and x.get("title")]
    rows = AL.read_article_list(spark, path).orderBy("article_pos").collect()
    assert [(r.article_pos, r.title) for r in rows] == list(enumerate(want))
    assert [r.title for r in AL.read_article_list(spark, path, limit=5).orderBy("article_pos").collect()] == want[:5]


def test_written_parts_are_one_array(spark, tmp_out):
    rng = random.Random(2)
    rows = [(rng.randrange(50), f'T{rng.randrange(9)}, "é"\n', "t", "u") for _ in range(200)]
    records = spark.createDataFrame(rows, "pos int, title string, display_text string, url string")
    path = os.path.join(tmp_out, "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        AL.write_popular_records(records.repartition(5), path, order=["pos"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    whole = json.loads("".join(open(os.path.join(path, f), encoding="utf-8").read() for f in parts))
    want = sorted(rows)
    assert [x["title"] for x in whole] == [r[1] for r in want] and len(parts) > 1
    back = AL.read_article_list(spark, path).orderBy("article_pos").collect()
    assert [r.title for r in back] == [r[1] for r in want]
    empty = os.path.join(tmp_out, "none")
    AL.write_popular_records(records.limit(0), empty, order=["pos"])
    assert AL.read_article_list(spark, empty).collect() == []
    AL.write_popular_records(records.limit(1), os.path.join(tmp_out, "one"), order=["pos"])
    assert AL.read_popular_records(spark, os.path.join(tmp_out, "one")).count() == 1


def test_one_list_is_read_by_many_tasks(spark, tmp_out):
    path = write(os.path.join(tmp_out, "big.json"), json.dumps([{"title": f"T{i}", "n": [i, i]} for i in range(30_000)]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert J._pieces(spark, path).select("start").distinct().count() > 10
        rows = AL.read_article_list(spark, path)
        assert rows.count() == 30_000
        assert rows.where(F.col("title") != F.concat(F.lit("T"), "article_pos")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
