import json
import random

import pytest
from pyspark.sql import functions as F

from scorelake.sources import json_splits, loaders

SCHEMA = "id string, n int, words array<string>, deep struct<a:array<array<double>>,b:map<string,string>>"
ODD = ["", "a,b", '"', '\\"', "\\", "\\\\", "[", "]}", "{,", "é中\U0001f600", "line\nfeed\t", ", \"annotations\": [", " ", "/", "x" * 300, '",', "\\,"]


def items(n, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(ODD) for _ in range(rng.randrange(4)))
    return [{"id": word(), "n": i, "words": [word() for _ in range(rng.randrange(5))], "deep": {"a": [[1.5, 2], []][: rng.randrange(3)], "b": {word(): word()}}, "other": {"annotations": [1, 2]}} for i in range(n)]


def text(data, rng=random.Random(1)):
    return json.dumps(data, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")]))


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(frame):
    return sorted(map(str, frame.collect()))


def whole(spark, path, kind):
    """The file as one row of one task."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("x"))


def test_lists(spark, tmp_path, small_ranges):
    for k in range(6):
        path = tmp_path / f"l{k}.json"
        path.write_text(("﻿" if k == 5 else "") + " \n" * (k % 2) + text(items(60, k)) + "\n" * (k % 3))
        got = loaders.read_json(spark, str(path), SCHEMA)
        assert rows(got) == rows(spark.read.option("multiLine", "true").schema(SCHEMA).json(str(path))) and got.count() == 60
        want = [(i, x["id"], x["words"]) for i, x in enumerate(items(60, k))]
        assert sorted(map(tuple, loaders.read_wrapped(spark, str(path), f"struct<{'id:string,words:array<string>'}>").collect())) == want


def test_a_file_is_read_by_several_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "many.json"
    path.write_text(text(items(200)))
    found = json_splits.split(spark, str(path), lists_under_keys=False)
    assert found.records.rdd.getNumPartitions() > 12 and len(found.places) > 12
    assert any(p.inside for p in found.places.values()) and len({p.depth for p in found.places.values()}) > 2
    # each range gives the same again, alone as well
    parts = json_splits._elements(found.records, found.base, found.places)
    again = [rows(parts.filter(F.col("start") == start)) for _, start in sorted(found.places)]
    assert sorted(x for own in again for x in own) == rows(parts) and parts.filter("NOT whole").count() > 10


@pytest.mark.parametrize("key", ["annotations", "data"])
def test_wrapped(spark, tmp_path, small_ranges, key):
    kind = "struct<id:string,n:int,words:array<string>>"
    path = tmp_path / "w.json"
    path.write_text(text({"x,\"annotations": [9, 9], "info": {"annotations": [0], "data": [[]]}, "empty": [], key: items(50), "last": [{"id": "no"}]}))
    got = loaders.read_wrapped(spark, str(path), kind)
    assert rows(got) == rows(whole(spark, str(path), f"struct<{key}:array<{kind}>>").select(F.posexplode(f"x.{key}").alias("pos", "item")).select("pos", "item.*")) and got.count() == 50
    path.write_text(json.dumps({"data": [{"id": "d"}], "annotations": [{"id": "a"}, None, {"id": "b"}]}))
    assert sorted(map(tuple, loaders.read_wrapped(spark, str(path), "struct<id:string>").collect()), key=str) == [(0, "a"), (1, None), (2, "b")]
    path.write_text(json.dumps({"annotations": [], "data": [{"id": "d"}]}))
    assert loaders.read_wrapped(spark, str(path), "struct<id:string>").count() == 0


def test_maps(spark, tmp_path, small_ranges):
    data = {f"{o} {i}": {"m": x["words"], "q": [x]} for i, (o, x) in enumerate(zip(ODD * 4, items(60), strict=False))}
    path = tmp_path / "m.json"
    path.write_text(text(data))
    kind = "struct<m:array<string>,q:array<struct<id:string,n:int>>>"
    got = loaders.read_map(spark, str(path), kind)
    assert rows(got) == rows(whole(spark, str(path), f"map<string,{kind}>").select(F.explode("x").alias("key", "value"))) and got.count() == len(data)
    path.write_text(json.dumps({"a": [1, 2], "b": [], "c": None}))
    assert rows(loaders.read_map(spark, str(path), "array<int>")) == rows(whole(spark, str(path), "map<string,array<int>>").select(F.explode("x").alias("key", "value")))


def test_odd_files(spark, tmp_path, small_ranges):
    path = tmp_path / "odd.json"
    for data in ("[]", "{}", " [ ] ", "[\n]", ""):
        path.write_text(data)
        assert loaders.read_map(spark, str(path), "string").count() == 0 and loaders.read_wrapped(spark, str(path), "struct<id:string>").count() == 0
    path.write_text('{"id": "one", "n": 3}')
    assert [(r.id, r.n) for r in loaders.read_json(spark, str(path), SCHEMA).collect()] == [("one", 3)]
    path.write_text('[{"id": "a"}, {"id": "b", "n": 1')  # broken off: what is whole is read
    assert ("a", None) in [(r.id, r.n) for r in loaders.read_json(spark, str(path), SCHEMA).collect()]


def test_several_files(spark, tmp_path, small_ranges):
    for k in range(3):
        (tmp_path / "folder").mkdir(exist_ok=True)
        (tmp_path / "folder" / f"a b{k}.json").write_text(text(items(30, k)))
    (tmp_path / "folder" / "single.json").write_text('{"id": "one"}')
    got = loaders.read_json(spark, str(tmp_path / "folder"), SCHEMA)
    assert got.count() == 91 and sorted(r.id for r in got.collect()) == sorted([x["id"] for k in range(3) for x in items(30, k)] + ["one"])
