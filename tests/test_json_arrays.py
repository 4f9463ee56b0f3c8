"""JSON arrays by byte ranges against a plain parser, however the files are cut."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallywright.functions import similarity
from tallywright.sources import files, json_arrays

NASTY = ['"', "\\", '\\"', ",", "],[", "}{", '","', "é,", "漢", "\n", "[[", "\\\\", "", " ", "🙂"]


def value(rnd, depth=0):
    kind = rnd.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return "".join(rnd.choice(NASTY) for _ in range(rnd.randrange(8)))
    if kind == 2:
        return rnd.randrange(-1000, 1000) / 4
    if kind == 3:
        return rnd.choice([None, True, False, [], {}])
    if kind == 4:
        return [value(rnd, depth + 1) for _ in range(rnd.randrange(5))]
    return {f"k{i}{rnd.choice(NASTY)}": value(rnd, depth + 1) for i in range(rnd.randrange(4))}


@pytest.fixture
def cut_small(spark, request):
    """Ranges of a given number of bytes."""
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    for c, v in old.items():
        spark.conf.set(c, v)


def read(spark, path):
    return {(r["file"].rsplit("/", 1)[1], r["place"]): r["raw"] for r in json_arrays.elements(spark, str(path)).collect()}


@pytest.mark.parametrize("cut_small", [97, 1024, 1 << 27], indirect=True)
def test_equal_to_a_parser(spark, tmp_path, cut_small):
    rnd = random.Random(3)
    wanted = {}
    for name, indent, plain in (("a.json", None, False), ("b.json", 1, True), ("c.json", 2, False)):
        rows = [value(rnd) for _ in range(60)]
        # One element that spans many ranges, and white space and a byte order mark around the array.
        rows.insert(20, {"long": ["x,]" * 200, "y" * 3000]})
        (tmp_path / name).write_bytes(("﻿ \n" + json.dumps(rows, indent=indent, ensure_ascii=plain) + " \n").encode())
        wanted |= {(name, i): row for i, row in enumerate(rows)}
    (tmp_path / "none.json").write_text(" [ \n ] ")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "one.json").write_text("[7]")
    wanted["one.json", 0] = 7
    found = read(spark, tmp_path)
    assert found.keys() == wanted.keys() and all(json.loads(found[k]) == wanted[k] for k in wanted)


@pytest.mark.parametrize("cut_small", [64], indirect=True)
def test_many_ranges_in_a_shuffle(spark, tmp_path, cut_small, monkeypatch):
    """Beyond the bound the ranges' starts aren't sent: the same rows, in order."""
    monkeypatch.setattr(json_arrays, "SENT_RANGES", 3)
    rows = [{"i": i, "t": '],"' * (i % 7)} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    assert json_arrays._pieces(spark, str(tmp_path)).select("start").distinct().count() > 50
    assert {k[1]: json.loads(v) for k, v in read(spark, tmp_path).items()} == dict(enumerate(rows))


@pytest.mark.parametrize("text", ['{"a": 1, "b": 2}', "[1, 2", '[1, "2]', "[1], 2", "[1] 2", "[1]]", "7", '"[1]"'])
@pytest.mark.parametrize("cut_small", [4, 1 << 27], indirect=True)
def test_no_array(spark, tmp_path, cut_small, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=json_arrays.NO_ARRAY):
        json_arrays.elements(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("cut_small", [200], indirect=True)
def test_records(spark, tmp_path, cut_small):
    """Records with places from ranges; one that doesn't parse has null fields."""
    rows = [{"file": f"u/{i}", "name": f'n"{i},'} for i in range(100)]
    (tmp_path / "gold.json").write_text("[" + ",".join([*map(json.dumps, rows), "5"]) + "]")
    found = files.json_array(spark, str(tmp_path / "gold.json"), by_ranges=True).orderBy("golden_index").collect()
    assert [(r["golden_index"], r["file"], r["name"]) for r in found] == [*((i, r["file"], r["name"]) for i, r in enumerate(rows)), (100, None, None)]


def test_ratio_bound(spark):
    """The native bound lets every pair through that reaches the ratio, and few others."""
    rnd = random.Random(5)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("abcdef ") for _ in range(rnd.randrange(1, 60)))
        b = list(a)
        for _ in range(rnd.randrange(5)):
            b[rnd.randrange(len(b))] = rnd.choice(["", "a", "zz", "🙂"])
        pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio_possible(F.col("a"), F.col("b"), 0.95).alias("possible")).collect()
    near = [similarity.block_ratio(r["a"], r["b"]) > 0.95 for r in rows]
    assert all(r["possible"] for r, n in zip(rows, near) if n) and 20 < sum(near)
    assert sum(r["possible"] for r in rows) < 1.6 * sum(near)
