"""Arrays read in pieces against Python's parser."""

import json
import random

from awardry.sources.cases import read_cases
from awardry.sources.json_array import read_json_array

SCHEMA = "a string, n long, o struct<x:string,y:array<struct<z:string>>>, m array<long>"


def value(rng):
    text = lambda: "".join(rng.choice(['{', '}', '[', ']', '"', "\\", ",", " ", "a", "é", "\n", "\\\"", "}{"]) for _ in range(rng.randrange(0, 12)))
    return {"a": rng.choice([None, text()]), "n": rng.randrange(99), "o": {"x": text(), "y": [{"z": text()} for _ in range(rng.randrange(3))]}, "m": [1, 2]}


def test_objects_with_braces_in_strings(spark, tmp_path):
    rng = random.Random(8)
    want = []
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for i, indent in enumerate((None, 2, None, None)):
            rows = [value(rng) for _ in range((300, 100, 0, 1)[i])]
            (tmp_path / f"{i}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(i)))
            want += rows
        df = read_json_array(spark, str(tmp_path), SCHEMA, slots=6)
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5  # one file is read by many tasks
        got = sorted(df.collect(), key=lambda r: r.ord)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.ord for r in got] == list(range(len(want)))
    for r, w in zip(got, want):
        d = r.asDict(recursive=True)
        d.pop("ord")
        assert d == w


def test_cases(spark, tmp_path):
    rows = [{"case_name": f"A{i}", "year": 2000 + i, "judge": ["Smith J.", "B"], "comments": "}{ \" ]"} for i in range(20)]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    key = lambda split: sorted(map(str, read_cases(spark, str(tmp_path / "c.json"), "parsed", split=split).collect()))
    assert key(True) == key(False) and len(key(True)) == 20
