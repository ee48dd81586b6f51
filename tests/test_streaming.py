"""Streams that touch what a batch changes and no more."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from awardry.streaming import ingest, keyed, running


def put(path, name, rows):
    (path / "in").mkdir(exist_ok=True)
    (path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))


def case(i, o, **more):
    return {"ord": o, "case_name": f"case {i}", "year": 2000 if i % 3 else None, "court": "x", "category": "K", **more}


def test_a_batch_touches_its_keys_alone(spark, tmp_path):
    args = [str(tmp_path / x) for x in ("in", "records", "store", "checkpoint")]
    put(tmp_path, "1.json", [case(i, i) for i in range(200)])
    ingest.ingest_stream(spark, *args).awaitTermination()
    put(tmp_path, "2.json", [case(i, 1000 + i, category="H") for i in range(0, 100, 10)] + [case(500, 2000)])
    ingest.ingest_stream(spark, *args).awaitTermination()
    changed = spark.read.parquet(args[2]).where("batch = 1")
    assert {r.case_name for r in changed.collect()} == {f"case {i}" for i in (*range(0, 100, 10), 500)}
    assert spark.read.parquet(args[1]).where("batch = 1").count() == 11  # new records alone are appended
    got = {r.case_name: r for r in ingest.latest_version(spark, args[2]).collect()}
    assert len(got) == 201 and got["case 10"].n_records == 2 and got["case 10"].categories == ["H", "K"] and got["case 11"].n_records == 1
    # a batch that is put again replaces itself
    before = sorted(map(str, got.values()))
    keyed.put(spark.createDataFrame(changed.drop("batch").collect(), changed.drop("batch").schema), args[2], 1)
    assert sorted(map(str, ingest.latest_version(spark, args[2]).collect())) == before
    keyed.compacted(spark, args[2], ingest.KEYS, str(tmp_path / "compacted"))
    assert sorted(map(str, ingest.latest_version(spark, str(tmp_path / "compacted")).collect())) == before


def test_running_sketches(spark, tmp_path):
    rng = random.Random(7)
    rows = [(g, rng.choice([None, 0.0, -rng.lognormvariate(2, 1), rng.lognormvariate(5, 2), rng.lognormvariate(5, 2)])) for g in ("a", "b", None) for _ in range(901)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "g string, v double").repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("g string, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keyed.upserted(running.running_sketches(stream, "g", "v"), f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s").select(F.countDistinct("batch")).first()[0] == 5
    got = {r.g: r for r in running.statistics_of(keyed.latest(spark, f"{tmp_path}/s", ["g", "bucket"]), "g").collect()}
    for g in ("a", "b", None):
        v = np.array(sorted(x for h, x in rows if h == g and x is not None))
        r = got[g]
        assert r.n == len(v) and np.allclose([r.mean, r.min, r.max, r.std], [v.mean(), v.min(), v.max(), v.std()])
        middle = v[(len(v) - 1) // 2]
        assert abs(r.median - middle) <= abs(middle) / running.ERROR


def test_cases_without_a_name_are_one_over_batches(spark, tmp_path):
    """Null, an empty name and Unknown are one case, whichever batch brings them; a case's records are state without a Python group each."""
    args = [str(tmp_path / x) for x in ("in", "records", "store", "checkpoint")]
    for i, name in enumerate((None, "", "Unknown", "x")):
        put(tmp_path, f"{i}.json", [case(0, i) | {"case_name": name}])
        ingest.ingest_stream(spark, *args).awaitTermination()
        assert spark.read.parquet(args[1]).where(F.col("batch") == i).count() == 1
    assert sorted((r.case_name, r.n_records) for r in ingest.latest_version(spark, args[2]).collect()) == [("Unknown", 3), ("x", 1)]
