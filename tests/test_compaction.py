import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import compaction as c

ONE = {"result": {"image": "covers/100000001.pgm", "run": "r1", "option": "0.05", "changed_pixels": 5}}
TWO = {"result": {"image": 100000002, "run": "r1", "option": 0.01, "failure": "x"}, "auto": None}
AUTO = {"result": {"image": "100000003", "run": "r2", "option": "auto"}, "auto": {"changed_pixels": 9, "rate": "1/400", "stored_bytes": 3}}


def files(spark, texts):
    rows = [(i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_id int, content string, s int")
    return df.withColumn("modified_at", F.timestamp_seconds("s")).withColumn("record", F.lit("clash")).withColumn("r", F.lit(1))


def found(df):
    return sorted((r["run_id"], r["image"], r["option"]) for r in df.collect())


def test_layouts_and_faults(spark):
    texts = [
        json.dumps(ONE), "﻿" + json.dumps(TWO, indent=2) + "\r\n", json.dumps([AUTO, ONE]),
        json.dumps(ONE) + "\r\n" + json.dumps(AUTO) + "\n" + json.dumps(TWO)[:-5],
        json.dumps(ONE)[:-1], json.dumps(ONE) + "]", json.dumps(ONE) + "}", json.dumps(ONE) + " x", "", None, "  \n", "12", '"a"', "[]", '{"other": 1}', "null",
        "[" + json.dumps(TWO), json.dumps(ONE, indent=1)[:-2],
    ]
    got = c.read_records(files(spark, texts))
    want = [("r1", "100000001", "0.05")] * 3 + [("r1", "100000002", "0.01")] + [("r2", "100000003", "auto")] * 2
    assert found(got) == sorted(want)
    assert {r["auto_changed_pixels"] for r in got.filter("option = 'auto'").collect()} == {9}


def test_each_record_once_and_the_last_wins(spark):
    late = json.loads(json.dumps(ONE))
    late["result"]["changed_pixels"] = 7
    lacking = {"result": {"image": "100000009"}}
    done, commit = c.compact_files(files(spark, [json.dumps(ONE), json.dumps(late), json.dumps(lacking), json.dumps(lacking), json.dumps(TWO)]))
    assert commit.rows == 3 and commit.files >= 1
    assert done.filter("image = '100000001'").head()["changed_pixels"] == 7
    assert done.filter("run_id is null").count() == 1


def test_empty_input_gives_an_empty_table(spark):
    done, commit = c.compact_files(files(spark, []))
    assert commit.rows == 0 and done.count() == 0


def test_few_files_and_no_overwriting(spark, tmp_path):
    rows = spark.range(20_000).repartition(50).select(F.col("id").cast("string").alias("a"))
    commit = c.compact(rows, str(tmp_path / "out"))
    assert commit.rows == 20_000 and commit.files <= 4
    with pytest.raises(FileExistsError):
        c.compact(rows, str(tmp_path / "out"))


def test_hot_record(spark):
    texts = [json.dumps(ONE)] * 400 + [json.dumps(TWO)] * 20
    assert c.unique_records(c.read_records(files(spark, texts))).count() == 2
