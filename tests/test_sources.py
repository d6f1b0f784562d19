import json

import pytest
from pyspark.sql import functions as F

from sieveline import cli
from sieveline.kernels import images
from sieveline.operators import bookkeeping as bk
from sieveline.operators import image_jobs, report
from sieveline.session import intermediates, materialize, release, shared_folder
from sieveline.sources import files
from sieveline.streaming import samples


def test_images_are_read_in_order_of_their_numbers(spark, tmp_path):
    for n in ("10", "9", "x"):
        (tmp_path / f"{n}.pgm").write_bytes(b"P5\n3 2\n255\n" + bytes(6))
    (tmp_path / "8.pgm").write_bytes(b"broken")
    rows = files.read_images(spark, str(tmp_path), any_size=True).collect()
    assert [r["image_id"] for r in rows] == ["8", "9", "10", "x"] and rows[0]["fault"] and rows[1]["width"] == 3
    with pytest.raises(ValueError):
        files.require_count(spark.range(3), 4)
    with pytest.raises(ValueError):
        files.read_images(spark, str(tmp_path), any_size=True, expected=10_000)
    assert files.read_images(spark, str(tmp_path), any_size=True, expected=4).count() == 4


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "image string, changed_pixels bigint")
    files.append_json(df, str(tmp_path / "log"))
    files.append_json(df, str(tmp_path / "log"))
    assert files.read_json(spark, str(tmp_path / "log"), files.SAMPLE).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        files.create_json(df, str(tmp_path / "log"))
    (tmp_path / "whole.json").write_text(json.dumps([{"image": "b"}], indent=1))
    assert files.read_json(spark, str(tmp_path / "whole.json"), files.SAMPLE, lines=False).head()["image"] == "b"


def test_predictions_and_arrays(spark, tmp_path):
    row = ("v", "d", "test", "i", 1, 0.5)
    files.write_predictions(spark.createDataFrame([row, ("w", *row[1:])], files.PREDICTION), str(tmp_path / "p"))
    got = files.read_predictions(spark, str(tmp_path / "p")).filter("variant = 'v'")
    assert got.count() == 1 and "PartitionFilters: [isnotnull(variant" in got._jdf.queryExecution().toString()
    files.write_arrays(spark.createDataFrame([([1.0, 2.0],)], "f array<float>"), str(tmp_path / "a"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_arrays(spark.createDataFrame([([1.0],)], "f array<float>"), str(tmp_path / "a"))


def test_junit_and_fingerprint(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuites><testsuite tests="3" failures="1" errors="0" skipped="1"/><testsuite tests="2" failures="0" errors="0" skipped="0"></testsuite></testsuites>')
    assert tuple(files.junit_totals(spark, str(tmp_path / "r.xml")).head()) == (5, 1, 0, 1)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x")
    got = files.fingerprint(spark, str(tmp_path / "src")).collect()
    assert len(got) == 1 and got[0]["sha256"].startswith("2d711642")
    assert files.environment(spark).head()["spark"] == spark.version and len(files.new_key()) == 32
    assert any(p.startswith("pyspark==") for p in files.environment(spark).head()["packages"])


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5, None)], "n string, v double, w int")
    report.write_report(str(tmp_path / "r.md"), "Title", {"One": df, "Two": "text"})
    text = (tmp_path / "r.md").read_text()
    assert "| a\\|b | 0.5000 |  |" in text and text.startswith("# Title")
    with pytest.raises(ValueError):
        report.markdown_table(spark.range(2000))


def test_command_line(tmp_path, capsys):
    cover, out = tmp_path / "c.png", tmp_path / "s.png"
    cover.write_bytes(images.encode_png(image_jobs.synthetic_cover(5)))
    (tmp_path / "m").write_bytes(b"HELLO")
    assert cli.main(["keygen", "--output", str(tmp_path / "k")]) == 0
    assert cli.main(["keygen", "--output", str(tmp_path / "k"), "--output-logs", str(tmp_path / "log")]) == 1
    assert json.loads((tmp_path / "log").read_text())["status"] == "failed"
    common = ["--image", str(cover), "--key", str(tmp_path / "k"), "--message", str(tmp_path / "m")]
    capsys.readouterr()
    assert cli.main(["analyze", *common, "--rate", "0.05"]) == 0
    plan = json.loads(capsys.readouterr().out)
    assert plan["chosen"]["frame_bytes"] == 1638 and plan["suggested"]["frame_bytes"] == 81
    assert cli.main(["embed", *common, "--output", str(out), "--strategy", "baseline"]) == 0
    rate = json.loads(capsys.readouterr().out)["rate"]
    assert cli.main(["embed", *common, "--output", str(tmp_path / "t.png"), "--output-logs", str(tmp_path / "stages")]) == 0
    assert [s["stage"] for s in json.loads((tmp_path / "stages").read_text())["stages"]] == ["costs", "coding", "balancing"]
    assert cli.main(["extract", "--image", str(out), "--key", str(tmp_path / "k"), "--rate", rate, "--output", str(tmp_path / "got")]) == 0
    assert (tmp_path / "got").read_bytes() == b"HELLO"
    assert cli.main(["extract", "--image", str(cover), "--key", str(tmp_path / "k"), "--rate", rate, "--output", str(tmp_path / "no")]) == 1


def test_commands_over_tables(spark, tables, tmp_path, monkeypatch, capsys):
    from sieveline.plans import bookkeeping, flows

    assert cli.main(["prepare", "--tables", tables, "--output", str(tmp_path / "corpus")]) == 0
    got = spark.read.json(str(tmp_path / "corpus"))
    assert got.groupBy("group_id").agg(F.count_distinct("part").alias("n")).filter("n > 1").count() == 0 < got.count()
    assert cli.main(["prepare", "--tables", tables, "--output", str(tmp_path / "corpus")]) == 1
    monkeypatch.setattr(flows, "SECTIONS", {"Records": bookkeeping.o3_sorted_report})
    assert cli.main(["report", "--tables", tables, "--output", str(tmp_path / "r.md")]) == 0
    assert "## Records" in (tmp_path / "r.md").read_text()


def test_written_tables_are_deleted(spark):
    import os

    with intermediates(spark):
        a, b = materialize(spark.range(5), "a"), materialize(spark.range(6), "b")
        release(a, spark.range(3))
        assert not os.path.exists(a._written_path) and b.count() == 6
    assert not os.path.exists(b._written_path)


def test_completeness_is_enforced(spark):
    parts = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "image_id string, part string")
    done = spark.createDataFrame([("a", True), ("c", False)], "image_id string, ok boolean")
    got = {r["part"]: (r["missing"], r["usable"], r["enough"]) for r in bk.completeness(parts, done, 1).collect()}
    assert got == {"train": (1, 1, True), "test": (0, 0, False)}
    with pytest.raises(Exception, match="no record"):
        bk.require_complete(bk.completeness(parts, done, 0)).collect()
    with pytest.raises(Exception, match="too few"):
        bk.require_complete(bk.completeness(parts.filter("part = 'test'"), done, 1)).collect()


def test_stream_of_samples(spark, tmp_path):
    schema = "image string, option string, recorded_at timestamp, failure string"
    rows = spark.createDataFrame([("a", "1", 10**9, None), ("a", "1", 10**9 + 60, None), ("b", "1", 10**9, "x")], "image string, option string, s int, failure string")
    rows = rows.select("image", "option", F.timestamp_seconds("s").alias("recorded_at"), "failure")
    rows.write.parquet(str(tmp_path / "in"))
    once = samples.first_of_each(samples.new_samples(spark, str(tmp_path / "in"), schema))
    samples.run_available(once, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "in"))
    samples.run_available(once, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_bookkeeping_with_nulls_ties_and_clashes(spark):
    rows = spark.createDataFrame([("a", "x", 4.0, True), ("a", "y", 3.0, True), ("b", "x", 4.0, True), ("c", "x", 1.0, True), ("c", "y", 1.0, None), ("d", "x", 0.0, True), ("d", "y", 1.0, True), ("e", "x", 2.0, True), ("e", "y", 1.0, True), ("e", "z", 1.0, True)], "k string, v string, s double, ok boolean")
    pairs = bk.pair_up(rows, ["k"], "v", "x", "y", ["s"], F.col("ok"))
    assert {r["k"] for r in pairs.collect()} == {"a", "d"}
    r = bk.paired_saving(pairs.withColumn("g", F.lit(1)), "s", ["g"]).head()
    assert (r["complete_pairs"], r["median_saving"]) == (1, 25.0)
    assert [r["k"] for r in bk.pending(spark.createDataFrame([("a",), ("z",), (None,)], "k string"), rows, ["k"]).orderBy("k").collect()] == [None, "z"]
    ev = spark.createDataFrame([(1, 0, 5), (1, 60, 5), (1, 90_000, 7), (2, None, 1), (None, 5, None), (None, 9, 2)], "u int, s int, v int")
    ev = ev.select("u", F.timestamp_seconds("s").alias("t"), "v", F.lit(0).alias("_at"), F.lit(0).alias("_bucket"), F.lit(1).alias("seconds"))
    got = {(r["u"], r["v"], str(r["t"])): r["seconds"] for r in bk.stage_seconds(ev, ["u"], "t", "v").collect()}
    assert sorted(x for x in got.values() if x is not None) == [4.0, 60.0, 89_940.0]
    best = [(r["u"], r["v"]) for r in bk.running_best(ev, ["u"], "t", "v", "v").collect()]
    assert sorted(map(str, best)) == sorted(map(str, [(1, 5), (1, 7), (2, 1), (None, 2)]))
    with pytest.raises(Exception, match="no good"):
        bk.require(rows, F.col("s") == 0, "no good").collect()
    means = {r["stage"]: r["mean"] for r in bk.stage_means(rows.withColumn("g", F.lit(1)), ["g"], "k", "v", "s").collect()}
    assert means["z"] == pytest.approx(0.2)
    for f in (bk.stage_seconds, ):
        assert f(ev.limit(0), ["u"], "t", "v").count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
