"""Pairs of runs against a loop over the records."""

from collections import defaultdict

from sieveline.plans import bookkeeping as plans


def test_a_failed_run_loses_only_its_own_pair(spark, tables):
    rows = spark.read.parquet(tables + "/sample_record.parquet").select("image", "option", "strategy", "job_seconds", "changed_pixels", "failure", "recorded_at").collect()
    runs, want, hurt = defaultdict(list), [], set()
    for r in set(rows):
        if r["image"] is not None and r["option"] in ("0.05", "auto"):
            runs[r["image"], r["option"]].append(r)
    assert all(len({r["recorded_at"] for r in x}) == len(x) for x in runs.values())  # the order is whole
    for image in {i for i, _ in runs}:
        one, other = (sorted(runs[image, o], key=lambda r: r["recorded_at"]) for o in ("0.05", "auto"))
        for k, (a, b) in enumerate(zip(one, other)):
            if any(r["failure"] is not None or r["job_seconds"] is None for r in (a, b)):
                hurt.add(image)
            elif a["strategy"] == b["strategy"]:
                want.append((image, a["strategy"], k, a["job_seconds"], b["job_seconds"], a["changed_pixels"], b["changed_pixels"]))
    got = plans.QUERIES["j5_pairs"](spark, tables).select("image", "strategy", "run", "job_seconds_a", "job_seconds_b", "changed_pixels_a", "changed_pixels_b")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert hurt & {w[0] for w in want} and len(want) > len({w[0] for w in want})
    saved = plans.QUERIES["a5_paired_saving"](spark, tables).collect()
    assert 0 < sum(r["complete_pairs"] for r in saved) <= len(want)
