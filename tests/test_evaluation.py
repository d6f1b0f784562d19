import numpy as np
import pytest

from sieveline.operators import evaluation as ev
from sieveline.operators.running import join_small, quantiles, running_totals

SCHEMA = "d string, label int, score double, unit string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_auc(pos, neg):
    return float(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def test_running_totals_equal_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x), int(v)) for g in ("a", None) for x, v in zip(rng.permutation(300), rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "g string, x double, v int")
    for down, rows_a_range in ((False, 90), (True, 90), (True, 10**6)):
        got = {(r["g"], r["x"]): r["v_before"] for r in running_totals(df, "x", ["v"], ["g"], descending=down, rows=rows_a_range).collect()}
        for g, x, _ in rows:
            assert got[g, x] == sum(v for h, y, v in rows if h == g and (y > x if down else y < x))
    assert running_totals(df.limit(0), "x", ["v"], ["g"]).count() == 0


def test_auc_ties_nulls_and_single_class(spark):
    rng = np.random.default_rng(2)
    pos, neg = rng.integers(0, 12, 80), rng.integers(0, 10, 90)
    rows = [("x", 1, float(v), "u") for v in pos] + [("x", 0, float(v), "u") for v in neg]
    rows += [("x", None, 3.0, "u"), ("x", 1, None, "u"), ("only", 1, 1.0, "u"), (None, 1, 2.0, "u"), (None, 0, 1.0, "u")]
    got = {r["d"]: r["auc"] for r in ev.auc(frame(spark, rows), ["d"]).collect()}
    assert got["x"] == pytest.approx(brute_auc(pos, neg))
    assert got["only"] is None and got[None] == 1.0
    assert ev.auc(frame(spark, []), ["d"]).count() == 0


def test_identical_scores_are_chance(spark):
    rows = [("x", c, i / 9, f"u{i}") for i in range(10) for c in (0, 1)]
    r = join_small(ev.auc(frame(spark, rows), ["d"]), ev.bootstrap_interval(frame(spark, rows), "unit", 20, ["d"]), ["d"]).head()
    assert (r["auc"], r["low"], r["high"]) == (0.5, 0.5, 0.5)


def test_reversed_detector_is_turned_and_fails_the_gate(spark):
    rows = [("x", 0, 1.0 + i / 100, f"u{i}") for i in range(20)] + [("x", 1, i / 100, f"u{i}") for i in range(20)]
    c = ev.calibrate(frame(spark, rows), ["d"]).head()
    assert c["direction"] == -1 and c["auc"] == 0.0
    rates = ev.error_rates(ev.oriented(frame(spark, rows), ev.calibrate(frame(spark, rows), ["d"]), ["d"]), ["d"]).head()
    assert rates["equal_prior_error"] == 0.0


def test_thresholds_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    neg, pos = rng.integers(0, 30, 173) * 1.0, rng.integers(5, 40, 121) * 1.0
    df = frame(spark, [("x", 0, v, "u") for v in neg.tolist()] + [("x", 1, v, "u") for v in pos.tolist()])
    best = min(sorted(set(neg) | set(pos), reverse=True), key=lambda t: (np.mean(neg >= t) + np.mean(pos < t)).round(12))
    assert ev.youden(ev.roc_points(df, ["d"]), ["d"]).head()["threshold"] == best
    assert ev.low_fpr_threshold(df, ["d"]).head()["low_fpr_threshold"] == np.quantile(neg, 0.99, method="higher")


def test_bootstrap_is_repeatable_and_keeps_units_whole(spark):
    rng = np.random.default_rng(4)
    rows = [("x", c, float(rng.normal(c)), f"u{i // 2}") for i in range(60) for c in ((0, 1) if i % 3 else (0,))]
    df = frame(spark, rows)
    a, b = (ev.bootstrap_interval(df.repartition(k), "unit", 30, ["d"]).head() for k in (2, 5))
    assert (a["low"], a["high"]) == (b["low"], b["high"]) and a["low"] < a["high"]
    w = ev.draw_weights(df, "unit", 5)
    assert {r["s"] for r in w.groupBy("rep").agg({"weight": "sum"}).toDF("rep", "s").collect()} == {30}


def test_paired_difference_of_equal_variants_is_zero(spark):
    rows = [(v, c, i * 1.0 + c, f"u{i}") for v in ("a", "b") for i in range(12) for c in (0, 1)]
    df = frame(spark, rows).withColumnRenamed("d", "variant").selectExpr("*", "'x' as d")
    r = ev.paired_difference(df, "unit", "variant", "a", "b", 10, ["d"]).head()
    assert (r["delta"], r["low"], r["high"]) == (0, 0, 0)


def test_clashing_columns(spark):
    rows = frame(spark, [("x", c, float(i + c), "u") for i in range(9) for c in (0, 1)]).selectExpr("*", "1 as direction", "2 as threshold", "3 as _range", "4 as p")
    out = ev.error_rates(ev.oriented(rows, ev.calibrate(rows, ["d"]), ["d"]), ["d"])
    assert out.count() == 1


def test_bootstrap_equals_weighted_areas_however_it_is_cut(spark):
    """Ranges, blocks of draws and dealt ties give the areas of the plain weighted computation."""
    rng = np.random.default_rng(5)
    rows = [(v, c, float(min(max(rng.integers(-4, 9), 0), 5)), f"u{i % 17}") for v in ("x", None) for i in range(150) for c in (0, 1)] + [("x", 1, None, "u1"), ("x", None, 1.0, "u2"), ("x", 1, 1.0, None)]
    df = frame(spark, rows)
    weights = {}
    for r in ev.draw_weights(df, "unit", 12).collect():
        weights.setdefault(r["rep"], {})[r["unit"]] = r["weight"]
    want = {}
    for v in ("x", None):
        for rep, w in weights.items():
            pos = [(s, w.get(u, 0)) for d, c, s, u in rows if d == v and c == 1 and s is not None and u]
            neg = [(s, w.get(u, 0)) for d, c, s, u in rows if d == v and c == 0 and s is not None and u]
            right = sum(a * b * ((p > n) + 0.5 * (p == n)) for p, a in pos for n, b in neg)
            want[v, rep] = right / (sum(a for _, a in pos) * sum(b for _, b in neg))
    for draws, cut in ((10**6, 10**6), (60, 40), (60, 7)):
        got = {(r["d"], r["rep"]): r["auc"] for r in ev.bootstrap_areas(df, "unit", 12, ["d"], draws, cut).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert ev.bootstrap_areas(df.limit(0), "unit", 5, ["d"]).count() == 0


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(g, 0, float(v), "u") for g in ("a", None) for v in rng.integers(0, 40, 101)] + [("b", 0, 7.0, "u"), ("b", 0, None, "u"), ("c", 0, None, "u")]
    for cut in (13, 10**6):
        got = {r["d"]: (r["q0"], r["q1"]) for r in quantiles(frame(spark, rows), "score", (0.5, 0.025), ["d"], cut).collect()}
        assert set(got) == {"a", "b", None}
        for g in got:
            assert got[g] == pytest.approx(np.quantile([s for d, _, s, _ in rows if d == g and s is not None], (0.5, 0.025)))
