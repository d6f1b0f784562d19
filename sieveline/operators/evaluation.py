"""How well detectors separate two populations: ROC curves, thresholds, error rates, bootstrap intervals.

Predictions are rows with a label (0 cover, 1 stego) and a score, and columns that name the detector and
variant (`by`). Everything works on the rows' counts per distinct score, which are combined before the
shuffle, and on running totals over those scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.joins import skew_join
from sieveline.operators.running import join_small, running_totals
from sieveline.session import materialize, release

By = Sequence[str]


def score_counts(pred: DataFrame, by: By = (), weight: str | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Weighted positives (p) and negatives (n) per distinct score; null scores and labels are left out."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    ok = pred.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    is_ = lambda v: F.sum(F.when(F.col(label) == v, w).otherwise(F.lit(0)))
    return ok.groupBy(*by, F.col(score).cast("double").alias("score")).agg(is_(1).alias("p"), is_(0).alias("n"))


def auc(pred: DataFrame, by: By = (), weight: str | None = None, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve per group, ties counted half: rows (by, p, n, auc).

    A group with only one class has a null area.
    """
    ranked = running_totals(score_counts(pred, by, weight, score, label), "score", ["n"], by)
    area = F.sum(F.col("p") * (F.col("n_before") + F.col("n") / 2))
    out = ranked.groupBy(*by).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), area.alias("_a"))
    return out.select(*by, "p", "n", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("_a") / (F.col("p") * F.col("n"))).alias("auc"))


def roc_points(pred: DataFrame, by: By = (), score: str = "score", label: str = "label") -> DataFrame:
    """One row per distinct score, as threshold: tp, fp and the class totals, scores at or above it positive."""
    counts = materialize(score_counts(pred, by, None, score, label), "scores")
    ranked = running_totals(counts, "score", ["p", "n"], by, descending=True)
    total = counts.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    points = ranked.select(*by, F.col("score").alias("threshold"), (F.col("p_before") + F.col("p")).alias("tp"), (F.col("n_before") + F.col("n")).alias("fp"))
    return join_small(points, total, by)


def youden(points: DataFrame, by: By = ()) -> DataFrame:
    """Threshold with the least false positive plus false negative rate; the highest one of a tie.

    The sum is compared as an integer, so that ties do not depend on rounding. points: from `roc_points`.
    """
    cost = F.col("fp") * F.col("all_p") + (F.col("all_p") - F.col("tp")) * F.col("all_n")
    ok = points.filter("all_p > 0 and all_n > 0")
    return ok.groupBy(*by).agg(F.min(F.struct(cost.alias("c"), (-F.col("threshold")).alias("t")))["t"].alias("_t")).select(*by, (-F.col("_t")).alias("threshold"))


def low_fpr_threshold(pred: DataFrame, by: By = (), share: float = 0.99, score: str = "score", label: str = "label") -> DataFrame:
    """The element of the negatives at 0-based index ceil(share * (n - 1)): rows (by, low_fpr_threshold)."""
    counts = materialize(score_counts(pred.filter(F.col(label) == 0), by, None, score, label), "scores")
    total = counts.groupBy(*by).agg(F.sum("n").alias("all_n"))
    ranked = join_small(running_totals(counts, "score", ["n"], by), total, by)
    index = F.ceil(F.lit(share) * (F.col("all_n") - 1))
    return ranked.filter(F.col("n_before") + F.col("n") > index).groupBy(*by).agg(F.min("score").alias("low_fpr_threshold"))


def calibrate(pred: DataFrame, by: By = (), score: str = "score", label: str = "label") -> DataFrame:
    """Direction and thresholds from validation predictions: rows (by, auc, direction, threshold, low_fpr_threshold).

    direction is 1 where the area is at least one half and -1 otherwise; thresholds are for oriented scores.
    Groups with a single class are left out.
    """
    pred = materialize(pred.select(*by, F.col(label).alias("label"), F.col(score).alias("score")), "validation")
    areas = materialize(auc(pred, by).filter("auc is not null"), "areas")
    areas = areas.select(*by, "auc", F.when(F.col("auc") >= 0.5, 1).otherwise(-1).alias("direction"))
    turned = materialize(join_small(pred, areas.drop("auc"), by).withColumn("score", F.col("score") * F.col("direction")), "turned")
    both = join_small(youden(roc_points(turned, by), by), low_fpr_threshold(turned, by), by)
    return join_small(areas, both, by)


def oriented(pred: DataFrame, calibration: DataFrame, by: By = ()) -> DataFrame:
    """Predictions with the calibration's direction applied to the score; its columns replace those of the same name."""
    frozen = calibration.select(*by, "direction", "threshold", "low_fpr_threshold")
    return join_small(pred.drop("direction", "threshold", "low_fpr_threshold"), frozen, by).withColumn("score", F.col("score") * F.col("direction"))


def error_rates(turned: DataFrame, by: By = ()) -> DataFrame:
    """Error rates of oriented predictions at their thresholds, one row per group."""
    hit = lambda cls, t: F.avg(F.when(F.col("label") == cls, (F.col("score") >= F.col(t)).cast("double")))
    out = turned.filter("score is not null").groupBy(*by).agg(
        F.count_if(F.col("label") == 0).alias("cover_images"),
        F.count_if(F.col("label") == 1).alias("stego_images"),
        hit(0, "threshold").alias("false_positive_rate"),
        hit(1, "threshold").alias("true_positive_rate"),
        hit(1, "low_fpr_threshold").alias("true_positive_rate_at_validation_1pct_fpr"),
        hit(0, "low_fpr_threshold").alias("actual_false_positive_rate_at_that_threshold"),
    )
    return out.withColumn("equal_prior_error", (F.col("false_positive_rate") + 1 - F.col("true_positive_rate")) / 2)


def robust(low: Column, high: Column) -> Column:
    """Upper bound of an area whichever way the detector is read."""
    return F.greatest(high, F.lit(1.0) - low)


#: The pass rule: the bound an area's interval must stay under in either direction, and the least a control must reach.
PASS_BOUND, CONTROL_BOUND = 0.55, 0.75
#: Draws handled at once: as many repetitions as that allows, so what is shuffled at a time does not grow with units or repetitions.
DRAWS = 20_000_000
#: Predictions a task weighs at once.
ROWS = 20_000


def draw_weights(pred: DataFrame, unit: str, repetitions: int, seed: str = "bootstrap-1") -> DataFrame:
    """Bootstrap draws of whole units: rows (rep, unit, weight), weight the times a unit was drawn.

    Each repetition draws as many units as there are, with replacement. Units are numbered in the order of
    the SHA-256 of their names, and a draw is the SHA-256 of repetition and number, so any engine repeats them.
    """
    numbered, n = _numbered_units(pred, unit)
    drawn = _draws(numbered.sparkSession, n, 0, repetitions, seed).groupBy("rep", "k").agg(F.count(F.lit(1)).alias("weight"))
    return drawn.join(numbered, "k").select("rep", "unit", "weight")


def _numbered_units(pred: DataFrame, unit: str) -> tuple[DataFrame, int]:
    """Units (unit, k) numbered in the order of their names' hashes, and how many there are."""
    units = pred.select(F.col(unit).cast("string").alias("unit")).filter("unit is not null").distinct()
    key = F.conv(F.substring(F.sha2("unit", 256), 1, 13), 16, 10).cast("bigint")
    numbered = running_totals(units.select("unit", key.alias("key"), F.lit(1).cast("bigint").alias("one")), "key", ["one"])
    numbered = materialize(numbered.select("unit", F.col("one_before").alias("k")), "units")
    return numbered, numbered.count()


def _draws(spark: SparkSession, n: int, first: int, end: int, seed: str = "bootstrap-1") -> DataFrame:
    """Draws (rep, k) of the repetitions from first up to, not including, end: k is the number of the unit drawn."""
    draws = spark.range(first * n, end * n).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), F.expr(f"id % {max(n, 1)}").alias("j"))
    word = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.col("rep").cast("string"), F.lit(":"), F.col("j").cast("string")), 256), 1, 12), 16, 10)
    return draws.select("rep", F.pmod(word.cast("bigint"), F.lit(max(n, 1))).alias("k"))


def _weigh(first: int, count: int):
    """For one range of one group's predictions, by repetition: positives, negatives, and pairs in the right order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", kind="stable")
        reps = pdf["reps"].map(lambda r: np.bincount(np.asarray(r, np.int64) - first, minlength=count))
        weight, label = np.stack(reps.to_numpy()).astype(np.int64), pdf["label"].to_numpy()
        _, begin = np.unique(pdf["score"].to_numpy(), return_index=True)
        p = np.add.reduceat(weight * (label == 1)[:, None], begin, axis=0)
        n = np.add.reduceat(weight * (label == 0)[:, None], begin, axis=0)
        # doubled, so that half a pair of a tie stays whole
        right = (p * (2 * (np.cumsum(n, axis=0) - n) + n)).sum(0)
        return pd.DataFrame({"_g": pdf["_g"].iat[0], "_range": pdf["_range"].iat[0], "p": [p.sum(0).tolist()], "n": [n.sum(0).tolist()], "pairs": [right.tolist()]})

    return run


def _areas(first: int):
    """Areas of a group by repetition, from its ranges in order: the negatives of earlier ranges lie below all positives."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range")
        at, begin = np.unique(pdf["_range"].to_numpy(), return_index=True)
        p, n, right = (np.add.reduceat(np.stack(pdf[c].to_numpy()).astype(float), begin, axis=0) for c in ("p", "n", "pairs"))
        tied = (at % 2 == 1)[:, None]  # all of one score, dealt to several tasks
        total = (np.where(tied, p * n, right) + 2 * p * (np.cumsum(n, axis=0) - n)).sum(0)
        all_p, all_n = p.sum(0), n.sum(0)
        ok = (all_p > 0) & (all_n > 0)
        return pd.DataFrame({"_g": key[0], "rep": first + np.flatnonzero(ok), "auc": total[ok] / (2 * all_p[ok] * all_n[ok])})

    return run


def bootstrap_areas(pred: DataFrame, unit: str, repetitions: int, by: By = (), draws: int = DRAWS, rows: int = ROWS) -> DataFrame:
    """Area of every bootstrap repetition: rows (by, rep, auc). Repetitions with a single class are left out.

    Predictions are ranked once, since an order does not depend on draws, and cut into ranges of about `rows`. A unit's
    draws travel as one list of repetitions to its predictions, hot units apart; each range gives three numbers a
    repetition, and the ranges of a group are put together from these. Null scores, labels and units do not count.
    """
    numbered, n = _numbered_units(pred, unit)
    ok = pred.select(*by, F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"), F.col(unit).cast("string").alias("unit")).dropna(subset=["label", "score", "unit"])
    groups = materialize(ok.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id()) if by else ok.limit(1).select(F.lit(0).cast("bigint").alias("_g")), "groups")
    ok = materialize(skew_join(join_small(ok, groups, by).select("_g", "label", "score", "unit"), numbered, "unit", "inner").drop("unit"), "predictions")
    # all rows of a score lie in one range; a score of more rows than a range has an odd one of its own, dealt to several tasks
    scores = ok.groupBy("_g", "score").agg(F.count(F.lit(1)).alias("c"))
    tied = F.col("c") > rows
    cut = running_totals(scores, "score", ["c"], ["_g"])
    cut = cut.select("_g", "score", (F.floor(F.col("c_before") / rows) * 2 + tied.cast("int")).alias("_range"), F.when(tied, F.ceil(F.col("c") / rows)).otherwise(1).cast("int").alias("_deal"))
    key = ok.withColumn("_key", F.xxhash64("_g", "score"))
    cut = cut.withColumn("_key", F.xxhash64("_g", "score")).withColumnsRenamed({"_g": "_cg", "score": "_cs"})
    ranked = skew_join(key, materialize(cut, "cuts"), "_key", "inner").withColumn("_deal", F.pmod(F.xxhash64("k"), "_deal").cast("int"))
    ranked = materialize(ranked.select("_g", "label", "score", "k", "_range", "_deal"), "ranked")
    size, blocks = max(1, min(repetitions, draws // max(n, 1))), []
    for first in range(0, repetitions if n else 0, size):
        end = min(first + size, repetitions)
        drawn = materialize(_draws(pred.sparkSession, n, first, end).groupBy("k").agg(F.collect_list(F.col("rep").cast("int")).alias("reps")), "draws")
        weighed = skew_join(ranked, drawn, "k", "inner").drop("k")
        parts = weighed.groupBy("_g", "_range", "_deal").applyInPandas(_weigh(first, end - first), "_g bigint, _range bigint, p array<bigint>, n array<bigint>, pairs array<bigint>")
        blocks.append(materialize(parts.groupBy("_g").applyInPandas(_areas(first), "_g bigint, rep bigint, auc double"), "areas"))
        release(drawn)
    if not blocks:
        return groups.drop("_g").withColumns({"rep": F.lit(0).cast("bigint"), "auc": F.lit(0.0)}).limit(0)
    return join_small(reduce(DataFrame.unionByName, blocks), groups, ["_g"]).select(*by, "rep", "auc")


def interval(values: DataFrame, value: str, by: By = ()) -> DataFrame:
    """95 % interval of the repetitions: linear quantiles 0.025 and 0.975."""
    q = values.groupBy(*by).agg(F.expr(f"percentile({value}, array(0.025, 0.975))").alias("q"))
    return q.select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_interval(pred: DataFrame, unit: str, repetitions: int = 1000, by: By = ()) -> DataFrame:
    """Group bootstrap interval of the area: rows (by, low, high). Both classes of a unit are drawn together."""
    return interval(bootstrap_areas(pred, unit, repetitions, by), "auc", by)


def paired_difference(pred: DataFrame, unit: str, pair: str, first: str, second: str, repetitions: int = 1000, by: By = ()) -> DataFrame:
    """Bootstrap of the area difference of two variants (column `pair`) under the same draws.

    Rows (by, delta, low, high, robust_low, robust_high); the robust difference is that of the areas in the
    better direction. Units are those of both variants together.
    """
    rows = materialize(pred.filter(F.col(pair).isin(first, second)), "pair")
    side = lambda v, name: F.max(F.when(F.col(pair) == v, F.col("auc"))).alias(name)
    whole = auc(rows, [*by, pair]).groupBy(*by).agg(side(first, "_a"), side(second, "_b"))
    whole = whole.select(*by, (F.col("_a") - F.col("_b")).alias("delta"))
    reps = bootstrap_areas(rows, unit, repetitions, [*by, pair]).groupBy(*by, "rep").agg(side(first, "_a"), side(second, "_b"))
    best = lambda c: F.greatest(F.col(c), 1 - F.col(c))
    reps = reps.filter("_a is not null and _b is not null").select(*by, (F.col("_a") - F.col("_b")).alias("_d"), (best("_a") - best("_b")).alias("_r"))
    q = reps.groupBy(*by).agg(F.expr("percentile(_d, array(0.025, 0.975))").alias("_d"), F.expr("percentile(_r, array(0.025, 0.975))").alias("_r"))
    q = q.select(*by, F.col("_d")[0].alias("low"), F.col("_d")[1].alias("high"), F.col("_r")[0].alias("robust_low"), F.col("_r")[1].alias("robust_high"))
    return join_small(whole, q, by)


def verdict(delta: Column, low: Column, high: Column, a: Column, b: Column) -> Column:
    """What a paired difference says: uncertain where its interval holds 0, improved where it lies below and both areas are at least a half, else changed."""
    return (
        F.when((low <= 0) & (high >= 0), F.lit("uncertain"))
        .when((high < 0) & (a >= 0.5) & (b >= 0.5), F.lit("improved"))
        .otherwise(F.lit("changed"))
    )
