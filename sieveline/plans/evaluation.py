"""Queries on detector quality (inventory A7-A16, W3, O5, U1, P13, P18) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import evaluation as ev
from sieveline.operators.running import join_small
from sieveline.plans.tables import PREDICTIONS, predictions

BY = ("variant", "detector")
#: Repetitions of the bootstrap, in the queries and in their SQL.
REPETITIONS = 1000


def a7_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.auc(predictions(spark, sf_dir), BY)


def a7_auc_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.auc(predictions(spark, sf_dir), [*BY, "part"])


def w3_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ev.roc_points(predictions(spark, sf_dir), BY)
    return p.select(*BY, "threshold", (F.col("tp") / F.col("all_p")).alias("tpr"), (F.col("fp") / F.col("all_n")).alias("fpr"))


def a8_youden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.youden(ev.roc_points(predictions(spark, sf_dir), BY), BY)


def a10_low_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.low_fpr_threshold(predictions(spark, sf_dir), BY)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pred = ev.materialize(predictions(spark, sf_dir), "predictions")
    return pred.filter("part = 'validation'"), pred.filter("part = 'test'")


def a9_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and thresholds frozen on the validation part."""
    return ev.calibrate(_split(spark, sf_dir)[0], BY)


def a11_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of the test part at the validation thresholds."""
    validation, test = _split(spark, sf_dir)
    return ev.error_rates(ev.oriented(test, ev.materialize(ev.calibrate(validation, BY), "calibration"), BY), BY)


def _metrics(spark: SparkSession, sf_dir: str, repetitions: int) -> DataFrame:
    pred = ev.materialize(predictions(spark, sf_dir), "predictions")
    ci = ev.bootstrap_interval(pred, "group_id", repetitions, BY)
    return join_small(ev.auc(pred, BY), ci, BY)


def a13_bootstrap(spark: SparkSession, sf_dir: str, repetitions: int = REPETITIONS) -> DataFrame:
    """Area with its group bootstrap interval."""
    return _metrics(spark, sf_dir, repetitions).select(*BY, "auc", "low", "high")


def a12_robust(spark: SparkSession, sf_dir: str, repetitions: int = REPETITIONS) -> DataFrame:
    """Areas in either direction and the pass rule."""
    upper = ev.robust(F.col("low"), F.col("high"))
    out = _metrics(spark, sf_dir, repetitions).withColumn("orientation_robust_auc", F.greatest("auc", 1 - F.col("auc"))).withColumn("orientation_robust_auc_upper_95", upper)
    return out.select(*BY, "orientation_robust_auc", "orientation_robust_auc_upper_95", (upper <= ev.PASS_BOUND).alias("passes_provisional_upper_bound"))


def q_p13_status(spark: SparkSession, sf_dir: str, repetitions: int = REPETITIONS) -> DataFrame:
    """Pass, fail or control per detector; option auto plays the control."""
    out = a12_robust(spark, sf_dir, repetitions)
    status = F.when(F.col("variant") == "auto", "control").when(F.col("passes_provisional_upper_bound"), "pass").otherwise("fail")
    return out.select(*BY, status.alias("status"))


def q_p18_gate(spark: SparkSession, sf_dir: str, repetitions: int = REPETITIONS) -> DataFrame:
    """Gate per variant: every upper bound passes, or a control's least lower bound exceeds its limit."""
    out = _metrics(spark, sf_dir, repetitions).withColumn("upper", ev.robust(F.col("low"), F.col("high")))
    return out.groupBy("variant").agg(F.bool_and(F.col("upper") <= ev.PASS_BOUND).alias("passes"), (F.min("low") > ev.CONTROL_BOUND).alias("control_ok"))


def a16_max_upper(spark: SparkSession, sf_dir: str, repetitions: int = REPETITIONS) -> DataFrame:
    """The worst upper bound per variant and the detector that has it."""
    out = _metrics(spark, sf_dir, repetitions).withColumn("upper", ev.robust(F.col("low"), F.col("high")))
    return out.groupBy("variant").agg(F.max("upper").alias("max_upper"), F.max_by("detector", "upper").alias("detector"))


def a14_paired_difference(spark: SparkSession, sf_dir: str, repetitions: int = REPETITIONS) -> DataFrame:
    """Area of option 0.05 minus that of 0.01 under the same draws."""
    return ev.paired_difference(predictions(spark, sf_dir), "group_id", "variant", "0.05", "0.01", repetitions, ["detector"])


def a15_verdict(spark: SparkSession, sf_dir: str, repetitions: int = REPETITIONS) -> DataFrame:
    """What the paired difference establishes for each detector."""
    pred = ev.materialize(predictions(spark, sf_dir), "predictions")
    diff = ev.paired_difference(pred, "group_id", "variant", "0.05", "0.01", repetitions, ["detector"])
    areas = ev.auc(pred, BY)
    at = lambda v, n: areas.filter(F.col("variant") == v).select("detector", F.col("auc").alias(n))
    out = diff.join(at("0.05", "a"), "detector").join(at("0.01", "b"), "detector")
    return out.select("detector", ev.verdict(F.col("delta"), F.col("low"), F.col("high"), F.col("a"), F.col("b")).alias("verdict"))


def u1_labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of either class per variant and detector in the union of covers and stegos."""
    return predictions(spark, sf_dir).groupBy(*BY, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        a7_auc, a7_auc_by_part, w3_roc_points, a8_youden, a9_calibration, a10_low_fpr, a11_error_rates, a12_robust, a13_bootstrap,
        a14_paired_difference, a15_verdict, a16_max_upper, q_p13_status, q_p18_gate, u1_labelled_union,
    )
}

_AUC = """
, {x}_c AS (SELECT {by}, score, sum({w} * label) AS p, sum({w} * (1 - label)) AS n FROM {src} GROUP BY {by}, score),
{x}_r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM {x}_c),
{x} AS (SELECT {by}, sum(p)::BIGINT AS p, sum(n)::BIGINT AS n, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (nb + n / 2)) / (sum(p) * sum(n)) END::DOUBLE AS auc FROM {x}_r GROUP BY {by})
"""


def _auc_sql(name: str, by: str, src: str, weight: str = "1") -> str:
    return _AUC.format(x=name, by=by, src=src, w=weight)


_ROC = """
, {x}_c AS (SELECT variant, detector, score, sum(label)::BIGINT AS p, sum(1 - label)::BIGINT AS n FROM {src} GROUP BY variant, detector, score),
{x} AS (SELECT variant, detector, score AS threshold,
  sum(p) OVER (PARTITION BY variant, detector ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY variant, detector ORDER BY score DESC) AS fp,
  sum(p) OVER (PARTITION BY variant, detector) AS ap, sum(n) OVER (PARTITION BY variant, detector) AS an FROM {x}_c)
"""
_YOUDEN = "SELECT variant, detector, -min(struct_pack(c := fp * ap + (ap - tp) * an, t := -threshold)).t AS threshold FROM {x} WHERE ap > 0 AND an > 0 GROUP BY variant, detector"
_LOW = """
SELECT variant, detector, min(score) AS low_fpr_threshold FROM (
  SELECT variant, detector, score, row_number() OVER (PARTITION BY variant, detector ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY variant, detector) AS n
  FROM {src} WHERE label = 0) WHERE i >= ceil(0.99::DOUBLE * (n - 1)) GROUP BY variant, detector"""
_CALIBRATION = (
    ", val AS (SELECT * FROM pred WHERE part = 'validation')" + _auc_sql("va", "variant, detector", "val")
    + ", dir AS (SELECT variant, detector, auc, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction FROM va WHERE auc IS NOT NULL)"
    + ", turned AS (SELECT v.* REPLACE (v.score * d.direction AS score) FROM val v JOIN dir d USING (variant, detector))"
    + _ROC.format(x="vr", src="turned")
    + ", cal AS (SELECT variant, detector, auc, direction, threshold, low_fpr_threshold FROM dir JOIN (" + _YOUDEN.format(x="vr") + ") USING (variant, detector) JOIN ("
    + _LOW.format(src="turned") + ") USING (variant, detector))"
)
_DRAWS = f"""
, src AS ({{src}}),
units AS (SELECT unit, row_number() OVER (ORDER BY sha256(unit)) - 1 AS k FROM (SELECT DISTINCT group_id AS unit FROM src)),
size AS (SELECT count(*) AS g FROM units),
drawn AS (SELECT rep, k, count(*) AS weight FROM (
  SELECT rep, ('0x' || substr(sha256('bootstrap-1:' || rep::VARCHAR || ':' || j::VARCHAR), 1, 12))::BIGINT % g AS k
  FROM size, range({REPETITIONS}) r(rep), LATERAL (SELECT unnest(range(g)) AS j)) GROUP BY rep, k),
weighted AS (SELECT variant, detector, rep, label, score, weight FROM src JOIN units ON group_id = unit JOIN drawn USING (k))
""" + _auc_sql("reps", "variant, detector, rep", "weighted", "weight")
_METRICS = (
    "WITH " + PREDICTIONS + _auc_sql("areas", "variant, detector", "pred") + _DRAWS.format(src="SELECT * FROM pred")
    + """, m AS (SELECT a.variant, a.detector, a.auc, low, high, greatest(high, 1 - low) AS upper FROM areas a JOIN (
      SELECT variant, detector, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM reps WHERE auc IS NOT NULL GROUP BY variant, detector)
      USING (variant, detector))"""
)
_PAIRED = (
    "WITH " + PREDICTIONS + _auc_sql("areas", "variant, detector", "pred") + _DRAWS.format(src="SELECT * FROM pred WHERE variant IN ('0.05', '0.01')")
    + """, w AS (SELECT detector, max(auc) FILTER (variant = '0.05') AS a, max(auc) FILTER (variant = '0.01') AS b FROM areas GROUP BY detector),
    r AS (SELECT detector, rep, max(auc) FILTER (variant = '0.05') AS a, max(auc) FILTER (variant = '0.01') AS b FROM reps GROUP BY detector, rep),
    d AS (SELECT detector, a - b AS d, greatest(a, 1 - a) - greatest(b, 1 - b) AS r FROM r WHERE a IS NOT NULL AND b IS NOT NULL),
    q AS (SELECT detector, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, quantile_cont(r, 0.025) AS robust_low, quantile_cont(r, 0.975) AS robust_high FROM d GROUP BY detector),
    x AS (SELECT detector, a, b, a - b AS delta, low, high, robust_low, robust_high FROM w JOIN q USING (detector))"""
)

ORACLE = {
    "a7_auc": "WITH " + PREDICTIONS + _auc_sql("x", "variant, detector", "pred") + "SELECT * FROM x",
    "a7_auc_by_part": "WITH " + PREDICTIONS + _auc_sql("x", "variant, detector, part", "pred") + "SELECT * FROM x",
    "w3_roc_points": "WITH " + PREDICTIONS + _ROC.format(x="x", src="pred") + "SELECT variant, detector, threshold, tp / ap AS tpr, fp / an AS fpr FROM x",
    "a8_youden": "WITH " + PREDICTIONS + _ROC.format(x="x", src="pred") + _YOUDEN.format(x="x"),
    "a10_low_fpr": "WITH " + PREDICTIONS + _LOW.format(src="pred"),
    "a9_calibration": "WITH " + PREDICTIONS + _CALIBRATION + "SELECT * FROM cal",
    "a11_error_rates": "WITH " + PREDICTIONS + _CALIBRATION
    + """, t AS (SELECT p.* REPLACE (score * direction AS score), threshold, low_fpr_threshold FROM pred p JOIN cal USING (variant, detector) WHERE part = 'test'),
    e AS (SELECT variant, detector, count(*) FILTER (label = 0) AS cover_images, count(*) FILTER (label = 1) AS stego_images,
      avg((score >= threshold)::INT) FILTER (label = 0) AS false_positive_rate, avg((score >= threshold)::INT) FILTER (label = 1) AS true_positive_rate,
      avg((score >= low_fpr_threshold)::INT) FILTER (label = 1) AS true_positive_rate_at_validation_1pct_fpr,
      avg((score >= low_fpr_threshold)::INT) FILTER (label = 0) AS actual_false_positive_rate_at_that_threshold FROM t GROUP BY variant, detector)
    SELECT *, (false_positive_rate + 1 - true_positive_rate) / 2 AS equal_prior_error FROM e""",
    "a13_bootstrap": _METRICS + "SELECT variant, detector, auc, low, high FROM m",
    "a12_robust": _METRICS + "SELECT variant, detector, greatest(auc, 1 - auc) AS orientation_robust_auc, upper AS orientation_robust_auc_upper_95, upper <= 0.55::DOUBLE AS passes_provisional_upper_bound FROM m",
    "q_p13_status": _METRICS + "SELECT variant, detector, CASE WHEN variant = 'auto' THEN 'control' WHEN upper <= 0.55::DOUBLE THEN 'pass' ELSE 'fail' END AS status FROM m",
    "q_p18_gate": _METRICS + "SELECT variant, bool_and(upper <= 0.55::DOUBLE) AS passes, min(low) > 0.75::DOUBLE AS control_ok FROM m GROUP BY variant",
    "a16_max_upper": _METRICS + "SELECT variant, max(upper) AS max_upper, arg_max(detector, upper) AS detector FROM m GROUP BY variant",
    "a14_paired_difference": _PAIRED + "SELECT detector, delta, low, high, robust_low, robust_high FROM x",
    "a15_verdict": _PAIRED
    + """SELECT detector, CASE WHEN low <= 0 AND high >= 0 THEN 'uncertain' WHEN high < 0 AND a >= 0.5 AND b >= 0.5 THEN 'improved' ELSE 'changed' END AS verdict FROM x""",
    "u1_labelled_union": "WITH " + PREDICTIONS + "SELECT variant, detector, label, count(*) AS n, sum(score) AS total FROM pred GROUP BY ALL",
}
