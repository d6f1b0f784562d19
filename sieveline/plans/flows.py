"""Whole experiments made of the queries: prepare, evaluate, compare, confirm, report; and the sinks read back.

The command line runs them by these names over a folder of tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import bookkeeping as bk
from sieveline.operators import corpus as corpus_ops
from sieveline.operators import evaluation as ev
from sieveline.operators.joins import skew_join
from sieveline.operators.report import write_report
from sieveline.operators.running import join_small
from sieveline.plans import bookkeeping, corpus, evaluation
from sieveline.plans.tables import PREDICTIONS, predictions, read
from sieveline.session import materialize, new_path
from sieveline.sources import files


def e_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared corpus: every image that is in a source group, its group, and the part the group falls to."""
    members = materialize(corpus.g1_components(spark, sf_dir).select(F.col("id").alias("image_id"), F.col("root").alias("group_id")), "members")
    groups = materialize(members.groupBy("group_id").agg(F.min("image_id").alias("first"), F.count(F.lit(1)).alias("size")), "groups")
    n = groups.agg(F.sum("size")).head()[0] or 0
    parts = corpus_ops.greedy_split(groups, {p: n * s // 100 for p, s in corpus.SHARES.items()})
    return skew_join(members, materialize(parts.select("group_id", "part"), "parts"), "group_id", "inner").select("image_id", "group_id", "part")


def e_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector on the test part at thresholds frozen on the validation part, with the area's interval and the pass rule."""
    by = evaluation.BY
    pred = materialize(predictions(spark, sf_dir), "predictions")
    frozen = materialize(ev.calibrate(pred.filter("part = 'validation'"), by), "calibration")
    turned = materialize(ev.oriented(pred.filter("part = 'test'"), frozen, by), "test")
    areas = join_small(ev.auc(turned, by).select(*by, "auc"), ev.bootstrap_interval(turned, "group_id", evaluation.REPETITIONS, by), by)
    out = join_small(ev.error_rates(turned, by), areas, by).withColumn("upper", ev.robust(F.col("low"), F.col("high")))
    return out.withColumn("passes", F.col("upper") <= ev.PASS_BOUND)


def e_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option 0.05 against 0.01 under the same draws, and what the difference establishes."""
    pred = materialize(predictions(spark, sf_dir), "predictions")
    diff = materialize(ev.paired_difference(pred, "group_id", "variant", "0.05", "0.01", evaluation.REPETITIONS, ["detector"]), "difference")
    areas = ev.auc(pred.filter("variant in ('0.05', '0.01')"), evaluation.BY).groupBy("detector")
    side = lambda v, name: F.max(F.when(F.col("variant") == v, F.col("auc"))).alias(name)
    out = join_small(diff, areas.agg(side("0.05", "a"), side("0.01", "b")), ["detector"])
    return out.withColumn("verdict", ev.verdict(F.col("delta"), F.col("low"), F.col("high"), F.col("a"), F.col("b")))


def e_confirm(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    """The gate of every variant; with strict, reading a variant that does not pass is an error."""
    gates = evaluation.q_p18_gate(spark, sf_dir)
    if strict:
        gates = bk.require(gates, ~(F.col("passes") | F.col("control_ok")), "a variant is neither within the bound nor a working control")
    return gates


#: Sections of the report, by query.
SECTIONS = {
    "Records": bookkeeping.o3_sorted_report,
    "Means of successful records": bookkeeping.a2_success_means,
    "Seconds": bookkeeping.a3_grouped_median,
    "Paired saving": bookkeeping.a5_paired_saving,
    "Completeness": bookkeeping.q_p16_completeness,
    "Detectors": e_evaluate,
    "Status": evaluation.q_p13_status,
    "Worst bounds": evaluation.a16_max_upper,
    "Comparison": e_compare,
    "Gate": e_confirm,
}


def report(spark: SparkSession, sf_dir: str, path: str) -> None:
    """All sections as one Markdown file."""
    write_report(path, "Results", {name: query(spark, sf_dir) for name, query in SECTIONS.items()})


def s5_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of records, written once as JSON and read back with their schema."""
    rows, path = bookkeeping.a1_counts(spark, sf_dir), new_path(spark, "json")
    files.create_json(rows, path)
    return files.read_json(spark, path, rows.schema)


def s6_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and sum of every vector, saved and loaded."""
    path = new_path(spark, "arrays")
    files.write_arrays(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return spark.read.parquet(path).select("vec_id", F.size("embedding").alias("n"), F.round(total, 4).alias("total"))


def s7_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions per variant and part, written by these and read back."""
    path = new_path(spark, "predictions")
    files.write_predictions(predictions(spark, sf_dir).drop("group_id"), path)
    return files.read_predictions(spark, path).groupBy("variant", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


def s9_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type, appended to a log in two steps."""
    rows, path = read(spark, sf_dir, "events", "event_id", "event_type"), new_path(spark, "log")
    for rest in (0, 1):
        files.append_json(rows.filter(F.pmod("event_id", F.lit(2)) == rest), path)
    return files.read_json(spark, path, rows.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (e_prepare, e_evaluate, e_compare, e_confirm, s5_json, s6_arrays, s7_predictions, s9_append_log)}

_SPLIT = corpus.ORACLE["w1_greedy_split"]
ORACLE = {
    "e_prepare": f"""WITH member AS ({corpus.ORACLE["g1_components"]}),
      g AS (SELECT root AS group_id, min(id) AS first, count(*) AS size FROM member GROUP BY root), {_SPLIT[_SPLIT.index("n AS (SELECT sum(size)") : _SPLIT.index("SELECT group_id, size, CASE")]},
      split AS ({_SPLIT[_SPLIT.index("SELECT group_id, size, CASE") :]})
      SELECT id AS image_id, root AS group_id, part FROM member JOIN split ON root = group_id""".replace("cum >= s2.e + n * 10 // 100)\n      ,", "cum >= s2.e + n * 10 // 100),"),
    "e_compare": evaluation._PAIRED + """SELECT detector, delta, low, high, robust_low, robust_high, a, b, CASE WHEN low <= 0 AND high >= 0 THEN 'uncertain'
      WHEN high < 0 AND a >= 0.5 AND b >= 0.5 THEN 'improved' ELSE 'changed' END AS verdict FROM x""",
    "e_confirm": evaluation.ORACLE["q_p18_gate"],
    "s5_json": bookkeeping.ORACLE["a1_counts"],
    "s6_arrays": "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total FROM embeddings",
    "s7_predictions": "WITH " + PREDICTIONS + "SELECT variant, part, count(*) AS n, sum(score) AS total FROM pred GROUP BY ALL",
    "s9_append_log": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
