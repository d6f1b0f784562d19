"""Queries on experiment records (inventory J1-J5, J8, J9, J11, J12, A1-A6, W4, W5, W8, O1, O3-O6, U3, U5, P14-P16) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.operators import bookkeeping as bk
from sieveline.operators.joins import skew_join
from sieveline.operators.running import join_small, quantiles
from sieveline.plans.tables import SAMPLES, image_groups, image_parts, read, samples

#: Columns that order runs recorded at one time, after the time itself; the same in the SQL.
RUN_TIE = ("strategy", "job_seconds", "changed_pixels", "failure")
OPTIONS = ("0.005", "0.01", "0.025", "0.05", "auto")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "sample_record")


def a1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and failed records per option."""
    return _records(spark, sf_dir).groupBy("option").agg(F.count(F.lit(1)).alias("completed"), F.count("failure").alias("rejected"))


def a2_success_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = _records(spark, sf_dir).filter("failure is null")  # P15
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    return ok.groupBy("option").agg(*map(mean, ("changed_pixels", "psnr", "balance_objective_before", "balance_objective_after")))


def a3_grouped_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).filter("seconds is not null").select("strategy", "option", "seconds")
    by = ["strategy", "option"]
    ends = rows.groupBy(*by).agg(F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"))
    return join_small(quantiles(rows, "seconds", [0.5], by).withColumnRenamed("q0", "median_seconds"), ends, by)


def a4_distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets that each option was run with, in order. Their number is that of the distinct values, hence the distinct first."""
    rows = _records(spark, sf_dir).filter("gross_bits is not null and option <> 'auto'").select("option", "gross_bits").distinct()
    return rows.groupBy("option").agg(F.concat_ws(",", F.array_sort(F.collect_set("gross_bits"))).alias("budgets"))


def j5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of an image at 0.05 and at auto, pair by pair: the n-th of one with the n-th of the other. A failed run loses its own pair."""
    rows = read(spark, sf_dir, "sample_record", "image", "option", "strategy", "job_seconds", "changed_pixels", "failure", "recorded_at")
    runs = bk.numbered_runs(rows.filter("image is not null and option in ('0.05', 'auto')"), ["image", "option"], "recorded_at", tie=RUN_TIE)
    ok = F.col("failure").isNull() & F.col("job_seconds").isNotNull()
    return bk.pair_up(runs, ["image", "strategy", "run"], "option", "0.05", "auto", ["job_seconds", "changed_pixels"], ok)


def a5_paired_saving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saving by part over the pairs of runs."""
    parts = image_parts(spark, sf_dir).withColumnRenamed("image_id", "image")
    return bk.paired_saving(skew_join(bk.materialize(j5_pairs(spark, sf_dir), "pairs"), parts, "image", "inner"), "job_seconds", ["part"])


def a6_stage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events play stages, users runs, days groups."""
    rows = read(spark, sf_dir, "events", "ts", "user_id", "event_type", "value").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return bk.stage_means(rows, ["day"], "user_id", "event_type", "value")


def w5_stage_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return bk.stage_seconds(rows, ["user_id"], "ts", "event_id").select("event_id", "user_id", "event_type", "seconds")


def w4_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    return bk.running_best(rows, ["user_id"], "ts", "event_id", "value").select("user_id", "event_id", "value")


def w8_alternating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the two rates for each task: turned round for every other one of a cover."""
    rows = read(spark, sf_dir, "sample_record", "image", "option").filter("image is not null and option is not null").distinct()
    index = F.row_number().over(Window.partitionBy("image").orderBy("option"))
    return rows.select("image", "option", F.when(index % 2 == 1, "0.05 first").otherwise("auto first").alias("turn"))


def j1_covers_and_stegos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with a part, and its sample at 0.05 where it has one."""
    stego = samples(spark, sf_dir).filter("option = '0.05'").groupBy("image_id").agg(F.min("changed_pixels").alias("changed_pixels"))
    return image_parts(spark, sf_dir).join(stego, "image_id", "left")


def j2_group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("image_id").distinct()
    return rows.join(image_groups(spark, sf_dir), "image_id")


def j3_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that have a sample of every option."""
    return bk.common_keys(samples(spark, sf_dir), "image_id", "option", OPTIONS)


def j4_key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bk.key_differences(samples(spark, sf_dir), "image_id", "option", "0.05", "auto")


def j8_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and options still to be done."""
    images = read(spark, sf_dir, "source_image", "image_id").distinct()
    tasks = images.select("image_id", F.explode(F.array(*map(F.lit, OPTIONS))).alias("option"))
    done = read(spark, sf_dir, "sample_record", "image", "option").withColumnRenamed("image", "image_id")
    return bk.pending(tasks, done, ["image_id", "option"])


def j9_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers with an accepted stego, by part."""
    accepted = samples(spark, sf_dir).filter("option = 'auto'").select("image_id")
    return image_parts(spark, sf_dir).join(accepted, "image_id", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("images"))


def j11_task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a benchmark: reference covers x options x repeats, unrolled from fixed lists."""
    covers = read(spark, sf_dir, "reference_cover", "image_id")
    grid = covers.select("image_id", F.explode(F.array(*map(F.lit, OPTIONS))).alias("option"))
    return grid.select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("repeat"))


def j12_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of one image and option: whether their results are the same, nulls equal to nulls."""
    rows = _records(spark, sf_dir).filter("image is not null and option is not null")
    same = F.count_distinct(F.struct(F.coalesce("changed_pixels", F.lit(-1)), F.coalesce("distortion", F.lit(-1)))) == 1
    return rows.groupBy("image", "option").agg(F.count(F.lit(1)).alias("runs"), same.alias("identical")).filter("runs > 1")


def o1_numeric_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images in the order of their numbers."""
    return read(spark, sf_dir, "source_image", "image_id").distinct().orderBy(F.col("image_id").cast("bigint"))


def o3_sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a1_counts(spark, sf_dir).orderBy(F.col("option").asc_nulls_last())


def o4_limited_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 pending jobs."""
    return j8_pending(spark, sf_dir).orderBy("image_id", "option").limit(100)


def o5_worst_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image with the most changed pixels per option, the smallest id of a tie."""
    order = F.max(F.struct("changed_pixels", (-F.col("image_id").cast("bigint")).alias("i")))
    top = samples(spark, sf_dir).groupBy("option").agg(order.alias("m"))
    return top.select("option", F.col("m.changed_pixels").alias("changed_pixels"), (-F.col("m.i")).cast("string").alias("image_id"))


def o6_shuffled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task grid in an order fixed by a hash of each task, which replaces a seeded shuffle."""
    key = F.sha2(F.concat_ws(":", F.lit("20260926"), "image_id", "option", F.col("repeat").cast("string")), 256)
    return j11_task_grid(spark, sf_dir).withColumn("turn_key", key).orderBy("turn_key")


def u3_common_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    pick = lambda o: rows.filter(F.col("option") == o).select("image_id")
    return pick("0.05").intersect(pick("auto"))


def u5_all_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates planned or run."""
    planned = read(spark, sf_dir, "manifest", "candidate_rates").select(F.explode("candidate_rates").alias("rate"))
    return planned.union(_records(spark, sf_dir).select("rate")).filter("rate is not null").distinct()


def q_p14_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File tag of each option and the parts of a variant's name."""
    rows = _records(spark, sf_dir).filter("option is not null and strategy is not null").select("option", "strategy").distinct()
    name = F.concat_ws("_", "strategy", F.replace("option", F.lit("."), F.lit("p")))
    rows = rows.select("option", F.replace("option", F.lit("."), F.lit("p")).alias("tag"), name.alias("variant"))
    return rows.withColumn("strategy", F.regexp_extract("variant", "(.*)_([^_]*)$", 1)).withColumn("rate_tag", F.substring_index("variant", "_", -1))


def q_p16_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness of each part at 0.05: images without a record, images with a success, and whether these are enough."""
    records = read(spark, sf_dir, "sample_record", "image", "option", "failure").filter("option = '0.05' and image is not null")
    done = records.groupBy(F.col("image").alias("image_id")).agg(F.bool_or(F.col("failure").isNull()).alias("ok"))
    return bk.completeness(image_parts(spark, sf_dir), done)


def s17_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed jobs per option, as found in the listing of their files."""
    rows = read(spark, sf_dir, "result_file", "path").select(F.regexp_extract("path", r"^artifacts/samples/[^/]+/([0-9]{9})/([^/.]+)\.json$", 2).alias("tag"))
    return rows.filter("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        a1_counts, a2_success_means, a3_grouped_median, a4_distinct_sets, j5_pairs, a5_paired_saving, a6_stage_means, w4_running_best, w5_stage_seconds,
        w8_alternating, j1_covers_and_stegos, j2_group_lookup, j3_common, j4_key_differences, j8_pending, j9_accepted, j11_task_grid, j12_identity,
        o1_numeric_sort, o3_sorted_report, o4_limited_jobs, o5_worst_case, o6_shuffled_tasks, u3_common_accepted, u5_all_rates, q_p14_tags, q_p16_completeness,
        s17_completed,
    )
}

_S = "WITH " + SAMPLES
_PAIRED = """
SELECT image, strategy, run, min(job_seconds) FILTER (option = '0.05') AS job_seconds_a, min(job_seconds) FILTER (option = 'auto') AS job_seconds_b,
  min(changed_pixels) FILTER (option = '0.05') AS changed_pixels_a, min(changed_pixels) FILTER (option = 'auto') AS changed_pixels_b
FROM (SELECT *, row_number() OVER (PARTITION BY image, option ORDER BY recorded_at NULLS LAST, strategy NULLS FIRST, job_seconds NULLS FIRST, changed_pixels NULLS FIRST, failure NULLS FIRST) - 1 AS run
  FROM (SELECT DISTINCT image, option, strategy, job_seconds, changed_pixels, failure, recorded_at FROM sample_record WHERE image IS NOT NULL AND option IN ('0.05', 'auto')))
GROUP BY image, strategy, run HAVING count(DISTINCT option) = 2 AND bool_and(failure IS NULL AND job_seconds IS NOT NULL)"""
_OPTIONS = "(SELECT unnest(['0.005', '0.01', '0.025', '0.05', 'auto']) AS option)"
_PENDING = f"""SELECT image_id, option FROM (SELECT DISTINCT image_id FROM source_image), {_OPTIONS}
WHERE (image_id, option) NOT IN (SELECT (image, option) FROM sample_record WHERE image IS NOT NULL AND option IS NOT NULL)"""
_GRID = f"SELECT image_id, option, repeat::INT AS repeat FROM reference_cover, {_OPTIONS}, range(3) t(repeat)"

ORACLE = {
    "a1_counts": "SELECT option, count(*) AS completed, count(failure) AS rejected FROM sample_record GROUP BY option",
    "a2_success_means": """SELECT option, avg(changed_pixels) AS mean_changed_pixels, avg(psnr) AS mean_psnr, avg(balance_objective_before) AS mean_balance_objective_before,
      avg(balance_objective_after) AS mean_balance_objective_after FROM sample_record WHERE failure IS NULL GROUP BY option""",
    "a3_grouped_median": "SELECT strategy, option, quantile_cont(seconds, 0.5) AS median_seconds, min(seconds) AS min_seconds, max(seconds) AS max_seconds FROM sample_record WHERE seconds IS NOT NULL GROUP BY ALL",
    "a4_distinct_sets": "SELECT option, array_to_string(list_sort(list(DISTINCT gross_bits)), ',') AS budgets FROM sample_record WHERE gross_bits IS NOT NULL AND option <> 'auto' GROUP BY option",
    "j5_pairs": _PAIRED,
    "a5_paired_saving": _S + f""", s AS (SELECT part, 100 * (job_seconds_a - job_seconds_b) / job_seconds_a AS s FROM ({_PAIRED}) JOIN image_parts ON image = image_id WHERE job_seconds_a <> 0)
      SELECT part, count(*) AS complete_pairs, quantile_cont(s, 0.5) AS median_saving, min(s) AS min_saving, max(s) AS max_saving, count(*) FILTER (s > 0) AS second_faster FROM s GROUP BY part""",
    "a6_stage_means": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, * FROM events), r AS (SELECT day, count(DISTINCT user_id) AS n FROM e GROUP BY day)
      SELECT day, event_type AS stage, sum(value) / any_value(n) AS mean FROM e JOIN r USING (day) WHERE event_type IS NOT NULL GROUP BY day, event_type""",
    "w5_stage_seconds": "SELECT event_id, user_id, event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6::DOUBLE AS seconds FROM events",
    "w4_running_best": """SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
      WHERE value IS NOT NULL AND (b IS NULL OR value > b)""",
    "w8_alternating": """SELECT image, option, CASE WHEN row_number() OVER (PARTITION BY image ORDER BY option) % 2 = 1 THEN '0.05 first' ELSE 'auto first' END AS turn
      FROM (SELECT DISTINCT image, option FROM sample_record WHERE image IS NOT NULL AND option IS NOT NULL)""",
    "j1_covers_and_stegos": _S + "SELECT image_id, part, changed_pixels FROM image_parts LEFT JOIN (SELECT image_id, min(changed_pixels) AS changed_pixels FROM samples WHERE option = '0.05' GROUP BY image_id) USING (image_id)",
    "j2_group_lookup": _S + "SELECT DISTINCT image_id, group_id FROM samples JOIN image_groups USING (image_id)",
    "j3_common": _S + "SELECT image_id FROM samples GROUP BY image_id HAVING count(DISTINCT option) FILTER (option IN ('0.005', '0.01', '0.025', '0.05', 'auto')) = 5",
    "j4_key_differences": _S + """SELECT image_id, CASE WHEN bool_or(option = '0.05') THEN '0.05' ELSE 'auto' END AS side FROM samples WHERE option IN ('0.05', 'auto')
      GROUP BY image_id HAVING count(DISTINCT option) = 1""",
    "j8_pending": _PENDING,
    "j9_accepted": _S + "SELECT part, count(*) AS images FROM image_parts WHERE image_id IN (SELECT image_id FROM samples WHERE option = 'auto') GROUP BY part",
    "j11_task_grid": _GRID,
    "j12_identity": """SELECT image, option, count(*) AS runs, count(DISTINCT (coalesce(changed_pixels, -1), coalesce(distortion, -1))) = 1 AS identical
      FROM sample_record WHERE image IS NOT NULL AND option IS NOT NULL GROUP BY image, option HAVING count(*) > 1""",
    "o1_numeric_sort": "SELECT DISTINCT image_id FROM source_image ORDER BY image_id::BIGINT",
    "o3_sorted_report": "SELECT option, count(*) AS completed, count(failure) AS rejected FROM sample_record GROUP BY option ORDER BY option NULLS LAST",
    "o4_limited_jobs": _PENDING + " ORDER BY image_id, option LIMIT 100",
    "o5_worst_case": _S + "SELECT option, max(changed_pixels) AS changed_pixels, min(image_id) FILTER (changed_pixels = m) AS image_id FROM (SELECT *, max(changed_pixels) OVER (PARTITION BY option) AS m FROM samples) GROUP BY option",
    "o6_shuffled_tasks": f"SELECT image_id, option, repeat, sha256('20260926:' || image_id || ':' || option || ':' || repeat::VARCHAR) AS turn_key FROM ({_GRID}) ORDER BY turn_key",
    "u3_common_accepted": _S + "SELECT image_id FROM samples WHERE option = '0.05' INTERSECT SELECT image_id FROM samples WHERE option = 'auto'",
    "u5_all_rates": "SELECT unnest(candidate_rates) AS rate FROM manifest UNION SELECT rate FROM sample_record WHERE rate IS NOT NULL",
    "q_p14_tags": """WITH t AS (SELECT DISTINCT option, replace(option, '.', 'p') AS tag, strategy || '_' || replace(option, '.', 'p') AS variant FROM sample_record WHERE option IS NOT NULL AND strategy IS NOT NULL)
      SELECT *, regexp_extract(variant, '(.*)_([^_]*)$', 1) AS strategy, regexp_extract(variant, '(.*)_([^_]*)$', 2) AS rate_tag FROM t""",
    "q_p16_completeness": _S + """SELECT part, count(*) FILTER (ok IS NULL) AS missing, count(*) FILTER (ok) AS usable, count(*) FILTER (ok) >= 40 AS enough
      FROM image_parts LEFT JOIN (SELECT image AS image_id, bool_or(failure IS NULL) AS ok FROM sample_record WHERE option = '0.05' AND image IS NOT NULL GROUP BY image) USING (image_id) GROUP BY part""",
    "s17_completed": r"SELECT tag, count(*) AS files FROM (SELECT regexp_extract(path, '^artifacts/samples/[^/]+/([0-9]{9})/([^/.]+)\.json$', 2) AS tag FROM result_file) WHERE tag <> '' GROUP BY tag",
}
