"""Experiment records: what is done, what is pending, paired comparisons of variants and their timings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.joins import free_name
from sieveline.operators.running import join_small, quantiles, running_totals
from sieveline.session import materialize


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns that may hold nulls, nulls equal to nulls; the keys come from the left."""
    names = {k: free_name(f"_right_{k}", left, right) for k in keys}
    right, cond = right.withColumnsRenamed(names), F.lit(True)
    for k, r in names.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    return left.join(right, cond, how).drop(*names.values())


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks that no finished record answers; tasks with a null key are always pending."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pair_up(rows: DataFrame, keys: Sequence[str], variant: str, first: str, second: str, values: Sequence[str], ok: Column | None = None) -> DataFrame:
    """One row per key that has exactly the two variants, all rows of both being ok.

    Columns <value>_a and <value>_b hold the first and second variant's value, of repeated rows the
    smallest. One aggregation does what a self-join would: nothing is shuffled twice.
    """
    ok = F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))
    side = lambda v, c, n: F.min(F.when(F.col(variant) == v, F.col(c))).alias(n)
    agg = rows.groupBy(*keys).agg(
        F.bool_and(ok & F.col(variant).isNotNull() & F.coalesce(F.col(variant).isin(first, second), F.lit(False))).alias("_ok"),
        F.count_distinct(F.when(F.col(variant).isin(first, second), F.col(variant))).alias("_n"),
        *[x for c in values for x in (side(first, c, f"{c}_a"), side(second, c, f"{c}_b"))],
    )
    return agg.filter("_ok and _n = 2").drop("_ok", "_n")


def numbered_runs(rows: DataFrame, by: Sequence[str], time: str, name: str = "run", tie: Sequence[str] = ()) -> DataFrame:
    """Distinct rows with their number, from 0, within the group in the order of a timestamp (null comes last), then of the tie columns.

    A record written twice is one run. Hot groups are spread over ranges of the order.
    """
    at, last, one = (free_name(x, rows) for x in ("_at", "_tie", "_one"))
    order = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(2**62))
    keyed = rows.distinct().withColumns({at: order, last: F.struct(*tie) if tie else F.xxhash64(*rows.columns), one: F.lit(1).cast("bigint")})
    return running_totals(keyed, at, [one], by, tie=last).withColumn(name, F.col(f"{one}_before")).select(*rows.columns, name)


def paired_saving(pairs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Saving of the second variant in per cent, pair by pair: median, least, most and how often it is positive.

    The median is that of the pairs' percentages, not of the medians. Pairs with a null or zero first value
    are left out.
    """
    a, b = F.col(f"{value}_a"), F.col(f"{value}_b")
    rows = materialize(pairs.filter((a != 0) & b.isNotNull()).select(*by, (100 * (a - b) / a).alias("_s")), "savings")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("complete_pairs"), F.min("_s").alias("min_saving"), F.max("_s").alias("max_saving"), F.count_if(F.col("_s") > 0).alias("second_faster")
    )
    return join_small(quantiles(rows, "_s", [0.5], by).withColumnRenamed("q0", "median_saving"), counts, by)


def stage_means(rows: DataFrame, by: Sequence[str], run: str, stage: str, value: str) -> DataFrame:
    """Mean of each stage over all runs of a group, a run without the stage counting 0: rows (by, stage, mean)."""
    runs = rows.groupBy(*by).agg(F.count_distinct(run).alias("_runs"))
    sums = rows.filter(F.col(stage).isNotNull()).groupBy(*by, F.col(stage).alias("stage")).agg(F.sum(value).alias("_sum"))
    return sums.join(runs, list(by)).select(*by, "stage", (F.col("_sum") / F.col("_runs")).alias("mean"))


def stage_seconds(rows: DataFrame, by: Sequence[str], at: str, tie: str, bucket: str = "day") -> DataFrame:
    """Seconds from each stage's start to the next one's; null for the last of a run and where `at` is null.

    A run is cut into buckets of time, so that a run of any length is spread over tasks: within a bucket the
    next start is the next row's, at its end the first one of the next bucket.
    """
    when, cut, nxt = (free_name(n, rows) for n in ("_at", "_bucket", "_next"))
    rows = rows.drop("seconds").withColumn(when, F.col(at).cast("timestamp")).withColumn(cut, F.date_trunc(bucket, F.col(when)))
    keys = [*by, cut]
    firsts = rows.filter(F.col(when).isNotNull()).groupBy(*keys).agg(F.min(when).alias("_first"))
    # one row per run and bucket
    nexts = firsts.select(*keys, F.lead("_first").over(Window.partitionBy(*by).orderBy(cut)).alias(nxt))
    out = join_nullsafe(rows, nexts, keys, "left")
    follow = F.coalesce(F.lead(when).over(Window.partitionBy(*keys).orderBy(when, tie)), F.col(nxt))
    out = out.withColumn("seconds", (F.unix_micros(follow) - F.unix_micros(when)) / 1e6)
    return out.drop(when, cut, nxt)


def running_best(rows: DataFrame, by: Sequence[str], at: str, tie: str, value: str, bucket: str = "day") -> DataFrame:
    """Rows that beat everything before them in their group (strictly, so the first of a tie wins).

    Groups are cut into buckets of time as in `stage_seconds`; a bucket starts from the best of those before.
    Rows of null time come first; null values never beat anything.
    """
    cut, start, inside = (free_name(n, rows) for n in ("_bucket", "_start", "_inside"))
    rows = rows.withColumn(cut, F.date_trunc(bucket, F.col(at).cast("timestamp")))
    keys = [*by, cut]
    before = Window.partitionBy(*by).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    # one row per group and bucket
    best = rows.groupBy(*keys).agg(F.max(value).alias("_best")).select(*keys, F.max("_best").over(before).alias(start))
    inner = Window.partitionBy(*keys).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    out = join_nullsafe(rows.withColumn(inside, F.max(value).over(inner)), best, keys)
    top = F.greatest(inside, start)  # nulls are passed over
    out = out.filter(F.col(value).isNotNull() & (top.isNull() | (F.col(value) > top)))
    return out.drop(cut, start, inside)


def common_keys(rows: DataFrame, key: str, variant: str, variants: Sequence[str]) -> DataFrame:
    """Keys that every one of the variants has."""
    ok = rows.filter(F.col(variant).isin(*variants)).groupBy(key).agg(F.count_distinct(variant).alias("_n"))
    return ok.filter(F.col("_n") == len(variants)).select(key)


def key_differences(rows: DataFrame, key: str, variant: str, first: str, second: str) -> DataFrame:
    """Keys that only one of two variants has: rows (key, side); empty when the two are identical."""
    has = lambda v: F.bool_or(F.col(variant) == v)
    both = rows.filter(F.col(variant).isin(first, second)).groupBy(key).agg(has(first).alias("_a"), has(second).alias("_b"))
    return both.filter("_a <> _b").select(key, F.when(F.col("_a"), first).otherwise(second).alias("side"))


#: The least usable images of a part that an evaluation is made of.
LEAST_USABLE = 40


def completeness(parts: DataFrame, done: DataFrame, least: int = LEAST_USABLE) -> DataFrame:
    """Rows (part, missing, usable, enough): images of each part without a record, with a success, and whether these are at least `least`.

    parts: image_id, part; done: one row (image_id, ok) per image with a record.
    """
    rows = parts.join(done, "image_id", "left").groupBy("part").agg(F.count_if(F.col("ok").isNull()).alias("missing"), F.count_if("ok").alias("usable"))
    return rows.withColumn("enough", F.col("usable") >= least)


def require_complete(report: DataFrame) -> DataFrame:
    """A completeness report unchanged; reading it fails where a part lacks images or has too few."""
    lacking = require(report, F.col("missing") > 0, "images have no record")
    return require(lacking, ~F.col("enough"), "too few usable images")


def require(rows: DataFrame, problem: Column, message: str) -> DataFrame:
    """rows unchanged; reading them fails with the message where problem holds."""
    return rows.filter(F.when(problem, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
