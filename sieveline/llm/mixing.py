"""Problem 7: sources mixed to target shares of the total size, small ones repeated up to a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.joins import small_or_skew_join
from sieveline.session import materialize

SEED = "mix-1"


def source_name(col: Column | str) -> Column:
    """A source's name as the targets have it: trimmed, lower case."""
    return F.lower(F.trim(F.col(col) if isinstance(col, str) else col))


def repetition_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: size, wanted tokens, rate, attainable share, and whether the target can be reached.

    sizes: (source, tokens), names written loosely; targets: (source, target_share, max_repeats). Tokens are
    summed per source before the shuffle. A source is reachable when its size times max_repeats comes to its share of the total
    size; the others are used max_repeats times. What those hold is the rest of a mixture in which every reachable source
    has exactly its target share, and that is the mixture's size: the capped sources' tokens over what the shares of
    the reachable ones leave. Should the capped ones hold nothing, the reachable ones share the total size in proportion. Sources without
    a target and null sources are left out; a null share counts as 0, a null cap as no repetition. A target
    named twice counts by its greatest values.
    """
    size = sizes.groupBy(source_name("source").alias("source")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("squares"))
    goal = targets.groupBy(source_name("source").alias("source")).agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")
    )
    goal = goal.filter("source is not null").join(size, "source", "left").withColumn("size", F.coalesce("tokens", F.lit(0))).drop("tokens")
    total = goal.agg(F.sum("size").alias("total"))
    goal = goal.crossJoin(F.broadcast(total)).withColumn("wanted", F.col("target_share") * F.col("total"))  # one row
    goal = materialize(goal.withColumn("reachable", F.col("size") * F.col("max_repeats") >= F.col("wanted")), "goals")
    held = F.coalesce(F.sum(F.when(~F.col("reachable"), F.col("size") * F.col("max_repeats"))), F.lit(0)).alias("held")
    left = goal.agg(held, F.coalesce(F.sum(F.when(F.col("reachable"), F.col("target_share"))), F.lit(0.0)).alias("reached"), F.max("total").alias("all"))
    whole = F.when((F.col("held") > 0) & (F.col("reached") < 1), F.least(F.col("held") / (1 - F.col("reached")), F.col("all").cast("double"))).otherwise(F.col("all").cast("double"))
    share = F.when(F.col("held") > 0, F.col("target_share")).when(F.col("reached") > 0, F.col("target_share") / F.greatest("reached", F.lit(1e-12))).otherwise(0.0)
    rows = goal.crossJoin(F.broadcast(left)).withColumn("mixture", whole)  # one row
    # a reachable source's share of the mixture never asks for more than its cap: the mixture is no larger than the total
    asked = F.least(share * F.col("mixture") / F.col("size"), F.col("max_repeats").cast("double"))
    rate = F.when(F.col("size") <= 0, 0.0).when(F.col("reachable"), asked).otherwise(F.col("max_repeats").cast("double"))
    rows = rows.withColumn("rate", rate).withColumn("attainable_share", F.when(F.col("mixture") > 0, F.col("rate") * F.col("size") / F.col("mixture")).otherwise(0.0))
    part = F.col("rate") - F.floor("rate")
    # deviation of the share that the draws of the fractions cause
    rows = rows.withColumn("share_deviation", F.when(F.col("mixture") > 0, F.sqrt(F.coalesce("squares", F.lit(0.0)) * part * (1 - part)) / F.col("mixture")).otherwise(0.0))
    return rows.select("source", "target_share", "max_repeats", "size", "wanted", "reachable", "rate", "attainable_share", "share_deviation")


def copies(sizes: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """How often each document enters the mixture: rows (doc_id, source, tokens, copies), copies above 0.

    floor(rate) times and, with the probability of the fraction, once more by a hash of its id. rates: from
    `repetition_rates`. Documents of other sources, of null ids and of no tokens do not appear.
    """
    docs = sizes.select("doc_id", source_name("source").alias("source"), "tokens").filter("doc_id is not null and tokens > 0")
    rated = small_or_skew_join(docs, rates.select("source", "rate"), "source", "inner")
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    times = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.withColumn("copies", times.cast("int")).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def mix(sizes: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture: rows (doc_id, source, tokens, copy), one for each time a document enters it."""
    return copies(sizes, rates, seed).select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def shares(used: DataFrame, rates: DataFrame) -> DataFrame:
    """Target, attainable and reached share of every source, out of the `copies` that enter the mixture.

    short tells that the mixture holds every document of the source as often as allowed and still less than the
    source's share of the total size.
    """
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
    total = got.agg(F.sum("mixed").alias("total"))
    rows = rates.join(got, "source", "left").crossJoin(F.broadcast(total)).withColumn("mixed", F.coalesce("mixed", F.lit(0)))  # one row
    short = (F.col("mixed") >= F.col("size") * F.col("max_repeats")) & (F.col("mixed") < F.col("wanted"))
    return rows.select("source", "target_share", "attainable_share", "share_deviation", "size", "rate", "reachable", "mixed", F.coalesce(F.col("mixed") / F.col("total"), F.lit(0.0)).alias("share"), short.alias("short"))
