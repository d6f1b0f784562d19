"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds at least 1/HEAVY_SHARE of the rows, so at most HEAVY_SHARE keys are.
HEAVY_SHARE = 256


def heavy_keys(df: DataFrame, key: str, share: int = HEAVY_SHARE) -> DataFrame:
    """Keys that hold at least 1/share of the rows with a key: never more than `share` rows.

    Counts are combined before the shuffle; a null key is never heavy, since it joins with nothing.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    # one row with the total: bounded, hence the broadcast
    return counts.join(F.broadcast(total), F.col("_n") * F.lit(share) >= F.col("_total")).select(key)


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, however a caller named theirs."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base in taken:
        base += "_"
    return base


def small_or_skew_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "left", most: int = 10_000) -> DataFrame:
    """The same as `skew_join`; dim is broadcast where counting shows that it has at most `most` rows."""
    dim = dim.drop(*[c for c in dim.columns if c != key and c in facts.columns])
    if dim.limit(most + 1).count() <= most:
        return facts.join(F.broadcast(dim), key, how)
    return skew_join(facts, dim, key, how)


def skew_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "left", share: int = HEAVY_SHARE, heavy: DataFrame | None = None) -> DataFrame:
    """Join facts with dim, which has at most one row per key, without a hot reducer.

    The dim rows of heavy keys number at most `share`, so they are broadcast; all other keys hold less
    than 1/share of the rows each and are shuffled as usual. how: inner, left or left_semi.
    Facts with a null key are kept by left and dropped by the others; a column of dim that facts have too
    is left to facts. dim is read twice, facts three times: pass written tables or cheap scans. heavy: the
    heavy keys, where the caller has counted them already.
    """
    dim = dim.drop(*[c for c in dim.columns if c != key and c in facts.columns])
    mark = free_name("_hot", facts, dim)
    hot = (heavy_keys(facts, key, share) if heavy is None else heavy.select(key)).withColumn(mark, F.lit(True))
    # at most `share` rows by the definition of heavy_keys
    marked = facts.join(F.broadcast(hot), key, "left")
    dim_hot = dim.join(F.broadcast(hot.select(key)), key, "left_semi")
    a = marked.filter(F.col(mark)).drop(mark).join(F.broadcast(dim_hot), key, how)
    b = marked.filter(F.col(mark).isNull()).drop(mark).join(dim, key, how)
    return a.unionByName(b)
