"""Running totals and exact quantiles over an order without putting a whole group into one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import materialize, release

#: Rows a range of the order should hold; their number follows from the data.
ROWS = 500_000


def running_totals(df: DataFrame, order: str, values: Sequence[str], by: Sequence[str] = (), descending: bool = False, tie: str | None = None, rows: int = ROWS) -> DataFrame:
    """df with, for each of values, <value>_before: the sum over rows of the same group that come earlier.

    Rows are ordered by the numeric column `order`, not null, then by `tie`; together unique in a group. The table is
    cut into ranges of about `rows` rows by group and order; each range is summed as a window of its own
    and starts from the totals of the ranges before it, so a group of any size is spread over as many tasks as
    it needs. Nulls in values count as 0; by may hold nulls. An empty table stays empty.
    """
    by = list(by)
    table = materialize(df, "ranked")
    ranges = max(1, math.ceil(table.count() / rows))
    first = F.col(order).desc() if descending else F.col(order).asc()
    keys = [*by, "_range"]
    parted = table.withColumn("_range", F.lit(0))
    if ranges > 1:
        parted = materialize(table.repartitionByRange(ranges, *by, first, *([tie] if tie else [])).withColumn("_range", F.spark_partition_id()), "ranges")
        release(table)
    inner = Window.partitionBy(*keys).orderBy(first, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside = parted.withColumns({f"_i_{v}": zero(F.sum(v).over(inner)) for v in values})
    if ranges == 1:
        return inside.select(*df.columns, *[F.col(f"_i_{v}").alias(f"{v}_before") for v in values])
    totals = parted.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # one row per group and range
    outer = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[zero(F.sum(f"_t_{v}").over(outer)).alias(f"_o_{v}") for v in values])
    offsets = offsets.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_o_{v}" for v in values])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = inside.join(offsets, cond).withColumns({f"{v}_before": F.col(f"_i_{v}") + F.col(f"_o_{v}") for v in values})
    return out.select(*df.columns, *[f"{v}_before" for v in values])


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """Exact linear quantiles of a group: rows (by, q0, q1, ...), one column per share.

    The elements at floor and ceil of share * (n - 1) are picked by running counts over the distinct values, so no
    task holds a group's values. Null values do not count; a group without others has no row.
    """
    counts = materialize(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "values")
    ranked = running_totals(counts, "_v", ["_n"], by, rows=rows)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    both = join_small(ranked, total, by)
    upto, at = F.col("_n_before") + F.col("_n"), lambda q: F.lit(float(q)) * (F.col("_all") - 1)
    low = lambda q: F.min(F.when(upto > F.floor(at(q)), F.col("_v")))
    high = lambda q: F.min(F.when(upto > F.ceil(at(q)), F.col("_v")))
    frac = lambda q: F.max(at(q) - F.floor(at(q)))
    return both.groupBy(*by).agg(*[(low(q) + (high(q) - low(q)) * frac(q)).alias(f"q{i}") for i, q in enumerate(shares)])


def join_small(left: DataFrame, right: DataFrame, by: Sequence[str], most: int = 10_000) -> DataFrame:
    """Inner join on columns that may hold nulls; without columns the right side is a single row.

    The right side, one row a group, is broadcast where counting shows that it has at most `most` rows.
    """
    right = materialize(right, "groups")
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    names = {c: f"_r_{c}" for c in by}
    right, cond = right.withColumnsRenamed(names), F.lit(True)
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(names[c]))
    if right.limit(most + 1).count() <= most:
        right = F.broadcast(right)
    return left.join(right, cond).drop(*names.values())
