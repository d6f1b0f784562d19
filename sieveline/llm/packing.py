"""Problem 6: documents into containers of fixed capacity, by sum-of-squares packing.

Documents arrive one by one; each goes to the fill level (or a new container) that keeps the sum of the
squared counts of partly filled containers least. A level array holds these counts. The documents are dealt
to shards by a hash, each shard is packed in one task, and only ids and sizes travel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.session import materialize

CAPACITY = 4_096
#: Documents that one task packs.
SHARD_ITEMS = 25_000


def pack_shard(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container (0, 1, ...) of each size, taken in order; sizes are 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(sizes), np.int64), 0
    # the growth of the sum of squares is twice (count[h + s] - count[h]) + 2; a full container leaves the array
    for k, s in enumerate(sizes.tolist()):
        best, best_cost, to = -1, 2 * int(count[s]) + 1 if s < capacity else 0, s
        if s < capacity:
            here = count[1 : capacity - s + 1]
            cost = 2 * (count[1 + s :] - here) + 2
            cost[-1] = 1 - 2 * here[-1]
            cost = np.where(here > 0, cost, best_cost + 1)
            h = int(cost.argmin())
            # a tie goes to the started container
            if here[h] > 0 and cost[h] <= best_cost:
                best, to = h + 1, h + 1 + s
        if best < 0:
            bin_ = made
            made += 1
        else:
            bin_ = open_[best].pop()
            count[best] -= 1
        out[k] = bin_
        if to < capacity:
            open_[to].append(bin_)
            count[to] += 1
    return out


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        bins = pack_shard(pdf["tokens"].to_numpy(), capacity)
        names = "s" + pdf["shard"].astype(str) + "-" + pd.Series(bins, index=pdf.index).astype(str)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "tokens": pdf["tokens"], "container": names})

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Rows (doc_id, piece, tokens, container) for sizes (doc_id bigint, tokens bigint).

    A document is one piece (0) unless it exceeds the capacity; then it is cut into full pieces, each a
    container of its own, and one last piece that is packed like a document. Documents of null or no tokens
    take no space and get no row. doc_id should be unique; repeated ones are packed one by one.
    """
    rest, full = F.col("tokens") % capacity, F.floor(F.col("tokens") / capacity).cast("bigint")
    some = materialize(sizes.select("doc_id", "tokens").filter("tokens > 0"), "sizes")
    whole = (
        some.filter(F.col("tokens") >= capacity)
        .select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece"))
        .select("doc_id", "piece", F.lit(capacity).cast("bigint").alias("tokens"), F.format_string("d%d-%d", "doc_id", "piece").alias("container"))
    )
    items = some.select("doc_id", full.alias("piece"), rest.alias("tokens")).filter("tokens > 0")
    shards = max(1, math.ceil(items.count() / shard_items))
    packed = (
        items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_pack(capacity), "doc_id bigint, piece bigint, tokens bigint, container string")
    )
    return whole.unionByName(packed)
