"""Problem 2: splits that keep related records together, by largest-differencing balance.

Groups are weighed by their records. The weights are packed into many equal bins by the differencing
method: the two partial solutions with the widest spread are combined again and again, the heaviest bin of
one with the lightest of the other. This is done in chunks of a bounded number of groups; the bins of all
chunks are the items of the next level, until one chunk is left. Whole bins then go to the splits by
target share. Only the last level's bins, a fixed number, reach the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.components import connected_components
from sieveline.operators.joins import skew_join
from sieveline.session import materialize

BINS = 256
#: Groups that one task packs.
CHUNK_ITEMS = 20_000


def balance(weights: np.ndarray, bins: int) -> np.ndarray:
    """The bin (0 to bins-1) of each weight, by largest differencing.

    Every weight starts as a partial solution of one filled bin. The two partial solutions of the widest
    spread are combined until one is left. Ties go by position, so the result is the same in every run; zero weights are dealt like others.
    """
    weights = np.asarray(weights, np.int64)
    # a node is a slot of a partial solution; merged slots point to the node that holds both
    up: list[int] = list(range(len(weights)))
    heap = [(-w, k, np.array([w]), np.array([k])) for k, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        _, _, sums_a, nodes_a = heapq.heappop(heap)
        _, _, sums_b, nodes_b = heapq.heappop(heap)
        # slots beyond the listed ones are empty: the heaviest of one fill those of the other, in shared slots heavy meets light
        both = max(0, len(sums_a) + len(sums_b) - bins)
        k, j = len(sums_a) - both, len(sums_b) - both
        new = len(up) + np.arange(both)
        for x, y, z in zip(nodes_a[k:].tolist(), nodes_b[j:][::-1].tolist(), new.tolist()):
            up[x] = up[y] = z
        up.extend(new.tolist())
        sums = np.concatenate((sums_a[:k], sums_a[k:] + sums_b[j:][::-1], sums_b[:j]))
        by = np.argsort(-sums, kind="stable")
        sums, nodes = sums[by], np.concatenate((nodes_a[:k], new, nodes_b[:j]))[by]
        least = sums[-1] if len(sums) == bins else 0
        heapq.heappush(heap, (int(least - sums[0]), tick, sums, nodes))
        tick += 1
    out = np.empty(len(weights), np.int64)
    if heap:
        root = np.array(up)
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
        bin_of = np.empty(len(up), np.int64)
        bin_of[heap[0][3]] = np.arange(len(heap[0][3]))
        out = bin_of[root[: len(weights)]]
    return out


def _packer(bins: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit", kind="stable")
        to = balance(pdf["weight"].to_numpy(), bins)
        return pd.DataFrame({"unit": pdf["unit"], "up": pdf["chunk"].to_numpy() * bins + to, "weight": pdf["weight"]})

    return pack


def equal_bins(items: DataFrame, bins: int = BINS, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """Pack items (unit, weight bigint) into bins of nearly equal weight: rows (unit, bin bigint, weight).

    unit must be unique and not null. Null weights count as 0. No items give no rows. A chunk takes at least
    four times as many items as there are bins, so that every level has far fewer items than the one before.
    """
    chunk_items = max(chunk_items, 4 * bins)
    items = materialize(items.select("unit", F.coalesce(F.col("weight").cast("bigint"), F.lit(0)).alias("weight")), "items")
    n, levels = items.count(), []
    while True:
        chunks = max(1, math.ceil(n / chunk_items))
        kind = dict(items.dtypes)["unit"]
        packed = materialize(
            items.withColumn("chunk", F.pmod(F.xxhash64("unit"), F.lit(chunks)))
            .groupBy("chunk")
            .applyInPandas(_packer(bins), f"unit {kind}, up bigint, weight bigint"),
            "packed",
        )
        levels.append(packed)
        if chunks == 1:
            break
        items = packed.groupBy(F.col("up").alias("unit")).agg(F.sum("weight").alias("weight"))
        items = materialize(items, "items")
        n = items.count()
    found = levels.pop()
    while levels:
        # each bin of a chunk holds an equal share of the chunk, so no key is hot
        found = levels.pop().join(found.select(F.col("unit").alias("up"), F.col("up").alias("top")), "up").select("unit", F.col("top").alias("up"), "weight")
    return found.select("unit", F.col("up").alias("bin"), "weight")


def allocate(sums: Mapping[int, int], shares: Mapping[str, float]) -> dict[int, str]:
    """Whole bins to parts: each bin, heaviest first, to the part that lacks most of its share."""
    total, norm = sum(sums.values()), sum(shares.values())
    lack = {p: total * s / norm for p, s in shares.items()}
    out = {}
    for b in sorted(sums, key=lambda x: (-sums[x], x)):
        part = max(sorted(lack), key=lambda p: lack[p])
        out[b] = part
        lack[part] -= sums[b]
    return out


def members(groups: DataFrame) -> DataFrame:
    """Distinct rows (image_id, group_id, unit) of a table of image_id and group_id.

    A unit is what must stay together: a group, or all groups that share an image. An image without a
    group is a unit of its own, named by its id; where that is also a group's name it stays with that
    group. Null image ids are dropped.
    """
    own = groups.select("image_id", "group_id").filter("image_id is not null").distinct()
    own = materialize(own.withColumn("key", F.coalesce("group_id", "image_id")), "members")
    many = own.groupBy("image_id").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first <> last")
    linked = connected_components(own.join(many, "image_id").select(F.col("key").alias("src"), F.col("first").alias("dst")))
    names = linked.select(F.col("id").alias("key"), F.col("component").alias("unit"))
    return skew_join(own, materialize(names, "units"), "key").select("image_id", "group_id", F.coalesce("unit", "key").alias("unit"))


def assign_parts(own: DataFrame, shares: Mapping[str, float], bins: int = BINS, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """One row (unit, bin, weight, part) per unit of `members`, in the given shares of the images."""
    weights = own.select("unit", "image_id").distinct().groupBy("unit").agg(F.count(F.lit(1)).alias("weight"))
    packed = equal_bins(weights, bins, chunk_items)
    # at most `bins` rows reach the driver
    sums = {r["bin"]: r["w"] for r in packed.groupBy("bin").agg(F.sum("weight").alias("w")).collect()}
    parts = allocate(sums, shares)
    table = packed.sparkSession.createDataFrame(list(parts.items()), "bin bigint, part string")
    return packed.join(F.broadcast(table), "bin").select("unit", "bin", "weight", "part")


def part_shares(split_part: DataFrame) -> dict[str, float]:
    """Target share of each part; the table lists the spellings of a handful of parts and is fixed."""
    rows = split_part.filter("part is not null").groupBy("part").agg(F.max("target_share").alias("s")).collect()
    return {r["part"]: float(r["s"] or 0) for r in rows}


def group_report(own: DataFrame, split: DataFrame, split_part: DataFrame, units: DataFrame) -> DataFrame:
    """One row (group_id, new_part, keeps, leaves, old_parts) per group: what the new allocation makes of it.

    new_part comes from the bin the group's unit was packed into. keeps tells whether rows of the group
    stand in that part already, leaves lists the other parts its rows have to leave, and old_parts is the number of
    parts it was torn into: those it leaves and, where it keeps some rows, the new one. Spellings match exactly; null and
    unlisted ones do not count, nor do null groups. A group none of whose images has a part leaves none.
    """
    # split_part is a fixed list of spellings, so it is broadcast
    known = split.join(F.broadcast(split_part.select(F.col("spelling").alias("part"), F.col("part").alias("known"))), "part")
    known = known.select("image_id", "known").distinct()
    grouped = own.filter("group_id is not null").select("image_id", "group_id", "unit").distinct()
    allocated = skew_join(materialize(grouped, "grouped"), units.select("unit", F.col("part").alias("new_part")), "unit", "inner")
    moves = allocated.join(known, "image_id", "left").groupBy("group_id", "new_part")
    # a handful of parts a group
    seen = moves.agg(F.coalesce(F.bool_or(F.col("known") == F.col("new_part")), F.lit(False)).alias("keeps"), F.array_sort(F.collect_set(F.when(F.col("known") != F.col("new_part"), F.col("known")))).alias("leaves"))
    return seen.withColumn("old_parts", F.size("leaves") + F.col("keeps").cast("int"))


def bin_spread(units: DataFrame) -> DataFrame:
    """How even the bins are: one row (bins, least, most, mean, spread), spread being (most - least) / mean."""
    sums = units.groupBy("bin").agg(F.sum("weight").alias("w"))
    one = sums.agg(F.count(F.lit(1)).alias("bins"), F.min("w").alias("least"), F.max("w").alias("most"), F.avg("w").alias("mean"))
    return one.withColumn("spread", (F.col("most") - F.col("least")) / F.col("mean"))
