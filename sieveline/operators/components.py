"""Connected components by union-find on a two-dimensional grid of edge cells.

Vertices are hashed into blocks; an edge belongs to the cell of its two blocks. Each cell is united
locally in one task, which leaves one representative per vertex and cell. A vertex then takes the least of
the representatives that its row and column of cells gave it (its parent), and the other representatives
are linked to that one. These links are the edges of the next, smaller grid; when none is left the parents
are stable. The grid is sized by the number of edges, so a task holds a bounded share of them, and a hub
with a third of all edges is spread over the whole row and column of its block.

"Least" is by a hash that changes every round, so that chains shrink by a constant factor whatever
order their ids have. The group's name is the smallest id and is settled at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.joins import skew_join
from sieveline.session import materialize, release

#: Edges a cell should hold on average.
EDGES_PER_CELL = 50_000
#: Rows a task unites at once; what it keeps between is at most one row per vertex of its cells.
_BUFFER = 1_000_000


def _unite(ids: np.ndarray, prio: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ids (with its priority) the index of the least one linked to it by the index pairs u, v."""
    order = np.lexsort((ids, prio))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    parent, a, b = np.arange(len(ids)), rank[u], rank[v]
    while len(a):
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return order[parent[rank]]


def _cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unite the edges (u, pu, v, pv) of a task's cells; one row per vertex with its representative."""
    kept: list[pd.DataFrame] = []
    waiting = 0

    def reduce() -> pd.DataFrame:
        e = pd.concat(kept, ignore_index=True)
        ends = pd.concat([e[["u", "pu"]].set_axis(["id", "p"], axis=1), e[["v", "pv"]].set_axis(["id", "p"], axis=1)], ignore_index=True)
        codes, ids = pd.factorize(ends["id"], sort=True)
        ids = np.asarray(ids)
        prio = np.empty(len(ids), np.int64)
        prio[codes] = ends["p"].to_numpy()
        root = _unite(ids, prio, codes[: len(e)], codes[len(e) :])
        return pd.DataFrame({"u": ids, "pu": prio, "v": ids[root], "pv": prio[root]})

    for pdf in batches:
        kept.append(pdf)
        waiting += len(pdf)
        if waiting >= _BUFFER:
            kept, waiting = [reduce()], 0
    if kept and sum(map(len, kept)):
        yield reduce().rename(columns={"u": "v", "v": "root", "pv": "proot"})[["v", "root", "proot"]]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", edges_per_cell: int = EDGES_PER_CELL) -> DataFrame:
    """One row (id, component) per vertex with an edge; component is the smallest id reached, itself included.

    The two columns must have one type, bigint or string; ids compare by that type. Edges with a null end
    link nothing and are dropped, as are self-links; repeated and turned edges do no harm; other columns
    are not read. No edges give no rows.
    """
    kind = dict(edges.dtypes)[src]
    todo = edges.select(F.col(src).alias("a"), F.col(dst).cast(kind).alias("b")).filter("a is not null and b is not null and a <> b")
    todo = materialize(todo.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    left, levels = todo.count(), []
    while left:
        blocks = max(1, math.ceil(math.sqrt(2 * left / edges_per_cell)))
        seed, cells = len(levels), blocks * (blocks + 1) // 2
        block = lambda c: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(blocks)).cast("int")
        row, col = F.least(block("u"), block("v")), F.greatest(block("u"), block("v"))
        prio = lambda c: F.xxhash64(F.lit(seed + 7919), c)
        united = (
            todo.select("u", prio("u").alias("pu"), "v", prio("v").alias("pv"), (row * F.lit(blocks) - row * (row - 1) / 2 + col - row).cast("int").alias("cell"))
            .repartitionById(cells, "cell")
            .drop("cell")
            .mapInPandas(_cell, f"v {kind}, root {kind}, proot bigint")
        )
        # a vertex has at most one row from each of the `blocks` cells of its row and column
        exchanged = materialize(
            united.groupBy("v").agg(F.min(F.struct("proot", "root"))["root"].alias("parent"), F.collect_set("root").alias("roots")), "exchange"
        )
        release(todo)
        levels.append(exchanged.select("v", "parent"))
        more = exchanged.filter("size(roots) > 1").select(F.explode("roots").alias("a"), F.col("parent").alias("b")).filter("a <> b")
        todo = more.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        left = exchanged.agg(F.sum(F.size("roots") - 1)).head()[0] or 0
        if left:
            todo = materialize(todo, "edges")
            left = todo.count()
    if not levels:
        return edges.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
    found = levels.pop()
    while levels:
        lower = levels.pop()
        up = found.select(F.col("v").alias("parent"), F.col("parent").alias("top"))
        found = materialize(skew_join(lower, up, "parent").select("v", F.coalesce("top", "parent").alias("parent")), "parents")
    name = found.groupBy("parent").agg(F.min("v").alias("component"))
    return skew_join(found, name, "parent", "inner").select(F.col("v").alias("id"), "component")
