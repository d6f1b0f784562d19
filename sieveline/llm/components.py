"""Problem 1: pairwise matches become groups, by union-find on a two-dimensional grid of edge cells.

Vertices are hashed into blocks; an edge belongs to the cell of its two blocks. Each cell is united
locally in one task, which leaves one representative per vertex and cell. A vertex then takes the least of
the representatives that its row and column of cells gave it (its parent), and the other representatives
are linked to that one. These links are the edges of the next, smaller grid; when none is left the parents
are stable. The grid is sized by the number of edges, so a task holds a bounded share of them, and a hub
with a third of all edges is spread over the whole row and column of its block.

The engine itself, `sieveline.operators.components`, serves the library's own components too; here the links
are made of pairwise matches. "Least" is by a hash that changes every round, so that chains shrink by a constant factor whatever
order their ids have. The group's name is the smallest id and is settled at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.ids import loose_id
from sieveline.operators.components import connected_components
from sieveline.operators.joins import skew_join
from sieveline.session import materialize

__all__ = ["connected_components", "image_groups", "image_links"]


def image_links(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Links (src, dst) between images, as bigint: accepted pairs of two different ids that both exist.

    pairs: left_image and right_image written loosely, accepted; images: image_id. Undecided (null) and
    refused pairs, null ends and ids that exist nowhere are left out. Ids of nine digits compare as
    numbers as they do as text.
    """
    known = images.select(F.col("image_id").cast("bigint").alias("src")).filter("src is not null").distinct()
    links = (
        pairs.filter("accepted")
        .select(loose_id("left_image").cast("bigint").alias("a"), loose_id("right_image").cast("bigint").alias("b"))
        .filter("a <> b")
        .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        .distinct()
    )
    links = materialize(links, "links")
    links = skew_join(links, known, "src", "left_semi")
    return skew_join(materialize(links, "links"), known.withColumnRenamed("src", "dst"), "dst", "left_semi")


def image_groups(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """One row (image_id, group_id) per image with a link; group_id is the smallest id of its group."""
    found = connected_components(image_links(pairs, images))
    return found.select(F.col("id").cast("string").alias("image_id"), F.col("component").cast("string").alias("group_id"))
