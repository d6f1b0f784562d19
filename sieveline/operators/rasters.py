"""Statistics of images of one size, over whole tables: kernels run on Arrow batches, and only counts leave a task.

No row per pixel is ever made: a batch of images is one array, and what is shuffled is one row per value that a
batch holds. The statistics are those of `sieveline.kernels.statistics`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.kernels import statistics as st

#: Room for the values of one statistic, which lie around 0.
ROOM = 4096


def _stacks(it: Iterator[pd.DataFrame], raster: str, width: int, height: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in it:
        if len(pdf):
            yield pdf, np.frombuffer(b"".join(map(bytes, pdf[raster])), np.uint8).reshape(-1, height, width).astype(np.int32)


def _sized(images: DataFrame, raster: str, width: int, height: int) -> DataFrame:
    return images.filter(F.octet_length(raster) == width * height)


def count_images(images: DataFrame, raster: str, width: int, height: int, by: str, parts: st.Parts) -> DataFrame:
    """Counts over whole images: rows (by, filter, step, stratum, value, n) of the statistics that parts gives.

    Rasters of another size are left out; by may be null. A task adds up each Arrow batch before anything is sent.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, x in _stacks(it, raster, width, height):
            code, names = pd.factorize(pdf[by], use_na_sentinel=False)
            for f, q, s, value, chosen in parts(x):
                cell = (code.reshape(-1, *[1] * (value.ndim - 1)) * 2 * ROOM + value + ROOM)[... if chosen is None else chosen]
                at, n = np.unique(cell, return_counts=True)
                yield pd.DataFrame({by: names[at // (2 * ROOM)], "filter": f, "step": q, "stratum": s, "value": at % (2 * ROOM) - ROOM, "n": n})

    rows = _sized(images, raster, width, height).select(by, raster)
    keys = [by, "filter", "step", "stratum", "value"]
    return rows.mapInPandas(run, f"`{by}` string, filter int, step int, stratum int, value int, n bigint").groupBy(*keys).agg(F.sum("n").alias("n"))


def describe_images(images: DataFrame, raster: str, width: int, height: int, keys: Sequence[str], schema: str, job: Callable[[np.ndarray], dict[str, list]]) -> DataFrame:
    """One row (keys, schema) per image, without a shuffle; job gives each column of a batch's stack as a list."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keys).schema.fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, x in _stacks(it, raster, width, height):
            yield pdf[list(keys)].reset_index(drop=True).assign(**job(x))

    return _sized(images, raster, width, height).select(*keys, raster).mapInPandas(run, f"{kept}, {schema}")


def adjacent_bins(hist: Column, total: Column) -> Column:
    """Adjacent-bin statistic of an array of (value, n): minus the sum of (even - odd)^2 / (even + odd) over pairs of fractions."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.struct(*[_at(hist, k * 2 + odd).alias(name) for odd, name in ((0, "e"), (1, "o"))]))
    term = lambda p: F.when(p["e"] + p["o"] > 0, F.pow(p["e"] - p["o"], 2) / (p["e"] + p["o"])).otherwise(0.0)
    return -F.aggregate(pairs, F.lit(0.0), lambda a, p: a + term(p)) / total


def _at(hist: Column, value: Column) -> Column:
    return F.element_at(hist, value.cast("int") + 1)


def histograms(images: DataFrame, raster: str, width: int, height: int, keys: Sequence[str]) -> DataFrame:
    """One row (keys, bins) per image: its 256 counts."""
    job = lambda x: {"bins": [np.bincount(v.ravel(), minlength=256) for v in x]}
    return describe_images(images, raster, width, height, keys, "bins array<bigint>", job)


def local_moments(images: DataFrame, raster: str, width: int, height: int, key: str = "image_id") -> DataFrame:
    """Mean and variance of the 5 x 5 neighbourhood of every pixel at least two pixels inside: rows (key, y, x, mean, variance)."""

    def job(x: np.ndarray) -> dict[str, list]:
        total, squares = st.moments(x)
        return {"s": list(total.reshape(len(x), -1)), "q": list(squares.reshape(len(x), -1))}

    rows = describe_images(images, raster, width, height, [key], "s array<bigint>, q array<bigint>", job)
    rows = rows.select(key, F.posexplode(F.arrays_zip("s", "q")).alias("i", "m"))
    s, q, inner = F.col("m.s"), F.col("m.q"), width - 2 * st.RIM
    at = lambda c: (c + st.RIM).cast("int")
    return rows.select(key, at(F.floor(F.col("i") / inner)).alias("y"), at(F.col("i") % inner).alias("x"), (s / 25).alias("mean"), ((q * 25 - s * s) / 625).alias("variance"))


def toggle_fractions(counts: DataFrame, by: str) -> DataFrame:
    """Share of four-pixel groups whose roughness rises, falls or stays when low bits are toggled: rows (by, orientation, mask, rises, falls, stays)."""
    share = lambda sign: F.coalesce(F.sum(F.when(F.col("value") == sign, F.col("n"))), F.lit(0)) / F.sum("n")
    rows = counts.groupBy(by, F.when(F.col("filter") == 0, "row").otherwise("column").alias("orientation"), F.col("step").alias("mask"))
    return rows.agg(share(1).alias("rises"), share(-1).alias("falls"), share(0).alias("stays"))


def toggle_score(fractions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Regularity score per group: minus the mean over masks and orientations of rises minus falls."""
    return fractions.groupBy(*by).agg(F.avg(F.col("falls") - F.col("rises")).alias("score"))


def vector_moments(df: DataFrame, vector: str) -> DataFrame:
    """Mean, population deviation (at least 1e-6) and validity (above 1e-7) of every dimension."""
    rows = df.filter(F.col(vector).isNotNull()).select(F.posexplode(vector).alias("dim", "v"))
    sd = F.stddev_pop(F.col("v").cast("double"))
    return rows.groupBy("dim").agg(F.avg("v").alias("mean"), F.greatest(sd, F.lit(1e-6)).alias("deviation"), (sd > 1e-7).alias("valid"))


def distance_from_rest(counts: DataFrame, by: str) -> DataFrame:
    """For each group the sum over all bins of (its count - the rest's)^2 / (the rest's + 32): rows (by, distance)."""
    keys = ["filter", "step", "stratum", "value"]
    total = counts.groupBy(*keys).agg(F.sum("n").alias("all"))  # bins are fixed in number
    dense = counts.select(by).distinct().crossJoin(F.broadcast(total.select(*keys))).withColumn("n", F.lit(0).cast("bigint"))
    rows = dense.unionByName(counts).groupBy(by, *keys).agg(F.sum("n").alias("n")).join(F.broadcast(total), keys)
    rest = F.col("all") - F.col("n")
    return rows.groupBy(by).agg(F.sum(F.pow(F.col("n") - rest, 2) / (rest + 32)).alias("distance"))
