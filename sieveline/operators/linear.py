"""Class-conditional means and covariances of vectors, summed in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sums(size: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for pdf in it:
            for label, rows in pdf.groupby("label"):
                x = np.stack(rows["v"].to_numpy()).astype(float)
                n, s, g = total.get(int(label), (0, 0.0, 0.0))
                total[int(label)] = [n + len(x), s + x.sum(0), g + x.T @ x]
        yield pd.DataFrame(
            [(k, n, s.tolist(), g.ravel().tolist()) for k, (n, s, g) in total.items()], columns=["label", "n", "sums", "products"]
        )

    return run


def class_sums(df: DataFrame, vector: str, label: str, size: int) -> DataFrame:
    """Rows (label, n, sums, products) of each class: a task adds up its rows before anything is sent.

    Vectors of another length, null vectors and null labels are left out. `size` squared numbers a class and task travel.
    """
    rows = df.select(F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter("label is not null and v is not null and not exists(v, x -> x is null)").filter(F.size("v") == size)
    part = rows.mapInPandas(_sums(size), "label int, n bigint, sums array<double>, products array<double>")
    pos = part.select("label", "n", F.posexplode("products").alias("i", "p"))
    products = pos.groupBy("label", "i").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    products = products.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("products"))
    sums = part.select("label", F.posexplode("sums").alias("i", "s")).groupBy("label", "i").agg(F.sum("s").alias("s"))
    sums = sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sums"))
    return products.join(sums, "label").select("label", "n", "sums", "products")


def pooled_covariance(rows: list, size: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Class means and the pooled within-class covariance (divisor n - classes) from collected class sums."""
    means, scatter, n = {}, np.zeros((size, size)), 0
    for r in rows:
        mean = np.array(r["sums"]) / r["n"]
        means[r["label"]] = mean
        scatter += np.array(r["products"]).reshape(size, size) - r["n"] * np.outer(mean, mean)
        n += r["n"]
    return means, scatter / max(1, n - len(rows))
