"""Detectors: two statistics without fitting, a subspace ensemble of linear discriminants, a forest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import new_path

#: Where the tail of a feature vector begins: histogram 256, pair differences 128, RS 18, container 1.
_TAIL = 403


def adjacent_bin_score(features: Column) -> Column:
    """Minus the sum of (even - odd)^2 / (even + odd) over the histogram's pairs."""
    start = F.size(features) - _TAIL + 1
    hist = F.transform(F.slice(features, start, 256), lambda v: v.cast("double"))
    even = F.filter(hist, lambda _, i: i % 2 == 0)
    odd = F.filter(hist, lambda _, i: i % 2 == 1)
    terms = F.zip_with(even, odd, lambda e, o: (e - o) * (e - o) / F.greatest(e + o, F.lit(1e-12)))
    return -F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)


def regularity_score(features: Column) -> Column:
    """Minus the mean over the six RS rows of what rises minus what falls."""
    rs = F.slice(features, F.size(features) - 18, 18)
    signed = F.transform(rs, lambda v, i: F.when(i % 3 == 0, v.cast("double")).when(i % 3 == 1, -v.cast("double")).otherwise(F.lit(0.0)))
    return -F.aggregate(signed, F.lit(0.0), lambda a, v: a + v) / 6


@dataclass
class SubspaceEnsemble:
    """Fitted ensemble: mean and scale of the features, and each learner's dimensions, weights, offset, scale."""

    mean: np.ndarray
    scale: np.ndarray
    learners: list[tuple[np.ndarray, np.ndarray, float, float]]

    def score(self, df: DataFrame, vector: str, name: str = "score") -> DataFrame:
        """df without the vector and with the score: the mean over learners of (w x - offset) / scale.

        Vectors that are null or of another length get a null score.
        """
        shared = df.sparkSession.sparkContext.broadcast(self)  # its size is that of the model, not of the data
        keep = [c for c in df.columns if c not in (vector, name)]
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for pdf in it:
                ok = pdf[vector].map(lambda v: v is not None and len(v) == len(model.mean)).to_numpy(bool)
                score = np.full(len(pdf), np.nan)
                if ok.any():
                    x = (np.stack(pdf.loc[ok, vector].to_numpy()).astype(float) - model.mean) / model.scale
                    score[ok] = sum((x[:, d] @ w - b) / s for d, w, b, s in model.learners) / len(model.learners)
                yield pdf[keep].assign(**{name: score})

        out = df.mapInPandas(run, (kept + ", " if kept else "") + f"`{name}` double")
        return out.withColumn(name, F.nanvl(name, F.lit(None)))


    def save(self, spark: SparkSession, path: str) -> None:
        """Write the fitted numbers as a table of coefficients; an existing path is an error."""
        rows = [(-1, None, self.mean.tolist(), self.scale.tolist(), None, None)]
        rows += [(k, d.tolist(), w.tolist(), None, float(b), float(s)) for k, (d, w, b, s) in enumerate(self.learners)]
        spark.createDataFrame(rows, _COEFFICIENTS).coalesce(1).write.mode("errorifexists").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SubspaceEnsemble:
        """The ensemble that was saved at path."""
        rows = spark.read.schema(_COEFFICIENTS).parquet(path).orderBy("learner").collect()  # one row per learner
        head, *rest = rows
        return SubspaceEnsemble(np.array(head["weights"]), np.array(head["scales"]), [(np.array(r["dims"], np.int64), np.array(r["weights"]), r["offset"], r["scale"]) for r in rest])


_COEFFICIENTS = "learner int, dims array<bigint>, weights array<double>, scales array<double>, offset double, scale double"


def _stack(s: pd.Series, size: int) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(float) if len(s) else np.empty((0, size))


def fit_subspace_ensemble(df: DataFrame, vector: str, label: str, size: int, seed: int = 551, learners: int = 64, dimension: int = 192, shrinkage: float = 0.2) -> SubspaceEnsemble:
    """Fit the ensemble on rows of a vector of `size` numbers and a label 0 or 1.

    Two passes over the data: moments of the features, then each learner's class sums. Tasks send sums, whose
    size is that of the model; the small systems are solved on the driver. Rows with a null or short vector or
    another label are left out; both classes must occur.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and v is not null").filter(F.size("v") == size)

    def moments(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(size), np.zeros(size)
        for pdf in it:
            x = _stack(pdf["v"], size)
            n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pd.DataFrame({"i": np.arange(size), "n": n, "s": s, "q": q})

    part = rows.mapInPandas(moments, "i int, n bigint, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    m = part.orderBy("i").toPandas()  # one row per feature
    if not len(m) or not m["n"].iat[0]:
        raise ValueError("nothing to fit on")
    mean = (m["s"] / m["n"]).to_numpy()
    sd = np.sqrt(np.maximum(0, (m["q"] / m["n"]).to_numpy() - mean**2))
    scale, valid, rng = np.maximum(sd, 1e-6), np.flatnonzero(sd > 1e-7), np.random.default_rng(seed)
    chosen = [rng.choice(valid, min(dimension, len(valid)), replace=False) for _ in range(learners)]
    shared = df.sparkSession.sparkContext.broadcast((mean, scale, chosen))

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mean, scale, chosen = shared.value
        total = [[[0, 0.0, 0.0] for _ in (0, 1)] for _ in chosen]
        for pdf in it:
            z, y = (_stack(pdf["v"], size) - mean) / scale, pdf["y"].to_numpy()
            for t, d in zip(total, chosen):
                for c in (0, 1):
                    x = z[y == c][:, d]
                    t[c] = [t[c][0] + len(x), t[c][1] + x.sum(0), t[c][2] + x.T @ x]
        rows = [
            (k, np.r_[float(n), np.ravel(s), np.ravel(g)].tobytes(), c)
            for k, t in enumerate(total)
            for c, (n, s, g) in enumerate(t)
            if n
        ]
        yield pd.DataFrame(rows, columns=["learner", "sums", "class"])

    def add(key: tuple, it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | float = 0.0
        for pdf in it:
            for x in pdf["sums"]:
                total = total + np.frombuffer(x, float)
        yield pd.DataFrame({"learner": [key[0]], "class": [key[1]], "sums": [np.asarray(total).tobytes()]})

    got = rows.mapInPandas(sums, "learner int, sums binary, class int").groupBy("learner", "class").applyInPandas(add, "learner int, class int, sums binary")
    by: dict[int, dict[int, np.ndarray]] = {}
    for r in got.toLocalIterator():  # one learner and class at a time
        by.setdefault(r["learner"], {})[r["class"]] = np.frombuffer(bytes(r["sums"]), float)
    if any(len(v) < 2 for v in by.values()):
        raise ValueError("both classes are needed")
    fitted = []
    for k, d in enumerate(chosen):
        size_k, n, means, scatter, all_s, all_g = len(d), 0, [], 0.0, 0.0, 0.0
        for c in (0, 1):
            x = by[k][c]
            nc, s, g = x[0], x[1 : 1 + size_k], x[1 + size_k :].reshape(size_k, size_k)
            means.append(s / nc)
            scatter = scatter + g - nc * np.outer(means[-1], means[-1])
            n, all_s, all_g = n + nc, all_s + s, all_g + g
        cov = scatter / max(1, n - 2)
        regular = (1 - shrinkage) * cov + shrinkage * np.diag(np.maximum(np.diag(cov), 0.01)) + np.eye(size_k) * 1e-5
        w = np.linalg.solve(regular, means[1] - means[0])
        spread = np.sqrt(max(0.0, w @ all_g @ w / n - (w @ all_s / n) ** 2))
        fitted.append((d, w, float((means[0] + means[1]) @ w / 2), max(float(spread), 1e-8)))
    return SubspaceEnsemble(mean, scale, fitted)


def fit_forest(df: DataFrame, vector: str, label: str, trees: int = 200, least: int = 4, seed: int = 831):
    """Random forest with balanced class weights: the nearest MLlib has to extremely randomised trees.

    It draws bootstrap samples and seeks the best cut where those draw cuts at random: another algorithm, not a
    reimplementation. Trees are as deep as MLlib allows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = df.filter(F.col(vector).isNotNull() & F.col(label).isin(0, 1))
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"))
    weights = n.crossJoin(F.broadcast(total)).select(label, (F.col("all") / (F.col("classes") * F.col("n"))).alias("_w"))  # two rows
    rows = rows.join(F.broadcast(weights), label).select(array_to_vector(F.col(vector).cast("array<double>")).alias("_x"), F.col(label).cast("double").alias("_y"), "_w")
    return RandomForestClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", numTrees=trees, minInstancesPerNode=least, featureSubsetStrategy="sqrt", seed=seed, maxDepth=30, maxMemoryInMB=512
    ).fit(rows)


def save_forest(model, path: str) -> None:
    """Save a fitted forest; an existing path is an error."""
    model.save(path)


def load_forest(path: str):
    """The forest that was saved at path, without the summary of its fitting."""
    from pyspark.ml.classification import RandomForestClassificationModel

    return RandomForestClassificationModel.load(path)


def score_forest(model, df: DataFrame, vector: str, name: str = "score") -> DataFrame:
    """df without the vector and with the forest's probability of class 1; null vectors are left out.

    A fitted model holds on to the session by its training summary, which does not go to the executors; one
    that was saved and loaded does not. So a model with a summary is saved to the shared folder first.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model.hasSummary:
        path = new_path(df.sparkSession, "forest")
        save_forest(model, path)
        model = load_forest(path)

    keep = [c for c in df.columns if c not in (vector, name)]
    rows = df.filter(F.col(vector).isNotNull()).select(*keep, array_to_vector(F.col(vector).cast("array<double>")).alias("_x"))
    return model.transform(rows).select(*keep, vector_to_array("probability")[1].alias(name))
