"""Statistics over whole small images, against those of single ones."""

import numpy as np
import pytest

from sieveline.kernels import codec
from sieveline.kernels import statistics as st
from sieveline.operators import rasters


def small_images(n=40):
    rng = np.random.default_rng(5)
    return [np.clip(128 + rng.normal(0, rng.choice([2, 6, 12, 40]), (8, 9)), 0, 255).astype(np.uint8) for _ in range(n)]


NAMES = ["a", "b", None]


def frame(spark, images):
    rows = [(NAMES[i % 3], x.tobytes()) for i, x in enumerate(images)] + [("a", b"short"), ("b", None)]
    return spark.createDataFrame(rows, "archive string, small binary").repartition(3)


@pytest.mark.parametrize("parts", [st.pixel_parts, st.residual_parts, st.code_parts, st.class_parts, st.masked_parts, st.balance_parts, st.toggle_parts])
def test_counts_add_up_single_images(spark, parts):
    images, want = small_images(), {}
    for i, x in enumerate(images):
        for f, q, s, values, chosen in parts(x[None].astype(np.int64)):
            for v in (values if chosen is None else values[chosen]).ravel().tolist():
                key = (NAMES[i % 3], f, q, s, v)
                want[key] = want.get(key, 0) + 1
    got = {(r["archive"], r["filter"], r["step"], r["stratum"], r["value"]): r["n"] for r in rasters.count_images(frame(spark, images), "small", 9, 8, "archive", parts).collect()}
    assert got == want
    assert rasters.count_images(frame(spark, images).limit(0), "small", 9, 8, "archive", parts).count() == 0


def test_balance_objective_takes_every_archive_filter_stratum_and_step(spark):
    images = small_images()
    counts = rasters.count_images(frame(spark, images), "small", 9, 8, "archive", st.balance_parts)
    each = {a: sum(codec.balance_histograms(x, x)[0] for i, x in enumerate(images) if NAMES[i % 3] == a) for a in NAMES}
    distance = {r["archive"]: r["distance"] for r in rasters.distance_from_rest(counts, "archive").collect()}
    for a in NAMES:
        rest = sum(each[b] for b in NAMES if b != a)
        assert len(rest) == 1632 and distance[a] == pytest.approx(codec.balance_objective(rest, each[a] - rest))


def test_features_of_an_image_are_shares_of_its_classes():
    x = small_images(3)[2]
    f = st.features(x)
    for k, (filter_, step) in enumerate((f, q) for f in range(10) for q in st.STEPS):
        n = np.zeros(625)
        for g, q, _, values, _ in st.class_parts(x[None].astype(np.int64)):
            if (g, q) == (filter_, step):
                n += np.bincount(values.ravel(), minlength=625)
        assert np.allclose(f[169 * k : 169 * k + 169], n[st.classes()] / n.sum())
