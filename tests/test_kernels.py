import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.kernels import codec, images
from sieveline.kernels import statistics as st
from sieveline.operators import detectors, image_jobs

KEY, SALT, PAD = bytes(range(32)), bytes(range(32, 64)), bytes(range(64, 74))


def test_known_codec_bytes():
    schedule = codec.Schedule(512, 512, 81, KEY)
    keys = schedule.salted(SALT)
    assert schedule.context.hex() == "535445472d42502f31000002000000020000000000000000510a"
    assert keys["aead"].hex() == "b3a05c52cb127e8d1613e40b3ba325bc892d939201b69d729ec67de65f6f9468"
    body = codec.build_body(b"HELLO", 81, KEY, schedule.context, SALT, keys, lambda n: PAD[:n])
    assert body.hex() == "ab8a9bc524cc46545a4ff70091e3cd0528f90ebda2901367635a1d2abf0d5e7171545cded108d1f6c4bc3a3ea8e429d682"
    assert codec.parse_body(body, KEY, schedule.context, SALT, keys) == b"HELLO"
    for k in (0, 20, len(body) - 1):
        with pytest.raises(ValueError):
            codec.parse_body(body[:k] + bytes([body[k] ^ 4]) + body[k + 1 :], KEY, schedule.context, SALT, keys)
    with pytest.raises(ValueError):
        codec.Schedule(512, 512, 81, KEY[:-1])
    assert codec.Schedule(512, 512, 81, None).root != schedule.root


def test_public_frames_hold_a_checksum():
    schedule = codec.Schedule(300, 900, 120, None)
    keys = schedule.salted(SALT)
    body = codec.build_body(b"abc" * 90, 120, None, schedule.context, SALT, keys, lambda n: bytes(n))
    assert len(body) == 88 and codec.parse_body(body, None, schedule.context, SALT, keys) == b"abc" * 90  # packed
    with pytest.raises(ValueError):
        codec.parse_body(body[:30] + bytes([body[30] ^ 1]) + body[31:], None, schedule.context, SALT, keys)


@pytest.mark.parametrize("height", [2, 4, 6])
def test_trellis_finds_the_cheapest_way_to_every_syndrome(height):
    """Against a shortest path over all syndromes: columns are edges, one parity after the other."""
    n, m = 30, 6
    rng = np.random.default_rng(height * 17)
    matrix = codec.Parity(n, m, hashlib.sha256(bytes([height])).digest(), height)
    words, x = matrix.columns(), rng.integers(0, 2, n).astype(np.uint8)
    cost = np.where(rng.random(n) < 0.25, images.WET, rng.integers(1, 50, n)).astype(np.uint32)
    best = {0: 0}
    for i in range(n):
        after = {}
        for s, c in best.items():
            for bit in (0, 1):
                if bit != x[i] and cost[i] == images.WET:
                    continue
                t = s ^ (int(words[i]) << int(matrix.row[i]) if bit else 0)
                after[t] = min(after.get(t, 10**9), c + (0 if bit == x[i] else int(cost[i])))
        best = after
    for s in range(1 << m):
        target = np.array([s >> k & 1 for k in range(m)])
        if s in best:
            y, price = codec.trellis_embed(x, cost, target, words, height)
            assert price == best[s] == int(cost[x != y].sum()) and (codec.trellis_extract(y, m, words, height) == target).all()
        else:
            with pytest.raises(codec.EmbeddingError):
                codec.trellis_embed(x, cost, target, words, height)


def test_parity_is_hashed_where_it_is_asked_for():
    y = (np.arange(300) * 5 % 7 < 3).astype(int)
    for m, h in ((300, 1), (40, 15), (7, 10)):
        parity = codec.Parity(300, m, KEY, h)
        assert (parity.syndrome(y) == codec.trellis_extract(y, m, parity.columns(), h)).all()
        assert (parity.columns(np.array([299, 3])) == parity.columns()[[299, 3]]).all()
    for m, h in ((0, 3), (301, 3), (5, 16)):
        with pytest.raises(ValueError):
            codec.Parity(300, m, KEY, h)


def test_stream_and_shuffle():
    whole = codec.Stream(SALT).take(500)
    parts = codec.Stream(SALT)
    assert b"".join(parts.take(k) for k in (7, 0, 64, 1, 200, 228)) == whole
    order = codec.shuffled(np.arange(1000) * 2, SALT)
    assert sorted(order.tolist()) == list(range(0, 2000, 2)) and (order != codec.shuffled(np.arange(1000) * 2, KEY)).any()
    assert codec.shuffled(np.array([], int), KEY).tolist() == [] and codec.shuffled(np.array([9]), KEY).tolist() == [9]


def test_unfair_draws_are_thrown_away(monkeypatch):
    top = (1 << 64) - 1
    draws = [4, top, 3, 5, top - 1, 2, 8, 1, 0, 7]
    data = b"".join(d.to_bytes(8, "big") for d in draws)

    class Fixed:
        def __init__(self, key):
            self.at = 0

        def take(self, n):
            self.at += n
            return data[self.at - n : self.at]

    monkeypatch.setattr(codec, "Stream", Fixed)
    left, want = list(draws), list(range(6))
    for i in range(5, 0, -1):
        d = left.pop(0)
        while d >= (1 << 64) // (i + 1) * (i + 1):
            d = left.pop(0)
        want[i], want[d % (i + 1)] = want[d % (i + 1)], want[i]
    assert codec.shuffled(np.arange(6), b"").tolist() == want


def direct(x, taps, down, across):
    """Correlation by its definition, the pixel at (down, across) of the taps, edges mirrored."""
    p = np.pad(x, 20, mode="symmetric")
    h, w = taps.shape
    return np.array([[sum(taps[i, j] * p[20 + y + i - down, 20 + c + j - across] for i in range(h) for j in range(w)) for c in range(x.shape[1])] for y in range(x.shape[0])])


def test_filters_equal_direct_sums():
    x = np.random.default_rng(77).integers(0, 256, (2, 11, 9))
    for f, taps in zip(st.FILTERS, st.feature_taps()):
        t = np.array(f)
        assert (st.residual(x, taps) == [direct(i, t, t.shape[0] // 2, t.shape[1] // 2)[2:-2, 2:-2] for i in x]).all()
    five = np.ones((5, 5), int)
    total, squares = st.moments(x)
    assert (total == [direct(i, five, 2, 2)[2:-2, 2:-2] for i in x]).all() and (squares == [direct(i * i, five, 2, 2)[2:-2, 2:-2] for i in x]).all()
    assert (images.box_sums(x[0]) == direct(x[0], five, 2, 2)).all()
    line = np.array([[1.0, -2.0, 5.0, 7.0]])
    assert np.allclose(images._along(x[0].astype(float), line[0], 1, 1), direct(x[0].astype(float), line, 0, 1))


def test_levels_and_classes():
    assert st.level(np.array([-7, -3, -2, -1, 0, 1, 2, 3, 7]), 4, 2).tolist() == [-2, -1, -1, 0, 0, 0, 1, 1, 2]
    assert len(st.classes()) == 169
    rng = np.random.default_rng(78)
    four = rng.integers(-2, 3, 4)
    code = lambda v: int(st.class_of()[st.fours(np.array(v)[None, None, :], 2).item()])
    assert code(four) == code(four[::-1]) == code(-four) == code(-four[::-1])
    assert st.fours(np.zeros((1, 2, 3)), 2).size == 0


def test_features_layout():
    image = image_jobs.synthetic_cover(11, 70, 90)
    f = images.features_with_container(image)
    assert len(f) == 8177 and np.isclose(f[-1], len(images.encode_png(image)) / image.size)
    assert np.allclose(f[:5070].reshape(30, 169).sum(1), 1, atol=1e-5)
    shares = f[5070:7774].reshape(16, 169).sum(1)
    assert all(np.isclose(s, 1, atol=1e-5) or s == 0 for s in shares)
    hist = f[7774:8030]
    assert np.isclose(hist.sum(), 1) and np.allclose(f[8030:8158], hist[::2] - hist[1::2])
    assert np.allclose(f[8158:8176].reshape(6, 3).sum(1), 1, atol=1e-6)
    values, n = np.unique(st.class_of()[st.fours(st.level(st.residual(image[None].astype(int), st.feature_taps()[4]), 2, 2), 1)], return_counts=True)
    both = dict(zip(values.tolist(), n.tolist()))
    for v, k in zip(*np.unique(st.class_of()[st.fours(st.level(st.residual(image[None].astype(int), st.feature_taps()[4]), 2, 2), 2)], return_counts=True)):
        both[int(v)] = both.get(int(v), 0) + int(k)
    want = np.array([both.get(int(c), 0) for c in st.classes()]) / sum(both.values())
    assert np.allclose(f[169 * 13 : 169 * 14], want, atol=1e-6)


def test_costs_keep_flat_border_and_ends():
    image = image_jobs.synthetic_cover(12, 80, 96)
    image[30:50, 30:50] = 90
    image[20, 20], image[20, 70] = 0, 255
    lower, raise_ = images.costs(image)
    wet = images.WET
    assert (lower[:16] == wet).all() and (raise_[:, -16:] == wet).all() and (lower[33:47, 33:47] == wet).all()
    assert lower[20, 20] == wet != raise_[20, 20] and raise_[20, 70] == wet != lower[20, 70]
    both = (lower != wet) & (raise_ != wet)
    assert both.any() and (lower[both] == raise_[both]).all() and lower[both].min() >= 1


def test_png_and_pgm():
    image = image_jobs.synthetic_cover(1, 512, 513)
    data = images.encode_png(image)
    assert (images.decode_png(data) == image).all()
    small = images.encode_png(image[:20, :20])
    assert (images.decode_png(small, any_size=True) == image[:20, :20]).all()
    for bad in (b"", data[:100], data[:-4], data.replace(b"IDAT", b"IDAX", 1), small, data[:40] + b"x" + data[41:]):
        with pytest.raises(ValueError):
            images.decode_png(bad)
    assert (images.decode_pgm(b"P5\n# note\n4 2\n255\n" + bytes(range(8))) == np.arange(8).reshape(2, 4)).all()
    for bad in (b"", b"P2\n1 1\n255\n1", b"P5\n4 4\n255\nxx", b"P5 4"):
        with pytest.raises(ValueError):
            images.decode_pgm(bad)


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    image, rows = rng.integers(0, 256, (6, 7)).astype(np.uint8), []
    for y in range(6):
        line = [kind]
        for x in range(7):
            left, up, corner = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            e = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(e - v))
            line.append((int(image[y, x]) - {1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]) & 255)
        rows.append(line)
    assert (images._unfilter(np.array(rows, np.uint8)) == image).all()


def test_balancing_lowers_the_objective_it_tracks():
    cover = image_jobs.synthetic_cover(13, 72, 88)
    cover[:, 50:] = (cover[:, 50:].astype(int) // 4 + 90).astype(np.uint8)
    stego = images.lsb_control(cover, 5, 0.03)
    out, turns, before, after = codec.balance_signs(cover, stego)
    counts, delta = codec.balance_histograms(cover, out)
    assert turns > 0 and after < before and after == pytest.approx(codec.balance_objective(counts, delta), abs=1e-9)
    assert counts.sum() == 8 * 3 * 68 * 84 and delta.sum() == 0
    assert ((out ^ stego) & 1).max() == 0 and np.abs(out.astype(int) - cover).max() == 1 and (out[:16] == stego[:16]).all()
    with pytest.raises(ValueError):
        codec.balance_signs(cover, (cover ^ 3).astype(np.uint8))


def test_embedding_tells_its_progress_and_refuses_flat_images():
    told = []
    cover = image_jobs.synthetic_cover(14)
    stego, info = codec.embed(cover, b"", (1, 400), None, random_bytes=codec.Stream(KEY).take, progress=lambda p, s: told.append(p))
    assert told == sorted(told) and told[-1] == 100 and codec.extract(stego, (1, 400)) == b"" and info["message_bytes"] == 0
    with pytest.raises(codec.EmbeddingError, match="dry"):
        codec.embed(np.full((512, 512), 100, np.uint8), b"x", (1, 20), KEY)
    with pytest.raises(ValueError):
        codec.extract(cover, (1, 20), KEY)


def test_round_trips_on_spark(spark):
    covers = image_jobs.synthetic_covers(spark.createDataFrame([("7",), ("8",), ("x",)], "image_id string"))
    jobs = covers.withColumn("message", F.lit(b"a message")).withColumn("key", F.when(F.col("image_id") == "7", F.lit(KEY))).withColumn("num", F.lit(1)).withColumn("den", F.when(F.col("image_id") == "7", 400).otherwise(2))
    out = {r["image_id"]: r for r in image_jobs.extract(image_jobs.embed(jobs, balanced=False)).collect()}
    assert bytes(out["7"]["recovered"]) == b"a message" and out["7"]["failure"] is None
    assert out["8"]["recovered"] is None and "rate" in out["8"]["failure"]
    files = spark.createDataFrame([("a", b"junk", 1), ("b", None, 2), ("c", images.encode_png(image_jobs.synthetic_cover(1)), 3)], "n string, content binary, width int")
    got = {r["n"]: r for r in image_jobs.decode(files).collect()}
    assert got["a"]["fault"] and got["b"]["fault"] and got["c"]["width"] == 512 and got["c"]["fault"] is None
    assert image_jobs.decode(files.limit(0)).count() == 0


def test_reduction_and_signature():
    flat = np.full((300, 310), 90, np.uint8)
    assert (images.reduce_image(flat) == 90).all() and images.signature(images.reduce_image(flat)) == 0
    ramp = np.tile(np.linspace(0, 255, 310).astype(np.uint8), (300, 1))
    assert images.signature(images.reduce_image(ramp)) == -1


def test_subspace_ensemble_equals_numpy_and_separates(spark):
    rng = np.random.default_rng(631)
    x = np.r_[rng.normal(0, 1, (100, 20)), rng.normal(1, 1, (90, 20))]
    y = np.r_[np.zeros(100, int), np.ones(90, int)]
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [(900, None, 1), (901, [1.0], 0), (902, [0.0] * 20, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    model = detectors.fit_subspace_ensemble(df, "v", "y", 20, learners=5, dimension=8)
    d, w, b, s = model.learners[0]
    z = (x[:, d] - x.mean(0)[d]) / x.std(0)[d]
    m0, m1 = z[y == 0].mean(0), z[y == 1].mean(0)
    c = z - np.where(y[:, None] == 0, m0, m1)
    cov = c.T @ c / (len(z) - 2)
    want = np.linalg.solve(0.8 * cov + 0.2 * np.diag(np.maximum(np.diag(cov), 0.01)) + np.eye(8) * 1e-5, m1 - m0)
    assert np.allclose(w, want) and np.isclose(b, (m0 + m1) @ want / 2) and np.isclose(s, np.std(z @ want))
    got = {r["id"]: r["score"] for r in model.score(df, "v").collect()}
    assert got[900] is None and got[901] is None
    score = np.array([got[i] for i in range(190)])
    assert np.mean(score[y == 1][:, None] > score[y == 0][None]) > 0.95


def test_unfitted_scores_equal_numpy(spark):
    f = images.features_with_container(image_jobs.synthetic_cover(2, 64, 64))
    df = spark.createDataFrame([(f.tolist(),)], "f array<float>")
    chi, rs = df.select(detectors.adjacent_bin_score(F.col("f")), detectors.regularity_score(F.col("f"))).head()
    h = f[-403:-147].astype(float)
    assert chi == pytest.approx(-(((h[::2] - h[1::2]) ** 2) / np.maximum(h[::2] + h[1::2], 1e-12)).sum(), rel=1e-6)
    r = f[-19:-1].astype(float).reshape(6, 3)
    assert rs == pytest.approx(-np.mean(r[:, 0] - r[:, 1]), abs=1e-6)


def test_messages_of_every_kind():
    for key in (KEY, None):
        schedule = codec.Schedule(512, 512, 4000, key)
        ctx, keys = schedule.context, schedule.salted(SALT)
        for m in (b"", bytes(range(256)), b"compressible" * 200, zlib.compress(b"x" * 99)):
            body = codec.build_body(m, 4000, key, ctx, SALT, keys, bytes)
            assert codec.parse_body(body, key, ctx, SALT, keys) == m


def test_covers_have_their_own_sizes(spark, tables):
    from sieveline.plans import kernels as plans

    want = {r["image_id"]: (r["width"], r["height"]) for r in spark.read.parquet(tables + "/reference_cover.parquet").collect()}
    got = {r["image_id"]: (r["width"], r["height"], len(r["pixels"])) for r in plans._covers(spark, tables).collect()}
    assert got == {k: (w, h, w * h) for k, (w, h) in want.items()} and len(set(want.values())) > 1


def test_ensembles_are_registered_whole(spark, tables, monkeypatch):
    from sieveline.operators import detectors
    from sieveline.plans import kernels as plans

    seen = []
    fit = detectors.fit_subspace_ensemble
    monkeypatch.setattr(detectors, "fit_subspace_ensemble", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    plans.m8_harness(spark, tables)
    assert any(isinstance(v, list) and len(v) == 64 and all(len(x[0]) == 64 for x in v) for v in vars(seen[0]).values())


def test_models_are_saved_and_loaded(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(i % 2, 1, 6).tolist(), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int")
    model = detectors.fit_subspace_ensemble(df, "v", "y", 6, learners=3, dimension=4)
    model.save(spark, str(tmp_path / "m"))
    again = detectors.SubspaceEnsemble.load(spark, str(tmp_path / "m"))
    score = lambda m: {r["id"]: r["score"] for r in m.score(df, "v").collect()}
    assert score(again) == score(model)
    with pytest.raises(Exception):
        model.save(spark, str(tmp_path / "m"))
    forest = detectors.fit_forest(df, "v", "y", trees=5)
    detectors.save_forest(forest, str(tmp_path / "f"))
    a, b = ({r["id"]: r["score"] for r in detectors.score_forest(f, df, "v").collect()} for f in (forest, detectors.load_forest(str(tmp_path / "f"))))
    assert a == b and len(a) == 80


def test_a_forest_scores_in_a_session_that_compacted(spark, tables):
    """All rows are collected: a count would not compute the scores."""
    from sieveline.plans import catalogue

    assert catalogue.QUERIES["p4_found"](spark, tables).count() > 0
    got = catalogue.QUERIES["m4_forest"](spark, tables).collect()
    assert got and all(0 <= r["score"] <= 1 for r in got)


class _Caught:
    """Stands for a table: gives the function that would run over its batches."""

    def __init__(self, columns, kept):
        self.columns, self.schema = columns, kept

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):  # noqa: N802
        return run


def test_results_leave_a_task_in_small_pieces(spark):
    """A batch of thousands of small rasters gives features hundreds of times its size; they never stand together."""
    rng = np.random.default_rng(4)
    stack = rng.integers(0, 256, (700, 8, 9)).astype(np.uint8)
    pdf = pd.DataFrame({"image_id": [str(i) for i in range(700)], "width": 9, "height": 8, "pixels": [x.tobytes() for x in stack]})
    pdf.loc[5, "pixels"], pdf.loc[6, "height"] = None, 7
    table = _Caught(list(pdf.columns), spark.createDataFrame([], "image_id string, width int, height int").schema)
    pieces = list(image_jobs.extract_features(table)(iter([pdf])))
    assert max(len(p) for p in pieces) * 8177 * 4 <= image_jobs.PIECE and sum(map(len, pieces)) == 700
    out = pd.concat(pieces, ignore_index=True)
    assert list(out["image_id"]) == list(pdf["image_id"]) and list(out.index[out["fault"].notna()]) == [5, 6] and out["features"][5] is None
    assert all((out["features"][i] == images.features_with_container(stack[i])).all() for i in (0, 4, 7, 128, 699))
    big = pd.DataFrame({"image_id": ["1", "2", "3"], "width": 2048, "height": 2048, "pixels": [rng.integers(0, 256, 1 << 22).astype(np.uint8).tobytes()] * 3})
    assert [len(p) for p in image_jobs.png_files(table)(iter([big]))] == [1, 1, 1]
