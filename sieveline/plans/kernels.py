"""Queries that run kernels and detectors (inventory S1-S3, S8, P17, K1-K19, M1-M4, M8) and their SQL.

Where SQL can compute the same, it does: HMAC is two nested SHA-256, filters are joins with a table of taps, a shuffle
and a trellis are enumerated on small inputs. The codec's known bytes stand as VALUES.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.kernels import codec, images
from sieveline.kernels import statistics as st
from sieveline.operators import detectors, image_jobs, rasters
from sieveline.operators import evaluation as ev
from sieveline.plans.rasters import _FEATURES, _MOMENTS, _PX, HEIGHT, WIDTH, _images
from sieveline.plans.tables import read
from sieveline.session import input_partitions, materialize, new_path

DIM = 64
#: The deliberately public key of test populations, and the salt and padding that go with it in known examples.
BENCH_KEY, BENCH_SALT, BENCH_PAD = bytes(range(32)), bytes(range(32, 64)), bytes(range(64, 74))


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced raster of every image as an image of its own: image_id, width, height, pixels."""
    rows = _images(spark, sf_dir).filter(F.octet_length("small") == WIDTH * HEIGHT)
    return rows.select("image_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.col("small").alias("pixels"))


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic image of its size for each of the reference covers (a fixed table of twelve), one a task."""
    ids = read(spark, sf_dir, "reference_cover", "image_id", "width", "height").distinct()
    return image_jobs.synthetic_covers(ids.repartition(12, "image_id"))


def s1_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every raster after it was written as a PNG and strictly read again (S1, S2)."""
    files = image_jobs.png_files(_small(spark, sf_dir)).select("image_id", "content")
    return image_jobs.decode(files, any_size=True).select("image_id", "width", "height", F.sha2("pixels", 256).alias("pixel_sha256"), "fault")


def s3_pgm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for PGM files."""
    head = F.lit(f"P5\n{WIDTH} {HEIGHT}\n255\n".encode())
    files = _small(spark, sf_dir).select("image_id", F.concat(head, "pixels").alias("content"))
    return image_jobs.decode(files, kind="pgm", any_size=True).select("image_id", "width", "height", F.sha2("pixels", 256).alias("pixel_sha256"), "fault")


def k1_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_jobs.hashes(_small(spark, sf_dir)).select("image_id", "pixel_sha256", "signature")


def k1_cover_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_jobs.hashes(_covers(spark, sf_dir)).select("image_id", "pixel_sha256", "signature")


def _described(spark: SparkSession, sf_dir: str, schema: str, job) -> DataFrame:
    return rasters.describe_images(_images(spark, sf_dir), "small", WIDTH, HEIGHT, ["image_id"], schema, job)


def k2_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster's low-pass along its columns, anchor 7: the sum of every row's values."""
    low = np.array(images.WAVELET)
    rows = _described(spark, sf_dir, "v array<double>", lambda x: {"v": [images._along(i.astype(float), low, 7, 0).sum(1) for i in x]})
    return rows.select("image_id", F.posexplode("v").alias("y", "total"))


#: Side of the square test image of k3, whose pixel at (y, x) is a formula that SQL shares.
K3_SIDE = 64


def k3_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of lowering and raising every pixel of a test image made by a formula; -1 where it must not be done."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for _ in range(len(pdf)):
                y, x = np.mgrid[:K3_SIDE, :K3_SIDE]
                price = [np.where(c == images.WET, -1, c.astype(np.int64)).ravel() for c in images.costs(((x * x * 3 + y * 7 + x * y % 11 * 5) % 256).astype(np.uint8))]
                yield pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "lower": price[0], "raise": price[1]})

    return spark.range(1).mapInPandas(run, "y int, x int, lower bigint, raise bigint")


def k4_filter_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and absolute sum of every raster's residuals, by filter."""

    def job(x: np.ndarray) -> dict[str, list]:
        rs = np.stack([st.residual(x, taps) for taps in st.feature_taps()], 1)
        return {"total": list(rs.sum((2, 3))), "absolute": list(np.abs(rs).sum((2, 3)))}

    rows = _described(spark, sf_dir, "total array<bigint>, absolute array<bigint>", job)
    return rows.select("image_id", F.posexplode(F.arrays_zip("total", "absolute")).alias("filter", "v")).select("image_id", "filter", "v.total", "v.absolute")


def k5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every raster: their number and sum, and both unfitted detectors' scores (M1, M2)."""
    small = _small(spark, sf_dir)
    rows = image_jobs.extract_features(small.repartition(input_partitions(small), "image_id"))  # the work is in the kernel, not in the bytes
    return _scored(rows).select("image_id", "n", "total", "adjacent_bins", "regularity")


def _scored(rows: DataFrame) -> DataFrame:
    # without the last feature, which depends on the encoder
    total = F.aggregate(F.slice("features", 1, F.size("features") - 1), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rows.withColumns({
        "n": F.size("features"), "total": F.round(total, 3),
        "adjacent_bins": F.round(detectors.adjacent_bin_score(F.col("features")), 5), "regularity": F.round(detectors.regularity_score(F.col("features")), 5),
    })


def k5_cover_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(image_jobs.extract_features(_covers(spark, sf_dir))).select("image_id", "n", "total", "adjacent_bins", "regularity")


def k6_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positive control of every raster, seeded by the image's number: pixels that changed, all of them by their low bit."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pairs = [(np.frombuffer(bytes(p), np.uint8).reshape(HEIGHT, WIDTH), int(i)) for p, i in zip(pdf["pixels"], pdf["image_id"])]
            turned = [x ^ images.lsb_control(x, i) for x, i in pairs]
            yield pd.DataFrame({"image_id": pdf["image_id"], "changed": [int((t > 0).sum()) for t in turned], "low_bit_only": [bool((t <= 1).all()) for t in turned]})

    return _small(spark, sf_dir).filter("image_id rlike '^[0-9]+$'").mapInPandas(run, "image_id string, changed int, low_bit_only boolean")


def _known_rows(spark: SparkSession, rows: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(name, value.hex()) for name, value in rows], "name string, value string")


def _known() -> tuple[codec.Schedule, dict[str, bytes]]:
    schedule = codec.Schedule(512, 512, 81, BENCH_KEY)
    return schedule, schedule.salted(BENCH_SALT)


def k7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 0 to 499 of the stream of the public test key."""
    data = codec.Stream(BENCH_KEY).take(500 * 32)
    return spark.createDataFrame([(j, data[32 * j : 32 * j + 32].hex()) for j in range(500)], "j int, block string")


def k16_key_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    schedule, keys = _known()
    fixed = [(name, schedule.fixed(name)) for name in ("split", "head-code")]
    return _known_rows(spark, [("context", schedule.context), ("root", schedule.root), *fixed, *keys.items()])


def k17_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame of HELLO, sealed, the whitening bytes, the body, and what is parsed out of it."""
    schedule, keys = _known()
    pad = lambda n: BENCH_PAD[:n]
    plain = codec.plain_frame(b"HELLO", 81, True, pad)
    sealed = codec.seal(keys["aead"], bytes(12), plain, codec.AAD + schedule.context + BENCH_SALT)
    body = codec.build_body(b"HELLO", 81, BENCH_KEY, schedule.context, BENCH_SALT, keys, pad)
    parsed = codec.parse_body(body, BENCH_KEY, schedule.context, BENCH_SALT, keys)
    return _known_rows(spark, [("frame", plain), ("encrypted", sealed), ("whitening", codec.Stream(keys["whiten"]).take(49)), ("body", body), ("message", parsed)])


#: Sizes of the inputs of k8 to k14; the SQL enumerates the small ones.
K8_N, K10_N, K10_M, K11_N, K11_M, K11_HEIGHT = 64, 4096, 205, 12, 4, 3


def k8_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of 64 numbers shuffled under the public test key."""
    return spark.createDataFrame(list(enumerate(codec.shuffled(np.arange(K8_N), BENCH_KEY).tolist())), "place int, value int")


def k9_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, least and greatest position and sum of the two pools of a 512 x 512 image; together they are all positions once."""
    schedule, keys = _known()
    layout = codec.Layout(512 * 512, schedule)
    pools = {"head": layout.head, "body": layout.body(keys)}
    both = np.bincount(np.concatenate(list(pools.values())), minlength=512 * 512)
    return spark.createDataFrame([(name, len(at), len(np.unique(at)), bool((both == 1).all())) for name, at in pools.items()], "pool string, positions int, distinct_positions int, whole boolean")


def k10_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity columns of a matrix of 4,096 columns and 205 rows under the public test key."""
    parity = codec.Parity(K10_N, K10_M, BENCH_KEY)
    return spark.createDataFrame(list(zip(range(K10_N), parity.row.tolist(), parity.columns().tolist())), "i int, r int, word int")


def _k11() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.arange(K11_N)
    return (i * 7 % 3 == 0).astype(np.uint8), np.where(i % 5 == 4, images.WET, i * 13 % 9 + 1).astype(np.uint32), codec.Parity(K11_N, K11_M, BENCH_KEY, K11_HEIGHT).columns()


def k11_trellis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost of every syndrome that can be reached without wet pixels, and the syndrome of the parities found."""
    parity, cost, matrix = _k11()
    rows = []
    for code in range(1 << K11_M):
        target = np.array([code >> k & 1 for k in range(K11_M)], np.uint8)
        try:
            found, best = codec.trellis_embed(parity, cost, target, matrix, K11_HEIGHT)
        except codec.EmbeddingError:
            continue
        rows.append((code, best, int(codec.trellis_extract(found, K11_M, matrix, K11_HEIGHT) @ (1 << np.arange(K11_M)))))
    return spark.createDataFrame(rows, "target int, cost bigint, syndrome int")


def k12_syndrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syndrome of parities under the matrix of k10, by whole columns (K12) and by those of set parities alone (K13)."""
    i = np.arange(K10_N)
    parity, matrix = (i * i % 7 < 3).astype(np.uint8), codec.Parity(K10_N, K10_M, BENCH_KEY)
    whole, lazy = codec.trellis_extract(parity, K10_M, matrix.columns()), matrix.syndrome(parity)
    return spark.createDataFrame(list(zip(range(K10_M), whole.tolist(), lazy.tolist())), "r int, bit int, lazy_bit int")


def k14_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels moved in their cheaper direction, ties by the stream's bits."""
    i = np.arange(500)
    out = codec._signed((i % 200 + 20).astype(np.uint8), i, i % 5, i % 3, codec.Stream(BENCH_KEY))
    return spark.createDataFrame(list(zip(i.tolist(), out.tolist())), "i int, value int")


def k15_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of every cover's low-bit control: turns, and the objective before and after, which it never raises."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i, w, h, p in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["pixels"]):
                cover = np.frombuffer(bytes(p), np.uint8).reshape(h, w)
                out, turns, before, after = codec.balance_signs(cover, images.lsb_control(cover, int(i), 0.002))
                yield pd.DataFrame({"image_id": [i], "turns": [turns], "before": [before], "after": [after], "lowered": [after <= before]})

    return _covers(spark, sf_dir).mapInPandas(run, "image_id string, turns int, before double, after double, lowered boolean")


def k18_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embed a digest into every cover at the least rate that fits and read it back (K18, K19)."""
    message = F.unhex(F.sha2(F.concat(F.lit("payload:"), F.col("image_id")), 256))
    jobs = _covers(spark, sf_dir).withColumns({"message": message, "key": F.lit(BENCH_KEY), "num": F.lit(49), "den": F.lit(16384)})
    done = image_jobs.extract(materialize(image_jobs.embed(jobs), "stegos"))
    return done.select("image_id", "failure", F.lower(F.hex("recovered")).alias("recovered"), (F.col("changed_pixels") > 0).alias("changed"))


def q_p17_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels inside each raster that are not flat, and whether they are enough for half of them to be bits."""

    def job(x: np.ndarray) -> dict[str, list]:
        total, squares = st.moments(x)
        return {"dry": (25 * squares - total * total > images.FLAT).sum((1, 2)).tolist()}

    inside = (WIDTH - 2 * st.RIM) * (HEIGHT - 2 * st.RIM)
    return _described(spark, sf_dir, "dry bigint", job).withColumn("admitted", F.col("dry") * 2 >= inside)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("label", F.pmod("label", F.lit(2)).cast("int"))


def m3_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all vectors by an ensemble fitted on them, saved and loaded (S8)."""
    rows, path = _vectors(spark, sf_dir), new_path(spark, "ensemble")
    detectors.fit_subspace_ensemble(rows, "embedding", "label", DIM).save(spark, path)
    return detectors.SubspaceEnsemble.load(spark, path).score(rows, "embedding")


def m4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a random forest."""
    rows = _vectors(spark, sf_dir)
    return detectors.score_forest(detectors.fit_forest(rows, "embedding", "label"), rows, "embedding")


def m8_harness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on one part, freeze direction and thresholds on the second, report error rates of the third."""
    part = F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(3))
    rows = materialize(_vectors(spark, sf_dir).withColumn("part", part).withColumn("detector", F.lit("subspace")), "vectors")
    model = detectors.fit_subspace_ensemble(rows.filter("part = 0"), "embedding", "label", DIM)
    scored = materialize(model.score(rows.filter("part > 0"), "embedding"), "scored")
    calibration = materialize(ev.calibrate(scored.filter("part = 1"), ["detector"]), "calibration")
    return ev.error_rates(ev.oriented(scored.filter("part = 2"), calibration, ["detector"]), ["detector"])


QUERIES = {
    f.__name__: f
    for f in (
        s1_png, s3_pgm, k1_hashes, k1_cover_hashes, k2_correlation, k3_costs, k4_filter_bank, k5_features, k5_cover_features, k6_control, k7_stream, k8_permutation, k9_pools,
        k10_columns, k11_trellis, k12_syndrome, k14_signs, k15_balance, k16_key_schedule, k17_frame, k18_round_trip, q_p17_admission, m3_subspace, m4_forest, m8_harness,
    )
}

# SQL


def _hmac(key: bytes, message: str) -> str:
    """HMAC-SHA-256, as hex, of a message given as an SQL expression of hex digits."""
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}' || sha256(unhex('{inner}' || {message}))))"


_STREAM = _hmac(BENCH_KEY, f"'{codec.STREAM.hex()}' || printf('%016x', j)")
#: Byte k of the stream, as SQL.
_BYTES = f"stream AS (SELECT string_agg(b, '' ORDER BY j) AS hex FROM (SELECT j, {_STREAM} AS b FROM range(200) t(j)))"
_COLUMN = _hmac(BENCH_KEY, f"'{codec.COLUMN.hex()}' || printf('%08x', r) || printf('%016x', i)")


def _columns(n: int, m: int, height: int) -> str:
    """Parity columns as SQL: rows (i, r, word)."""
    ends = 1 | 1 << height - 1
    return f"""cols AS (SELECT i, r, ((('0x' || substr({_COLUMN}, 1, 4))::BIGINT & {(1 << height) - 1} | {ends}) & ((1::BIGINT << least({height}, {m} - r)::INT) - 1)) AS word
  FROM (SELECT i, ((i + 1) * {m} + {n} - 1) // {n} - 1 AS r FROM range({n}) t(i)))"""


_DIGEST = f"""SELECT image_id, {WIDTH} AS width, {HEIGHT} AS height, sha256(small) AS pixel_sha256, NULL::VARCHAR AS fault FROM (
  SELECT image_id, min(small) AS small FROM source_image WHERE image_id IS NOT NULL GROUP BY image_id) WHERE octet_length(small) = {WIDTH * HEIGHT}"""
_SIGNATURE = """list_reduce(list_transform(range(64), lambda i: CASE WHEN substr(hex(small), 2 * (i // 8 * 9 + i % 8 + 1) + 1, 2) > substr(hex(small), 2 * (i // 8 * 9 + i % 8) + 1, 2)
  THEN 1::HUGEINT ELSE 0::HUGEINT END), lambda x, y: x * 2 + y)"""


def _mirror(at: str, n: int) -> str:
    """Position at of a line of n that is continued by its mirror image, edge repeated."""
    j = f"((({at}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CASE WHEN {j} < {n} THEN {j} ELSE {2 * n - 1} - {j} END"


def _taps(name: str, values: np.ndarray) -> str:
    return f"{name}(k, w) AS (VALUES {', '.join(f'({k}, {float(v)!r}::DOUBLE)' for k, v in enumerate(values))})"


def _pass(out: str, src: str, taps: str, before: int, axis: str) -> str:
    """Correlation of a square image (y, x, v) along an axis: the pixel's tap is number `before`."""
    other = "x" if axis == "y" else "y"
    at = _mirror(f"p.{axis} + k - {before}", K3_SIDE)
    return f"{out} AS (SELECT p.y, p.x, sum(w * q.v) AS v FROM {src} p, {taps} JOIN {src} q ON q.{other} = p.{other} AND q.{axis} = {at} GROUP BY p.y, p.x)"


def _k3_sql() -> str:
    low = np.array(images.WAVELET)
    high = np.where(np.arange(16) % 2, low[::-1], -low[::-1])
    parts = [
        _taps("low", low), _taps("high", high), _taps("abs_low", np.abs(low[::-1])), _taps("abs_high", np.abs(high[::-1])),
        f"px AS (SELECT y, x, ((x * x * 3 + y * 7 + x * y % 11 * 5) % 256)::DOUBLE AS v FROM range({K3_SIDE}) a(y), range({K3_SIDE}) b(x))",
    ]
    for name, (down, across) in {"lh": ("low", "high"), "hl": ("high", "low"), "hh": ("high", "high")}.items():
        parts += [
            _pass(f"{name}1", "px", down, 7, "y"), _pass(f"{name}2", f"{name}1", across, 7, "x"), f"{name}3 AS (SELECT y, x, 1 / (1 + abs(v)) AS v FROM {name}2)",
            _pass(f"{name}4", f"{name}3", f"abs_{down}", 8, "y"), _pass(f"{name}5", f"{name}4", f"abs_{across}", 8, "x"),
        ]
    near = f"JOIN px q ON q.y BETWEEN p.y - 2 AND p.y + 2 AND q.x BETWEEN p.x - 2 AND p.x + 2 WHERE p.y BETWEEN 16 AND {K3_SIDE - 17} AND p.x BETWEEN 16 AND {K3_SIDE - 17}"
    return f"""WITH {', '.join(parts)},
dry AS (SELECT p.y, p.x FROM px p {near} GROUP BY p.y, p.x HAVING 25 * sum(q.v * q.v) - sum(q.v) ** 2 > {images.FLAT}),
price AS (SELECT px.y, px.x, px.v, greatest(1, floor(1000000 * (a.v + b.v + c.v) + 0.5::DOUBLE))::BIGINT AS price, dry.y IS NOT NULL AS dry
  FROM px JOIN lh5 a USING (y, x) JOIN hl5 b USING (y, x) JOIN hh5 c USING (y, x) LEFT JOIN dry ON dry.y = px.y AND dry.x = px.x)
SELECT y::INT AS y, x::INT AS x, CASE WHEN dry AND v <> 0 THEN price ELSE -1 END AS lower, CASE WHEN dry AND v <> 255 THEN price ELSE -1 END AS raise FROM price"""


_K2 = f"""WITH {_taps("low", np.array(images.WAVELET))}, one AS (SELECT image_id, hex(min(small)) AS h FROM source_image WHERE image_id IS NOT NULL GROUP BY image_id),
lines AS (SELECT image_id, i::INT AS y, list_sum(list_transform(range(9), lambda x: ('0x' || substr(h, 2 * (i * 9 + x) + 1, 2))::INT)) AS v FROM one, range(8) t(i) WHERE length(h) = 144)
SELECT p.image_id, p.y, sum(w * q.v) AS total FROM lines p, low JOIN lines q ON q.image_id = p.image_id AND q.y = {_mirror("p.y + k - 7", 8)} GROUP BY p.image_id, p.y"""

#: The codec's known bytes of HELLO in a 512 x 512 image at 81 bytes (fixed values).
_KEYS = {
    "context": "535445472d42502f31000002000000020000000000000000510a",
    "root": "11b53d92df33792c59f18a16b51c943241eb7ce3d69885aa4375381a2096a7d6",
    "aead": "b3a05c52cb127e8d1613e40b3ba325bc892d939201b69d729ec67de65f6f9468",
    "whiten": "3672f2cb8caf4c1202dfc0511caf6d93a0e515aef26dcc5d80b89249e54657f6",
    "split": "9cec63913e44c29c6ae8558e6b46747a8e62d0ba6c07bd0d001a85a4457768c5",
    "head-code": "0b4462edac3c894b46b5c491c253c7346fa0ee7effb7f381a0b918589941035d",
    "body-perm": "dd6e33952de438c10b4236527869a1198c4a7536e05fff7632d6f57f8c009129",
    "body-code": "4ffe8787166d4194b6bdc2c0381a89f0ea094f2a90523a3f09be1d5e3c11bf73",
    "sign": "f949bd7186f722e67757df89ed4557cb2c7ecc149f8b1b4e405b36f1b148b5d4",
}
_FRAME = {
    "frame": "01000000000000000005000000000000000548454c4c4f40414243444546474849",
    "encrypted": "d7d650dc70112fd37d025dc43b6341dd42bdee497c105e485896c6cdc68f22a1fe3083eb63756842fcbeb62a8fd25af85a",
    "whitening": "7c5ccb1954dd6987274daac4aa808cd86a44e0f4de804d2f3bccdbe779827cd08f64df35b27db9b438028c142736732ed8",
    "body": "ab8a9bc524cc46545a4ff70091e3cd0528f90ebda2901367635a1d2abf0d5e7171545cded108d1f6c4bc3a3ea8e429d682",
    "message": b"HELLO".hex(),
}


def _values(rows: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows.items()) + ") t(name, value)"


_K11 = f"""WITH {_columns(K11_N, K11_M, K11_HEIGHT)},
c AS (SELECT i, r, word, (i * 7 % 3 = 0)::INT AS parity, CASE WHEN i % 5 <> 4 THEN i * 13 % 9 + 1 END AS cost FROM cols),
tried AS (SELECT way, bit_xor(CASE WHEN way >> i::INT & 1 = 1 THEN word << r::INT ELSE 0 END) AS syndrome,
  sum(CASE WHEN way >> i::INT & 1 <> parity THEN cost ELSE 0 END) AS cost, bool_or(way >> i::INT & 1 <> parity AND cost IS NULL) AS wet FROM range({1 << K11_N}) t(way), c GROUP BY way)
SELECT syndrome::INT AS target, min(cost)::BIGINT AS cost, syndrome::INT AS syndrome FROM tried WHERE NOT wet GROUP BY syndrome"""
_K8 = f"""WITH RECURSIVE {_BYTES},
draw AS (SELECT i, (('0x' || substr(hex, (({K8_N} - 1 - i) * 16 + 1)::INT, 16))::UBIGINT % (i + 1)::UBIGINT)::BIGINT AS j FROM stream, range(1, {K8_N}) t(i)),
turn AS (SELECT {K8_N} - 1 AS i, range({K8_N}) AS a
  UNION ALL SELECT turn.i - 1, list_transform(a, lambda v, k: CASE WHEN k = turn.i + 1 THEN a[j + 1] WHEN k = j + 1 THEN a[turn.i + 1] ELSE v END) FROM turn JOIN draw USING (i))
SELECT (k - 1)::INT AS place, a[k]::INT AS value FROM turn, range(1, {K8_N + 1}) t(k) WHERE i = 0"""

ORACLE = {
    "s1_png": _DIGEST,
    "s3_pgm": _DIGEST,
    "k1_hashes": f"""SELECT image_id, sha256(small) AS pixel_sha256, (CASE WHEN b >= 9223372036854775808::HUGEINT THEN b - 18446744073709551616::HUGEINT ELSE b END)::BIGINT AS signature
      FROM (SELECT image_id, small, {_SIGNATURE} AS b FROM (SELECT image_id, min(small) AS small FROM source_image WHERE image_id IS NOT NULL GROUP BY image_id) WHERE octet_length(small) = 72)""",
    "k2_correlation": _K2,
    "k3_costs": _k3_sql(),
    "k4_filter_bank": _FEATURES + "SELECT image_id, filter, sum(r)::BIGINT AS total, sum(abs(r))::BIGINT AS absolute FROM res GROUP BY image_id, filter",
    "k7_stream": f"SELECT j::INT AS j, {_STREAM} AS block FROM range(500) t(j)",
    "k8_permutation": _K8,
    "k9_pools": "SELECT * FROM (VALUES ('head', 32768, 32768, true), ('body', 229376, 229376, true)) t(pool, positions, distinct_positions, whole)",
    "k10_columns": f"WITH {_columns(K10_N, K10_M, codec.HEIGHT)} SELECT i::INT AS i, r::INT AS r, word::INT AS word FROM cols",
    "k11_trellis": _K11,
    "k12_syndrome": f"""WITH {_columns(K10_N, K10_M, codec.HEIGHT)},
      set_bits AS (SELECT r + b AS r, count(*) % 2 AS bit FROM cols, range({codec.HEIGHT}) t(b) WHERE i * i % 7 < 3 AND word >> b::INT & 1 = 1 GROUP BY r + b)
      SELECT k::INT AS r, coalesce(bit, 0)::INT AS bit, coalesce(bit, 0)::INT AS lazy_bit FROM range({K10_M}) t(k) LEFT JOIN set_bits ON set_bits.r = k""",
    "k14_signs": f"""WITH {_BYTES}, p AS (SELECT i, i % 200 + 20 AS v, i % 5 AS down, i % 3 AS up FROM range(500) t(i)),
      ties AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM p WHERE down = up),
      coins AS (SELECT i, ('0x' || substr(hex, (2 * k + 1)::INT, 2))::INT & 1 AS up FROM ties, stream)
      SELECT p.i::INT AS i, (v + CASE WHEN down < p.up THEN -1 WHEN down > p.up THEN 1 WHEN coins.up = 1 THEN 1 ELSE -1 END)::INT AS value FROM p LEFT JOIN coins USING (i)""",
    "k16_key_schedule": _values(_KEYS),
    "k17_frame": _values(_FRAME),
    "k18_round_trip": "SELECT DISTINCT image_id, NULL::VARCHAR AS failure, sha256('payload:' || image_id) AS recovered, true AS changed FROM reference_cover",
    "q_p17_admission": _PX + _MOMENTS + "SELECT image_id, count(*) FILTER (variance > 1) AS dry, count(*) FILTER (variance > 1) * 2 >= 20 AS admitted FROM mom GROUP BY image_id",
}
