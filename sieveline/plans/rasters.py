"""Queries on image statistics (inventory A17-A24, A28, A29, W6, W7) and their SQL, over the reduced rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.kernels import statistics as st
from sieveline.operators import linear, rasters
from sieveline.plans.tables import read
from sieveline.session import materialize

WIDTH, HEIGHT, DIM = 9, 8, 64


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image once, with its archive and raster."""
    images = read(spark, sf_dir, "source_image", "image_id", "archive", "small").filter("image_id is not null")
    return images.groupBy("image_id").agg(F.min("archive").alias("archive"), F.min("small").alias("small"))


def _counts(spark: SparkSession, sf_dir: str, parts: st.Parts) -> DataFrame:
    return rasters.count_images(_images(spark, sf_dir), "small", WIDTH, HEIGHT, "archive", parts)


def a17_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, st.pixel_parts).select("archive", "value", "n")


def a17_pair_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even minus odd bin of every pair, dense over the 128 pairs of each archive."""
    hist = materialize(a17_histogram(spark, sf_dir), "histogram")
    dense = hist.groupBy("archive").agg(F.sum("n").alias("total")).select("archive", "total", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("pair"))
    sign = F.when(F.col("value") % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    pairs = hist.groupBy("archive", F.floor(F.col("value") / 2).cast("int").alias("pair")).agg(F.sum(sign).alias("d"))
    return dense.join(pairs, ["archive", "pair"], "left").select("archive", "pair", (F.coalesce("d", F.lit(0)) / F.col("total")).alias("difference"))


def a18_adjacent_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rasters.histograms(_images(spark, sf_dir), "small", WIDTH, HEIGHT, ["image_id"])
    return rows.select("image_id", rasters.adjacent_bins(F.col("bins"), F.lit(WIDTH * HEIGHT)).alias("score"))


def a23_rs_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.toggle_fractions(_counts(spark, sf_dir, st.toggle_parts), "archive")


def a19_rs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.toggle_score(a23_rs_fractions(spark, sf_dir), ["archive"])


def a22_local_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.local_moments(_images(spark, sf_dir), "small", WIDTH, HEIGHT)


def w7_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the residuals of all ten filters, two pixels inside, per archive."""
    return _counts(spark, sf_dir, st.residual_parts).select("archive", "filter", F.col("value").alias("r"), "n")


def w6_four_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four successive levels of all ten filters at step 1, along rows and columns, per archive."""
    return _counts(spark, sf_dir, st.code_parts).select("archive", "filter", F.col("value").alias("code"), "n")


def a20_cooccurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symmetry classes of four levels in both directions: ten filters at three steps, per archive."""
    return _counts(spark, sf_dir, st.class_parts).select("archive", "filter", "step", F.col("value").alias("class"), "n")


def a21_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the first four filters at step 1, by the variance stratum of the second of the four."""
    return _counts(spark, sf_dir, st.masked_parts).select("archive", "filter", "stratum", F.col("value").alias("class"), "n")


def a24_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance objective of every archive against all others: 8 filters, 4 strata, 3 steps and 17 bins."""
    return rasters.distance_from_rest(materialize(_counts(spark, sf_dir, st.balance_parts), "bins"), "archive")


def a28_vector_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.vector_moments(read(spark, sf_dir, "embeddings", "embedding"), "embedding")


def a29_class_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of every pair product of dimensions per class: what the pooled covariance is made of."""
    sums = linear.class_sums(read(spark, sf_dir, "embeddings", "embedding", "label"), "embedding", "label", DIM)
    rows = sums.select("label", "n", F.posexplode("products").alias("k", "p"))
    return rows.select("label", F.floor(F.col("k") / DIM).cast("int").alias("i"), (F.col("k") % DIM).alias("j"), (F.col("p") / F.col("n")).alias("mean_product"))


QUERIES = {
    f.__name__: f
    for f in (
        a17_histogram, a17_pair_difference, a18_adjacent_bins, a19_rs_score, a20_cooccurrences, a21_conditional, a22_local_moments, a23_rs_fractions,
        a24_objective, a28_vector_moments, a29_class_products, w6_four_taps, w7_residuals,
    )
}

_PX = """WITH one AS (SELECT image_id, min(archive) AS archive, hex(min(small)) AS h FROM source_image WHERE image_id IS NOT NULL GROUP BY image_id),
px AS (SELECT image_id, archive, (i // 9)::INT AS y, (i % 9)::INT AS x, ('0x' || substr(h, 2 * i + 1, 2))::INT AS value
  FROM (SELECT image_id, archive, h, unnest(range(72)) AS i FROM one WHERE length(h) = 144))
"""


def _filtered(filters: tuple[st.Taps, ...]) -> str:
    """Residuals r of filters at the pixels two inside, as SQL: a table of taps joined with the pixels they fall on."""
    taps = ", ".join(f"({f}, {down}, {across}, {weight})" for f, one in enumerate(filters) for down, across, weight in one)
    return f""", taps(filter, down, across, weight) AS (VALUES {taps}),
res AS (SELECT archive, image_id, filter, y - down AS y, x - across AS x, sum(weight * value)::INT AS r FROM px, taps
  WHERE y - down BETWEEN 2 AND 5 AND x - across BETWEEN 2 AND 6 GROUP BY archive, image_id, filter, y - down, x - across)
"""


def _level(most: int) -> str:
    return f"(sign(r) * least((2 * abs(r) + step) // (2 * step), {most}))::INT"


def _four(steps: str) -> str:
    """Codes of four successive levels, with the stratum of the second where the pixels have one."""
    ahead = lambda k: f"lead(l, {k}) OVER w"
    code = f"(l + 2) * 125 + ({ahead(1)} + 2) * 25 + ({ahead(2)} + 2) * 5 + {ahead(3)} + 2"
    one = lambda line, at: f"SELECT archive, filter, step, lead(stratum) OVER w AS stratum, {code} AS code FROM lv WINDOW w AS (PARTITION BY image_id, filter, step, {line} ORDER BY {at})"
    return f""", lv AS (SELECT *, {_level(2)} AS l FROM marked, (SELECT unnest([{steps}]) AS step)),
four AS (SELECT *, code // 125 AS a, code // 25 % 5 AS b, code // 5 % 5 AS c, code % 5 AS d FROM ({one("y", "x")} UNION ALL {one("x", "y")}) WHERE code IS NOT NULL),
classed AS (SELECT *, least(code, d * 125 + c * 25 + b * 5 + a, 624 - code, 624 - (d * 125 + c * 25 + b * 5 + a))::INT AS class FROM four)
"""


_MOMENTS = """, s1 AS (SELECT image_id, y, x, sum(value) OVER w AS s, sum(value * value) OVER w AS q, count(*) OVER w AS c FROM px WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s2 AS (SELECT image_id, y, x, sum(s) OVER w AS s, sum(q) OVER w AS q, sum(c) OVER w AS c FROM s1 WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
mom AS (SELECT image_id, y, x, s / 25 AS mean, (q * 25 - s * s) / 625 AS variance FROM s2 WHERE c = 25)
"""
_RS = """, g AS (SELECT archive, 'row' AS orientation, list(value ORDER BY x) AS v FROM px GROUP BY archive, image_id, y, x // 4 HAVING count(*) = 4
  UNION ALL SELECT archive, 'column', list(value ORDER BY y) FROM px GROUP BY archive, image_id, x, y // 4 HAVING count(*) = 4),
m AS (SELECT * FROM (VALUES (0, 1, 0, 1, 0), (1, 0, 1, 0, 1), (2, 1, 1, 1, 1)) t(mask, a, b, c, d)),
f AS (SELECT archive, orientation, mask, abs(xor(v[2], b) - xor(v[1], a)) + abs(xor(v[3], c) - xor(v[2], b)) + abs(xor(v[4], d) - xor(v[3], c))
  - abs(v[2] - v[1]) - abs(v[3] - v[2]) - abs(v[4] - v[3]) AS diff FROM g, m),
rs AS (SELECT archive, orientation, mask, avg((diff > 0)::INT) AS rises, avg((diff < 0)::INT) AS falls, avg((diff = 0)::INT) AS stays FROM f GROUP BY archive, orientation, mask)
"""
_STRATUM = "(CASE WHEN variance < 16 THEN 0 WHEN variance < 64 THEN 1 WHEN variance < 256 THEN 2 ELSE 3 END)::INT"
_FEATURES = _PX + _filtered(st.feature_taps())
_UNMARKED = ", marked AS (SELECT *, 0 AS stratum FROM res)"
_MARKED = f", marked AS (SELECT res.*, {_STRATUM} AS stratum FROM res JOIN mom USING (image_id, y, x))"

ORACLE = {
    "a17_histogram": _PX + "SELECT archive, value, count(*) AS n FROM px GROUP BY archive, value",
    "a17_pair_difference": _PX + """, t AS (SELECT archive, count(*) AS total FROM px GROUP BY archive)
      SELECT archive, pair, coalesce(d, 0) / total AS difference FROM (SELECT archive, total, unnest(range(128))::INT AS pair FROM t)
      LEFT JOIN (SELECT archive, (value // 2)::INT AS pair, sum(CASE WHEN value % 2 = 0 THEN 1 ELSE -1 END) AS d FROM px GROUP BY archive, value // 2) USING (archive, pair)""",
    "a18_adjacent_bins": _PX + """SELECT image_id, -sum((e - o) ** 2 / (e + o)) / sum(e + o) AS score FROM (
      SELECT image_id, value // 2 AS pair, count(*) FILTER (value % 2 = 0) AS e, count(*) FILTER (value % 2 = 1) AS o FROM px GROUP BY image_id, value // 2) GROUP BY image_id""",
    "a23_rs_fractions": _PX + _RS + "SELECT * FROM rs",
    "a19_rs_score": _PX + _RS + "SELECT archive, avg(falls - rises) AS score FROM rs GROUP BY archive",
    "w7_residuals": _FEATURES + "SELECT archive, filter, r, count(*) AS n FROM res GROUP BY archive, filter, r",
    "w6_four_taps": _FEATURES + _UNMARKED + _four("1") + "SELECT archive, filter, code::INT AS code, count(*) AS n FROM four GROUP BY archive, filter, code",
    "a20_cooccurrences": _FEATURES + _UNMARKED + _four("1, 2, 4") + "SELECT archive, filter, step, class, count(*) AS n FROM classed GROUP BY archive, filter, step, class",
    "a21_conditional": _PX + _filtered(st.feature_taps()[:4]) + _MOMENTS + _MARKED + _four("1")
    + "SELECT archive, filter, stratum, class, count(*) AS n FROM classed GROUP BY archive, filter, stratum, class",
    "a22_local_moments": _PX + _MOMENTS + "SELECT image_id, y, x, mean, variance FROM mom",
    "a24_objective": _PX + _filtered(st.BALANCE_FILTERS) + _MOMENTS + _MARKED + f""", bins AS (SELECT archive, filter, step, stratum, {_level(8)} AS value, count(*) AS n
      FROM marked, (SELECT unnest([1, 2, 4]) AS step) GROUP BY ALL),
      dense AS (SELECT a.archive, b.filter, b.step, b.stratum, b.value, b.n AS total FROM (SELECT DISTINCT archive FROM bins) a,
        (SELECT filter, step, stratum, value, sum(n) AS n FROM bins GROUP BY ALL) b)
      SELECT archive, sum((n - (total - n)) ** 2 / (total - n + 32))::DOUBLE AS distance FROM (
        SELECT d.*, coalesce(bins.n, 0) AS n FROM dense d LEFT JOIN bins ON bins.archive IS NOT DISTINCT FROM d.archive AND bins.filter = d.filter AND bins.step = d.step
          AND bins.stratum = d.stratum AND bins.value = d.value) GROUP BY archive""",
    "a28_vector_moments": """SELECT dim::INT AS dim, avg(v) AS mean, greatest(stddev_pop(v), 1e-6::DOUBLE) AS deviation, stddev_pop(v) > 1e-7 AS valid
      FROM (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY dim""",
    "a29_class_products": """WITH e AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS a, embedding FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64),
      p AS (SELECT label, i, a, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS b FROM e)
      SELECT label, i::INT AS i, j::INT AS j, avg(a * b) AS mean_product FROM p GROUP BY label, i, j""",
}
