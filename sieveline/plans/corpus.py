"""Queries on corpus preparation (inventory J6, J7, J10, G1, W1, W2, O2, U2, U4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.signatures import described
from sieveline.operators import corpus
from sieveline.plans.tables import SAMPLES, image_groups, image_parts, read

#: Shares of the images, in hundredths, that the split's parts aim at.
SHARES = {"train": 12, "validation": 4, "test": 10}


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(read(spark, sf_dir, "source_image", "image_id", "signature", "pixel_sha256", "small"))


def j6_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.near_pairs(corpus.signature_classes(_described(spark, sf_dir)))


def j6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which class of equal signatures each image is in: the membership for the pairs of representatives."""
    images = _described(spark, sf_dir).select("image_id", "signature").dropna().distinct()
    classes = corpus.signature_classes(images).withColumnRenamed("image_id", "class_id")
    return images.join(classes, "signature").select("image_id", "class_id", "copies")


def j7_exact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_links(_described(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = j6_near_pairs(spark, sf_dir).select(F.col("image_a").alias("src"), F.col("image_b").alias("dst"))
    same = j6_classes(spark, sf_dir).select(F.col("class_id").alias("src"), F.col("image_id").alias("dst"))
    return near.unionByName(same).unionByName(j7_exact_links(spark, sf_dir))


def g1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source groups: images linked by digest or signature, directly or through others."""
    return corpus.components(_links(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_groups(spark, sf_dir).groupBy("group_id").agg(F.min("image_id").alias("first"), F.count(F.lit(1)).alias("size"))


def w1_greedy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = corpus.materialize(_groups(spark, sf_dir), "groups")
    n = groups.agg(F.sum("size")).head()[0] or 0
    return corpus.greedy_split(groups, {p: n * s // 100 for p, s in SHARES.items()})


def o2_hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups in hash order."""
    rows = _groups(spark, sf_dir).select("group_id", corpus.hash_order(F.col("first")).alias("h"))
    return rows.orderBy("h")


def _listed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing (image_id, part, ordinal) by the part its spelling stands for; others name no part."""
    spelled = read(spark, sf_dir, "split_part").select(F.col("spelling").alias("part"), F.col("part").alias("known"))
    rows = read(spark, sf_dir, "manifest_split", "image_id", "part", "ordinal").filter("image_id is not null")
    return rows.join(F.broadcast(spelled), "part").select("image_id", F.col("known").alias("part"), "ordinal")  # a fixed list


def w2_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120, 60 and 120 images of train, validation and test by ordinal, as a probe takes them.

    An image listed more than once counts with its least ordinal.
    """
    rows = _listed_parts(spark, sf_dir).filter(F.col("part").isin("train", "validation", "test") & F.col("ordinal").isNotNull())
    first = rows.groupBy("image_id", "part").agg(F.min("ordinal").alias("ordinal"))
    limit = F.when(F.col("part") == "validation", 60).otherwise(120)
    # a rank with a bound below it is cut per task before the shuffle
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("ordinal", "image_id"))).filter("rank <= 120")
    return ranked.filter(F.col("rank") <= limit)


def j10_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and groups in several parts, and how many images have a part."""
    rows = _listed_parts(spark, sf_dir).select("image_id", "part").distinct()
    return corpus.leakage_report(rows.join(image_groups(spark, sf_dir), "image_id", "left"))


def u2_concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the named parts together."""
    return image_parts(spark, sf_dir).filter(F.col("part").isin("train", "validation"))


def u4_unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the corpus that no part holds."""
    return read(spark, sf_dir, "source_image", "image_id").subtract(image_parts(spark, sf_dir).select("image_id"))


QUERIES = {
    f.__name__: f
    for f in (j6_near_pairs, j6_classes, j7_exact_links, g1_components, w1_greedy_split, o2_hash_order, w2_first_k, j10_leakage, u2_concat_parts, u4_unsplit)
}

_DESCRIBED = """
images AS (
  SELECT DISTINCT image_id, coalesce(pixel_sha256, sha256(small)) AS pixel_sha256, coalesce(signature, CASE WHEN octet_length(small) = 72 THEN
    (CASE WHEN b >= 9223372036854775808::HUGEINT THEN b - 18446744073709551616::HUGEINT ELSE b END)::BIGINT END) AS signature
  FROM (SELECT image_id, signature, pixel_sha256, small, CASE WHEN small IS NOT NULL THEN list_reduce(list_transform(range(64), lambda i:
    CASE WHEN substr(hex(small), 2 * (i // 8 * 9 + i % 8 + 1) + 1, 2) > substr(hex(small), 2 * (i // 8 * 9 + i % 8) + 1, 2)
      THEN 1::HUGEINT ELSE 0::HUGEINT END), lambda x, y: x * 2 + y) END AS b FROM source_image)
  WHERE image_id IS NOT NULL)
"""
_CLASSES = _DESCRIBED + ", classes AS (SELECT signature, min(image_id) AS image_id, count(DISTINCT image_id) AS copies FROM images WHERE signature IS NOT NULL GROUP BY signature)"
_PAIRS = """SELECT DISTINCT x.image_id AS image_a, y.image_id AS image_b, bit_count(xor(x.signature, y.signature))::INT AS distance
FROM classes x JOIN classes y ON x.image_id < y.image_id AND bit_count(xor(x.signature, y.signature)) <= 4"""
_MEMBERS = "SELECT DISTINCT i.image_id, c.image_id AS class_id, c.copies FROM images i JOIN classes c USING (signature)"
_EXACT = """SELECT DISTINCT src, image_id AS dst FROM images JOIN (
  SELECT pixel_sha256, min(image_id) AS src FROM images GROUP BY pixel_sha256) USING (pixel_sha256) WHERE src <> image_id"""
_GROUPS = "WITH " + SAMPLES + ", g AS (SELECT group_id, min(image_id) AS first, count(*) AS size FROM image_groups GROUP BY group_id)"

ORACLE = {
    "j6_near_pairs": "WITH " + _CLASSES + _PAIRS,
    "j6_classes": "WITH " + _CLASSES + _MEMBERS,
    "j7_exact_links": "WITH " + _DESCRIBED + _EXACT,
    "g1_components": "WITH RECURSIVE " + _CLASSES + f""", links AS (SELECT image_a AS a, image_b AS b FROM ({_PAIRS}) UNION ALL SELECT class_id, image_id FROM ({_MEMBERS})
      UNION ALL SELECT src, dst FROM ({_EXACT})),
      ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
      reach AS (SELECT a AS id, a AS root FROM ways UNION SELECT w.b, r.root FROM reach r JOIN ways w ON w.a = r.id AND r.root < w.b)
      SELECT id, min(root) AS root FROM reach GROUP BY id""",
    "w1_greedy_split": _GROUPS + """,
      n AS (SELECT sum(size)::BIGINT AS n FROM g),
      c AS (SELECT *, sum(size) OVER (ORDER BY sha256('split-93191:' || first)) AS cum FROM g),
      s1 AS (SELECT coalesce(min(cum), 1e18::BIGINT) AS e FROM c, n WHERE cum >= n * 12 // 100),
      s2 AS (SELECT coalesce(min(cum), 1e18::BIGINT) AS e FROM c, n, s1 WHERE cum >= s1.e + n * 4 // 100),
      s3 AS (SELECT coalesce(min(cum), 1e18::BIGINT) AS e FROM c, n, s2 WHERE cum >= s2.e + n * 10 // 100)
      SELECT group_id, size, CASE WHEN cum <= s1.e THEN 'train' WHEN cum <= s2.e THEN 'validation' WHEN cum <= s3.e THEN 'test' ELSE 'reserve' END AS part FROM c, s1, s2, s3""",
    "o2_hash_order": _GROUPS + "SELECT group_id, sha256('split-93191:' || first) AS h FROM g ORDER BY h",
    "w2_first_k": """SELECT image_id, part, ordinal, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ordinal, image_id) AS rank
      FROM (SELECT image_id, p.part, min(ordinal) AS ordinal FROM manifest_split s JOIN split_part p ON s.part = p.spelling
        WHERE image_id IS NOT NULL AND ordinal IS NOT NULL AND p.part IN ('train', 'validation', 'test') GROUP BY ALL))
      WHERE rank <= CASE WHEN part = 'validation' THEN 60 ELSE 120 END""",
    "j10_leakage": "WITH " + SAMPLES + """, listed AS (SELECT DISTINCT image_id, p.part, group_id FROM manifest_split s JOIN split_part p ON s.part = p.spelling LEFT JOIN image_groups USING (image_id) WHERE image_id IS NOT NULL)
      SELECT 'image' AS kind, image_id AS id, count(DISTINCT part) AS parts FROM listed GROUP BY image_id HAVING count(DISTINCT part) > 1
      UNION ALL SELECT 'group', group_id, count(DISTINCT part) FROM listed WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT part) > 1
      UNION ALL SELECT 'total', NULL, count(DISTINCT image_id) FROM listed""",
    "u2_concat_parts": "WITH " + SAMPLES + "SELECT image_id, part FROM image_parts WHERE part IN ('train', 'validation')",
    "u4_unsplit": "WITH " + SAMPLES + "SELECT DISTINCT image_id FROM source_image WHERE image_id NOT IN (SELECT image_id FROM image_parts WHERE image_id IS NOT NULL)",
}
