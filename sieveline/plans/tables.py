"""Views of the tables that several queries share, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


VARIANTS = ("0.01", "0.025", "0.05", "auto")


def image_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part per image: the first by name of those its rows spell."""
    spelled = read(spark, sf_dir, "split_part").select(F.col("spelling").alias("part"), F.col("part").alias("known"))
    rows = read(spark, sf_dir, "manifest_split", "image_id", "part").join(F.broadcast(spelled), "part")  # a fixed list
    return rows.groupBy("image_id").agg(F.min("known").alias("part"))


def image_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group per image: the smallest listed, the image itself without one."""
    rows = read(spark, sf_dir, "manifest_group", "image_id", "group_id").filter("image_id is not null")
    return rows.groupBy("image_id").agg(F.min("group_id").alias("g")).select("image_id", F.coalesce("g", "image_id").alias("group_id"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct successful records (image_id, option, changed_pixels, distortion, gross_bits)."""
    rows = read(spark, sf_dir, "sample_record", "image", "option", "changed_pixels", "distortion", "gross_bits", "failure")
    return rows.filter("failure is null").drop("failure").withColumnRenamed("image", "image_id").dropna().distinct()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (variant, detector, part, group_id, image_id, label, score) made of the sample records.

    Records of option 0.005 play the covers of every variant, those of the variant's option its stegos.
    """
    rows = samples(spark, sf_dir)
    detectors = F.array(
        F.struct(F.lit("changed").alias("detector"), F.col("changed_pixels").cast("double").alias("score")),
        F.struct(F.lit("density").alias("detector"), F.round(F.col("distortion") / F.col("changed_pixels"), 0).alias("score")),
    )
    rows = rows.filter("changed_pixels > 0").select("image_id", "option", F.explode(detectors).alias("d")).select("image_id", "option", "d.*")
    cover = rows.filter("option = '0.005'").withColumn("label", F.lit(0)).withColumn("variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS])))
    stego = rows.filter(F.col("option").isin(*VARIANTS)).withColumn("label", F.lit(1)).withColumn("variant", F.col("option"))
    both = cover.unionByName(stego).drop("option")
    both = both.join(image_groups(spark, sf_dir), "image_id", "left").withColumn("group_id", F.coalesce("group_id", "image_id"))
    return both.join(image_parts(spark, sf_dir), "image_id", "left").select("variant", "detector", "part", "group_id", "image_id", "label", "score")


SAMPLES = """
samples AS (SELECT DISTINCT image AS image_id, option, changed_pixels, distortion, gross_bits FROM sample_record
  WHERE failure IS NULL AND image IS NOT NULL AND option IS NOT NULL AND changed_pixels IS NOT NULL AND distortion IS NOT NULL AND gross_bits IS NOT NULL),
image_groups AS (SELECT image_id, coalesce(min(group_id), image_id) AS group_id FROM manifest_group WHERE image_id IS NOT NULL GROUP BY image_id),
image_parts AS (SELECT image_id, min(p.part) AS part FROM manifest_split s JOIN split_part p ON s.part = p.spelling GROUP BY image_id)
"""
PREDICTIONS = SAMPLES + """,
scored AS (
  SELECT image_id, option, 'changed' AS detector, changed_pixels::DOUBLE AS score FROM samples WHERE changed_pixels > 0
  UNION ALL SELECT image_id, option, 'density', round(distortion / changed_pixels, 0) FROM samples WHERE changed_pixels > 0),
labelled AS (
  SELECT image_id, detector, score, 0 AS label, unnest(['0.01', '0.025', '0.05', 'auto']) AS variant FROM scored WHERE option = '0.005'
  UNION ALL SELECT image_id, detector, score, 1, option FROM scored WHERE option IN ('0.01', '0.025', '0.05', 'auto')),
pred AS (SELECT variant, detector, part, coalesce(group_id, image_id) AS group_id, image_id, label, score
  FROM labelled LEFT JOIN image_groups USING (image_id) LEFT JOIN image_parts USING (image_id))
"""
