"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import components, mixing, neardup, packing, sampling, splits, truncation
from sieveline.llm.oracle import ORACLE  # noqa: F401
from sieveline.llm.tokens import count_tokens
from sieveline.session import materialize


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _read(spark, sf_dir, "match_pair", "left_image", "right_image", "accepted")
    return components.image_groups(pairs, _read(spark, sf_dir, "source_image", "image_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every linked image."""
    return _groups(spark, sf_dir)


def p1_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicate_groups by size: how many groups hold how many images."""
    sizes = _groups(spark, sf_dir).groupBy("group_id").agg(F.count(F.lit(1)).alias("images"))
    return sizes.groupBy("images").agg(F.count(F.lit(1)).alias("near_duplicate_groups"))


def p1_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen groups of the manifest that no longer agree with the matches: both names for each such image."""
    frozen = _read(spark, sf_dir, "manifest_group", "image_id", "group_id").filter("group_id is not null").distinct()
    found = _groups(spark, sf_dir).withColumnRenamed("group_id", "found_group")
    return frozen.join(found, "image_id").filter("group_id <> found_group")


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = _read(spark, sf_dir, "split_part")
    own = materialize(splits.members(_read(spark, sf_dir, "manifest_group", "image_id", "group_id")), "own")
    return own, splits.assign_parts(own, splits.part_shares(parts)), parts


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that manifest_split tears apart, out of the report that gives each group its new part."""
    own, units, parts = _splits(spark, sf_dir)
    report = splits.group_report(own, _read(spark, sf_dir, "manifest_split", "image_id", "part"), parts, units)
    return report.filter("old_parts >= 2").select("group_id")


def p2_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new part of every image of manifest_group."""
    own, units, _ = _splits(spark, sf_dir)
    images = own.select("image_id", "unit").distinct()
    return splits.skew_join(images, units.select("unit", "part"), "unit", "inner").select("image_id", "part")


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each part."""
    _, units, parts = _splits(spark, sf_dir)
    total = units.agg(F.sum("weight").alias("all_images"))
    goal = parts.groupBy("part").agg(F.max("target_share").alias("target_share"))
    got = units.groupBy("part").agg(F.sum("weight").alias("images"), F.count(F.lit(1)).alias("units"))
    return goal.join(got, "part", "left").crossJoin(F.broadcast(total)).select("part", "target_share", "images", "units", (F.col("images") / F.col("all_images")).alias("share"))


def p2_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How even the bins are before they are allocated."""
    return splits.bin_spread(_splits(spark, sf_dir)[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws that lost an image they must hold: four draws, each made twice, and later ones if there are."""
    return sampling.audit_draws(_read(spark, sf_dir, "drawn_sample", "image_id", "draw_no", "rerun"), least_draws=4, least_reruns=2)


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of all images of manifest_group, with the first snapshot that lists each, its least group and its part.

    The part is the first by name of those its rows in manifest_split spell, null without one.
    """
    number = F.col("image_id").cast("bigint")
    drawn = sampling.block_sample(_read(spark, sf_dir, "manifest_group", "image_id", "group_id", "snapshot"), number)
    drawn = drawn.groupBy("image_id").agg(F.min("snapshot").alias("snapshot"), F.min("group_id").alias("group_id"))
    spelled = _read(spark, sf_dir, "split_part").select(F.col("spelling").alias("part"), F.col("part").alias("known"))
    # the same blocks choose among the parts' rows, so only chosen images are joined; split_part is a fixed list
    parts = sampling.block_sample(_read(spark, sf_dir, "manifest_split", "image_id", "part"), number).join(F.broadcast(spelled), "part")
    return drawn.join(parts.groupBy("image_id").agg(F.min("known").alias("part")), "image_id", "left")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "source_image", "archive", "image_id", "signature", "small")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images of one archive whose signatures differ in at most 4 bits."""
    return neardup.near_image_pairs(_images(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, copies and number of links of every image."""
    return neardup.near_image_groups(_images(spark, sf_dir))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return docs.select("doc_id", "source", count_tokens(F.col("text")).alias("tokens"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that alone exceed a container: those that the packing put into more than one."""
    packed = packing.pack(_sizes(spark, sf_dir)).groupBy("doc_id").agg(F.min("container").alias("a"), F.max("container").alias("b"))
    return packed.filter("a <> b").select("doc_id")


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece."""
    return packing.pack(_sizes(spark, sf_dir))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers and tokens by tenth of the capacity."""
    fill = packing.pack(_sizes(spark, sf_dir)).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    tenth = F.least(F.floor(F.col("tokens") * 10 / packing.CAPACITY), F.lit(9)).alias("tenth")
    return fill.groupBy(tenth).agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))


def _rates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = materialize(_sizes(spark, sf_dir), "sizes")
    return sizes, mixing.repetition_rates(sizes, _read(spark, sf_dir, "mix_target"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, rates = _rates(spark, sf_dir)
    rates = materialize(rates, "rates")
    return mixing.shares(mixing.copies(sizes, rates), rates)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of which the mixture holds all it may and still less than their share of the total size."""
    return _mixed(spark, sf_dir).filter("short").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself."""
    sizes, rates = _rates(spark, sf_dir)
    return mixing.mix(sizes, materialize(rates, "rates"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, attainable and reached share of every source."""
    return _mixed(spark, sf_dir).drop("short")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_cut(_read(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut before its end."""
    return _flags(spark, sf_dir).filter("cut").select("doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, cut texts and their share for each source."""
    return truncation.cut_shares(_flags(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_group_sizes, p1_stale, p2_found, p2_assign, p2_shares, p2_spread, p3_found, p3_sample,
        p5_found, p5_groups, p6_found, p6_pack, p6_fill, p7_found, p7_mix, p7_shares, p8_found, p8_shares,
    )
}
