"""Signatures and digests of reduced rasters, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gradient_signature(raster: Column) -> Column:
    """Signature of an 8 x 9 raster: bit set where a pixel is brighter than its left neighbour, high bit first.

    Null when the raster is null or not 72 bytes long.
    """
    text = F.hex(raster)
    pixel = lambda i: F.substring(text, 2 * i + 1, 2)  # noqa: E731  (two hex digits compare as the byte does)
    bits = [F.when(pixel(9 * r + c + 1) > pixel(9 * r + c), F.lit("1")).otherwise(F.lit("0")) for r in range(8) for c in range(8)]
    high, low = (F.conv(F.concat(*bits[k : k + 32]), 2, 10).cast("bigint") for k in (0, 32))
    return F.when(F.octet_length(raster) == 72, F.shiftleft(high, 32).bitwiseOR(low))


def described(images: DataFrame, raster: str = "small") -> DataFrame:
    """Rows (image_id, signature, pixel_sha256) of images; what is null there follows from the raster where that is known."""
    s = F.coalesce("signature", F.when(F.col("signature").isNull(), gradient_signature(F.col(raster))))
    return images.select("image_id", s.alias("signature"), F.coalesce("pixel_sha256", F.sha2(raster, 256)).alias("pixel_sha256"))
