"""Preparing a corpus: exact and near duplicates, groups, and a deterministic split without leakage."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.operators.components import connected_components
from sieveline.operators.joins import skew_join
from sieveline.operators.running import running_totals
from sieveline.session import materialize

#: Bits that near signatures may differ in (fixed value).
BITS = 4
#: Signatures a token should be shared by on average, where more parts allow it.
SHARED = 64
#: Signatures of a token that are compared in one unit.
BLOCK = 4_096


def signature_classes(images: DataFrame, signature: str = "signature", image: str = "image_id") -> DataFrame:
    """One row (signature, image_id, copies) per distinct signature; image_id is the smallest. Nulls are left out."""
    ok = images.select(F.col(image).alias("image_id"), F.col(signature).alias("signature")).dropna().distinct()
    return ok.groupBy("signature").agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("copies"))


def parts_for(signatures: int) -> int:
    """Parts the signatures are cut into: the fewest of 5 to 7 that leave about SHARED signatures to a token.

    Of p parts, 4 differing bits leave p - 4 whole. Tokens are all sets of p - 4 parts, of 64 (p - 4) / p bits.
    """
    return next((p for p in (5, 6) if signatures <= SHARED * 2 ** (64 * (p - BITS) / p)), 7)


def near_pairs(classes: DataFrame, parts: int | None = None) -> DataFrame:
    """Pairs (image_a, image_b, distance) of signature classes that differ in 1 to 4 bits, image_a < image_b.

    The theta join becomes an equi-join on tokens, whose width grows with the number of classes; it finds all pairs at any
    width. A token that many signatures share is cut into blocks: one side keeps its block, the other visits
    all, so no reducer gets a whole hot token. Copies are not paired: they are members of one class.
    """
    classes = materialize(classes.select("image_id", "signature"), "classes")
    parts = parts or parts_for(classes.count())
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    bits = [F.shiftrightunsigned("signature", a).bitwiseAND((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]
    tokens = F.array(*[F.xxhash64(F.lit(k), *[bits[i] for i in chosen]) for k, chosen in enumerate(combinations(range(parts), parts - BITS))])
    rows = materialize(classes.select("image_id", "signature", F.explode(tokens).alias("token")), "tokens")
    counts = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    long = counts.filter(F.col("n") > BLOCK).select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    marked = skew_join(rows, materialize(long, "long"), "token").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = marked.select("token", F.pmod(F.xxhash64("signature"), "blocks").cast("int").alias("block"), F.col("image_id").alias("a"), F.col("signature").alias("sa"))
    right = marked.select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("image_id").alias("b"), F.col("signature").alias("sb"))
    distance = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    met = left.join(right, ["token", "block"]).filter((F.col("a") < F.col("b")) & (F.col("sa") != F.col("sb")) & (distance <= BITS))
    return met.select(F.col("a").alias("image_a"), F.col("b").alias("image_b"), distance.cast("int").alias("distance")).distinct()


def exact_links(images: DataFrame, digest: str = "pixel_sha256", image: str = "image_id") -> DataFrame:
    """Links (src, dst) from each image to the smallest one with the same digest. Null digests link nothing."""
    rows = images.select(F.col(image).alias("dst"), F.col(digest).alias("digest")).dropna().distinct()
    first = rows.groupBy("digest").agg(F.min("dst").alias("src"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return skew_join(materialize(rows, "digests"), materialize(first.select("digest", "src"), "firsts"), "digest", "inner").filter("src <> dst").select("src", "dst")


def components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components: rows (id, root), root the smallest id; one row per id that has a link.

    By the grid of `connected_components`. Links with a null end are dropped, an id that is only linked with itself is a
    component of its own.
    """
    e = materialize(links.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna().distinct(), "links")
    found = connected_components(e, "u", "v")
    alone = e.filter("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    # an id with a link to itself and others has two rows, of which the smaller root is the component's
    return found.unionByName(alone).groupBy("id").agg(F.min("component").alias("root"))


def hash_order(name: Column, seed: str = "split-93191:") -> Column:
    """Order of a group in the split: the SHA-256 of the seed and its first member's id, as hex."""
    return F.sha2(F.concat(F.lit(seed), name), 256)


def greedy_split(groups: DataFrame, targets: Mapping[str, int], rest: str = "reserve", seed: str = "split-93191:") -> DataFrame:
    """Assign groups (group_id, first, size) to parts: rows (group_id, size, part).

    Groups come in hash order, each to the first part whose size is still below its target; a part may
    overshoot by its last group, and the next one counts from there. Written as running totals: a part
    ends at the first total that reaches its target.
    """
    rows = groups.withColumn("h", hash_order(F.col("first"), seed))
    rows = rows.withColumn("key", F.conv(F.substring("h", 1, 13), 16, 10).cast("bigint"))
    total = materialize(running_totals(rows, "key", ["size"], tie="h").withColumn("cum", F.col("size_before") + F.col("size")), "running")
    part, begin = F.lit(rest), 0
    ends: list[tuple[str, int | None]] = []
    for name, target in targets.items():
        end = None if begin is None else total.filter(F.col("cum") >= begin + target).agg(F.min("cum")).head()[0]
        ends.append((name, end))
        begin = end
    for name, end in reversed(ends):
        part = F.when(F.lit(True) if end is None else F.col("cum") <= end, name).otherwise(part)
    return total.select("group_id", "size", part.alias("part"))


def leakage(members: DataFrame, key: str = "group_id", part: str = "part") -> DataFrame:
    """Keys with members in several parts: rows (key, parts). Nulls do not count."""
    found = members.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(part).alias("parts"))
    return found.filter("parts > 1")


def leakage_report(members: DataFrame, total: int | None = None) -> DataFrame:
    """Rows (kind, id, parts): images in several parts, groups in several parts, and one row of the number of images.

    members: image_id, group_id, part, one row for every part that an image is listed in. The last row has the kind 'total', the id
    of nothing, and in parts the images that have a part. Another number than `total`, where that is given, is an error when it is read.
    """
    rows = members.filter("image_id is not null and part is not null")
    n = F.count_distinct("image_id")
    checked = n if total is None else F.when(n == total, n).otherwise(F.raise_error(F.concat(F.lit(f"expected {total} images, found "), n.cast("string"))).cast("bigint"))
    all_ = rows.agg(checked.alias("parts")).select(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("id"), "parts")
    one = lambda key, kind: leakage(rows, key).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "parts")
    return one("image_id", "image").unionByName(one("group_id", "group")).unionByName(all_)
