"""Problem 3: a sample that stays the same in every rerun and only grows with the data.

Each record has a persistent sequence number (an image's nine-digit id). Numbers fall into fixed blocks,
and a hash of the block number alone predetermines which positions of the block are chosen, whether a
record stands there yet or not. A record's fate depends on its own number only: no count, no order and
no other record has a say, so there is no shuffle, and a chosen record stays chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.ids import loose_id

#: Numbers in a block: a power of two, for the shuffle of positions.
BLOCK_BITS = 10
#: Positions chosen in each block.
CHOSEN = 128
SEED = "sample-1"


def _word(block: Column, round_: int, seed: str) -> Column:
    """A 48-bit number from the block number, the same in every engine that has SHA-256."""
    text = F.concat(F.lit(f"{seed}:{round_}:"), block.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def _steps(block: Column, seed: str, bits: int) -> list[tuple[Column, Column]]:
    """Odd multipliers and offsets of a block's three rounds, all taken from one hash of the block number."""
    mask, word = F.lit((1 << bits) - 1), _word(block, 0, seed)
    part = lambda by: F.shiftright(word, by).bitwiseAND(mask)
    return [(part(12 * i).bitwiseOR(F.lit(1)), part(12 * i + 5)) for i in range(3)]


def place(number: Column, seed: str = SEED, bits: int = BLOCK_BITS) -> Column:
    """Rank of a number's position in the hashed order of its block: a bijection of the block's positions.

    Three rounds of an odd multiplier, an offset and a folding of the high bits onto the low ones.
    """
    mask, half = F.lit((1 << bits) - 1), (bits + 1) // 2
    block = F.floor(number / F.lit(1 << bits)).cast("bigint")
    x = F.pmod(number, F.lit(1 << bits)).cast("bigint")
    for odd, add in _steps(block, seed, bits):
        x = (x * odd + add).bitwiseAND(mask)
        x = x.bitwiseXOR(F.shiftright(x, half))
    return x


def number_at(block: Column, rank: Column, seed: str = SEED, bits: int = BLOCK_BITS) -> Column:
    """The number whose `place` in the block is rank: the rounds undone, the last one first."""
    mask, half = F.lit((1 << bits) - 1), (bits + 1) // 2
    x = rank
    for odd, add in reversed(_steps(block, seed, bits)):
        x = x.bitwiseXOR(F.shiftright(x, half))  # half the bits or more, so it undoes itself
        inverse = odd
        for _ in range(4):  # each step doubles the bits in which odd * inverse is 1
            inverse = (inverse * (F.lit(2) - odd * inverse)).bitwiseAND(mask)
        x = ((x - add) * inverse).bitwiseAND(mask)
    return block * F.lit(1 << bits) + x


def block_sample(df: DataFrame, number: Column, chosen: int = CHOSEN, seed: str = SEED, bits: int = BLOCK_BITS) -> DataFrame:
    """The rows whose number is chosen: `chosen` of every 2**bits positions. Rows without a number are not.

    Repeated rows are all kept or all dropped; an empty table gives an empty sample.
    """
    return df.filter(number.isNotNull() & (place(number, seed, bits) < chosen))


def audit_draws(draws: DataFrame, image: str = "image_id", least_draws: int = 1, least_reruns: int = 1, seed: str = SEED, bits: int = BLOCK_BITS) -> DataFrame:
    """Faults of earlier draws against block selection: rows (image_id, draw_no, rerun) for each draw that lost an image.

    A block's selection is a set of ranks in its hashed order, kept as bitmaps. What the draws up to one have
    chosen is predetermined for that one and all later ones: it must be in every rerun. The positions that are predetermined but not
    filled are the faults; their numbers follow from their ranks. Draws and reruns run from 1 to the greatest
    in the data, or to least_draws and least_reruns where those are greater. Ids are written loosely; rows without an id, a draw or a rerun, and those
    numbered below 1, do not count, repeated rows count once. Bitmaps of 64 ranks are combined by a bitwise or before the shuffle.
    """
    n = loose_id(image).cast("bigint")
    rows = draws.select(n.alias("n"), F.col("draw_no").cast("int").alias("draw_no"), F.col("rerun").cast("int").alias("rerun"))
    rows = rows.filter("n is not null and draw_no >= 1 and rerun >= 1")
    top = rows.agg(F.max("draw_no").alias("d"), F.max("rerun").alias("r")).head()  # two numbers
    all_draws, reruns = range(1, max(top["d"] or 0, least_draws) + 1), range(1, max(top["r"] or 0, least_reruns) + 1)
    rows = rows.select("draw_no", "rerun", F.shiftright("n", bits).alias("block"), place(F.col("n"), seed, bits).alias("rank"))
    bit = F.expr("shiftleft(1L, cast(rank % 64 as int))")
    none = F.lit(0).cast("bigint")
    drawn = lambda d, r: F.when((F.col("draw_no") == d) & (F.col("rerun") == r), bit)
    maps = rows.groupBy("block", F.expr("rank div 64").alias("word")).agg(*[F.coalesce(F.bit_or(drawn(d, r)), none).alias(f"d{d}_{r}") for d in all_draws for r in reruns])
    cases, selected = [], none
    for d in all_draws:
        for r in reruns:
            selected = selected.bitwiseOR(F.col(f"d{d}_{r}"))
        for r in reruns:
            lost = selected.bitwiseAND(F.bitwise_not(F.col(f"d{d}_{r}")))
            cases.append(F.struct(F.lit(d).alias("draw_no"), F.lit(r).alias("rerun"), lost.alias("lost")))
    lost = maps.select("block", "word", F.explode(F.array(*cases)).alias("c")).filter("c.lost <> 0")
    ranks = lost.select("block", "word", "c.*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).filter("shiftrightunsigned(lost, i) & 1L = 1")
    number = number_at(F.col("block"), F.col("word") * 64 + F.col("i"), seed, bits)
    return ranks.select(F.lpad(number.cast("string"), 9, "0").alias("image_id"), "draw_no", "rerun")
