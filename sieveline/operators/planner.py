"""Payload planning as column arithmetic: exact rational rates, byte budgets and frame components.

Rates are pairs of bigints (num, den), never doubles. Fixed values of the frame's layout: salt 32, header 18,
tag 16 with a key, checksum 4 without; rates from 1/400 to 1/5 bit per pixel.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT, HEADER, TAG, CHECKSUM = 32, 18, 16, 4
LEAST_RATE, MOST_RATE = (1, 400), (1, 5)


def _big(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("bigint")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, by Euclid's steps inside the JVM (90 are enough for any bigint)."""
    start = F.struct(_big(a).alias("a"), _big(b).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], _big(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s["a"])


def rate_of(text: Column) -> Column:
    """struct(num, den) of a rate written as a decimal or a fraction; null for anything else."""
    fraction = text.rlike("^[0-9]{1,9}/[1-9][0-9]{0,9}$")
    decimal = text.rlike(r"^[0-9]{1,4}(\.[0-9]{1,9})?$")
    digits = F.length(F.regexp_extract(text, r"\.([0-9]+)$", 1))
    num = F.when(fraction, F.split(text, "/")[0]).when(decimal, F.replace(text, F.lit("."), F.lit("")))
    den = F.when(fraction, F.split(text, "/")[1].cast("bigint")).when(decimal, F.pow(F.lit(10), digits).cast("bigint"))
    num = F.when(fraction | decimal, num).cast("bigint")
    return F.when(num.isNotNull(), F.struct(num.alias("num"), den.alias("den")))


def supported(rate: Column) -> Column:
    """Whether a rate lies within the profile's bounds, by cross-multiplication."""
    return (rate["num"] * LEAST_RATE[1] >= rate["den"] * LEAST_RATE[0]) & (rate["num"] * MOST_RATE[1] <= rate["den"] * MOST_RATE[0])


def frame_bytes(pixels: Column, rate: Column) -> Column:
    """Bytes of the frame at a rate: pixels x rate / 8, rounded down."""
    return _div(_big(pixels) * rate["num"], rate["den"] * 8)


def capacity(pixels: Column, rate: Column) -> Column:
    """Frame bytes of a supported rate that leaves room for a keyed frame; null otherwise."""
    total = frame_bytes(pixels, rate)
    return F.when(supported(rate) & (total >= SALT + HEADER + TAG), total)


def overhead(keyed: Column) -> Column:
    return F.when(keyed, _big(SALT + HEADER + TAG)).otherwise(_big(SALT + HEADER + CHECKSUM))


def minimum_rate(pixels: Column, stored: Column, keyed: Column) -> Column:
    """Least rate whose frame holds the stored bytes: a reduced struct(num, den), at least the profile's least."""
    num, den = (_big(stored) + overhead(keyed)) * 8, _big(pixels)
    g = gcd(num, den)
    least = num * LEAST_RATE[1] <= den * LEAST_RATE[0]
    return F.struct(F.when(least, _big(LEAST_RATE[0])).otherwise(_div(num, g)).alias("num"), F.when(least, _big(LEAST_RATE[1])).otherwise(_div(den, g)).alias("den"))


def rate_text(rate: Column) -> Column:
    """A rate as the records write it: the least one as a decimal, others as fractions."""
    least = (rate["num"] == LEAST_RATE[0]) & (rate["den"] == LEAST_RATE[1])
    whole = F.concat_ws("/", rate["num"].cast("string"), rate["den"].cast("string"))
    return F.when(least, F.lit("0.0025")).otherwise(whole)


def decimal_rate(rate: Column, pixels: Column, places: tuple[int, ...] = (8, 9, 10, 11, 12)) -> Column:
    """Rate rounded up to the fewest of `places` decimals that keep the byte budget, as text."""
    budget, out = frame_bytes(pixels, rate), F.lit(None).cast("string")
    for k in reversed(places):
        scale = 10**k
        value = _div(rate["num"] * _big(scale) + rate["den"] - 1, rate["den"])
        same = _div(_big(pixels) * value, _big(8 * scale)) == budget
        text = F.concat(_div(value, _big(scale)).cast("string"), F.lit("."), F.lpad((value % scale).cast("string"), k, "0"))
        out = F.when(same, text).otherwise(out)
    return out


#: Columns of a payload summary, in order.
SUMMARY = (
    "message_bytes", "stored_bytes", "pixels", "keyed", "capacity_bytes", "net_bpp", "stored_net_bpp", "gross_bpp", "capacity_used_percent", "compressed",
    "suggested_rate", "chosen_rate", "frame_bytes", "body_bytes", "salt_bytes", "header_bytes", "padding_bytes", "authentication_tag_bytes",
    "checksum_bytes", "remaining_bytes", "deficit_bytes", "fits",
)


def summary(message: Column, stored: Column, compressed: Column, pixels: Column, keyed: Column, rate: Column, shown: Column) -> dict[str, Column]:
    """The columns of a payload summary at a chosen rate; shown is the rate as it was asked for."""
    message, stored, pixels = _big(message), _big(stored), _big(pixels)
    total = frame_bytes(pixels, rate)
    room = total - overhead(keyed)
    spare = F.greatest(_big(0), room - stored)
    return {
        "message_bytes": message,
        "stored_bytes": stored,
        "pixels": pixels,
        "keyed": keyed,
        "capacity_bytes": room,
        "net_bpp": message * 8 / pixels,
        "stored_net_bpp": stored * 8 / pixels,
        "gross_bpp": total * 8 / pixels,
        "capacity_used_percent": F.when(room != 0, stored * 100 / room),
        "compressed": compressed,
        "suggested_rate": rate_text(minimum_rate(pixels, stored, keyed)),
        "chosen_rate": shown,
        "frame_bytes": total,
        "body_bytes": total - SALT,
        "salt_bytes": _big(SALT),
        "header_bytes": _big(HEADER),
        "padding_bytes": spare,
        "authentication_tag_bytes": F.when(keyed, _big(TAG)).otherwise(_big(0)),
        "checksum_bytes": F.when(keyed, _big(0)).otherwise(_big(CHECKSUM)),
        "remaining_bytes": spare,
        "deficit_bytes": F.greatest(_big(0), stored - room),
        "fits": stored <= room,
    }


def plan(payloads: DataFrame) -> DataFrame:
    """Chosen and suggested summary of each payload: adds `chosen`, `suggested` (structs) and nothing else.

    payloads: message_bytes, stored_bytes, compressed, pixels, keyed, rate (text; 'auto' takes the least rate
    that fits). A rate that is no number gives null structs. Only sizes are read, no pixel and no payload.
    """
    c = F.col
    least = minimum_rate(c("pixels"), c("stored_bytes"), c("keyed"))
    rows = payloads.withColumn("_least", least).withColumn("_rate", F.when(c("rate") == "auto", F.col("_least")).otherwise(rate_of(c("rate"))))

    asked = F.when(c("rate") == "auto", rate_text(c("_least"))).otherwise(c("rate"))

    def one(rate: Column, shown: Column) -> Column:
        cols = summary(c("message_bytes"), c("stored_bytes"), c("compressed"), c("pixels"), c("keyed"), rate, shown)
        return F.when(rate.isNotNull(), F.struct(*[v.alias(k) for k, v in cols.items()], supported(rate).alias("supported")))

    return rows.withColumns({"chosen": one(c("_rate"), asked), "suggested": one(c("_least"), rate_text(c("_least")))}).drop("_least", "_rate")


def prepare(payloads: DataFrame) -> DataFrame:
    """The summary of each payload at one stated rate, as columns: what a plan holds without a suggestion.

    payloads: as in `plan`, but the rate must be a number; others give nulls.
    """
    c = F.col
    rate = rate_of(c("rate"))
    cols = summary(c("message_bytes"), c("stored_bytes"), c("compressed"), c("pixels"), c("keyed"), rate, c("rate"))
    keep = [n for n in payloads.columns if n not in cols]
    return payloads.select(*keep, *[F.when(rate.isNotNull(), v).alias(k) for k, v in cols.items()], supported(rate).alias("supported"))


def analyze(messages: DataFrame, message: str = "message") -> DataFrame:
    """Plans of whole messages: adds message_bytes, stored_bytes, compressed, chosen and suggested; the message itself is dropped.

    messages: the message (binary), pixels, keyed, rate. The representation is chosen first, nothing is coded.
    """
    rows = messages.withColumn("_c", choose_representation(F.col(message)))
    sizes = {"message_bytes": F.octet_length(message).cast("bigint"), "stored_bytes": F.octet_length("_c.data").cast("bigint"), "compressed": F.col("_c.flag") == 1}
    return plan(rows.withColumns(sizes).drop("_c", message))


#: Components of a frame that a comparison lists.
COMPONENTS = ("salt_bytes", "header_bytes", "stored_bytes", "padding_bytes", "authentication_tag_bytes", "checksum_bytes", "frame_bytes")


def compare_frames(planned: DataFrame, *keys: str) -> DataFrame:
    """One row per component: bytes chosen, suggested and the difference."""
    parts = F.array(*[F.struct(F.lit(p).alias("component"), F.col(f"chosen.{p}").alias("chosen"), F.col(f"suggested.{p}").alias("suggested")) for p in COMPONENTS])
    rows = planned.filter("chosen is not null").select(*keys, F.explode(parts).alias("p")).select(*keys, "p.*")
    return rows.withColumn("difference", F.col("suggested") - F.col("chosen"))


def choose_representation(payload: Column) -> Column:
    """struct(flag, data): the raw DEFLATE form of a payload where it is strictly shorter, else itself."""

    @F.pandas_udf("flag int, data binary")
    def choose(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            if v is None:
                rows.append((None, None))
                continue
            packer = zlib.compressobj(level=6, wbits=-15)
            small = packer.compress(bytes(v)) + packer.flush()
            rows.append((1, small) if len(small) < len(v) else (0, bytes(v)))
        return pd.DataFrame(rows, columns=["flag", "data"]).astype({"flag": "Int32"})

    return choose(payload)


def raster_ok(width: Column, height: Column) -> Column:
    """Whether an image's size lies within the profile: sides 256 to 8192, 262,144 to 16,777,216 pixels."""
    area = _big(width) * _big(height)
    return width.between(256, 8192) & height.between(256, 8192) & area.between(262_144, 16_777_216)


def psnr(pixels: Column, changes: Column) -> Column:
    """PSNR of +-1 changes in dB: infinite without any."""
    return F.when(changes == 0, F.lit(float("inf"))).otherwise(F.log10(F.lit(65_025.0) * pixels / changes) * 10)
