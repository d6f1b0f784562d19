"""Queries on payload planning (inventory P1-P12, A25, A26) and their SQL. Texts of documents play messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import planner as pl
from sieveline.plans.tables import SAMPLES, read, samples

PIXELS = 512 * 512


def p1_valid_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = pl.raster_ok(F.col("width"), F.col("height"))
    return read(spark, sf_dir, "source_image", "image_id", "width", "height").filter(ok).select("image_id").distinct()


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = read(spark, sf_dir, "sample_record", "rate").filter("rate is not null").distinct()
    return rates.withColumn("r", pl.rate_of(F.col("rate"))).filter("r is not null")


def p2_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame bytes of a 512 x 512 image at every rate that was run."""
    return _rates(spark, sf_dir).select("rate", pl.capacity(F.lit(PIXELS), F.col("r")).alias("capacity"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as it is, with and without a key, at 0.05 and at the automatic rate."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    n = F.octet_length("text").cast("bigint")
    rows = docs.select("doc_id", n.alias("message_bytes"), n.alias("stored_bytes"), F.lit(False).alias("compressed"), F.lit(PIXELS).cast("bigint").alias("pixels"))
    return rows.withColumn("keyed", (F.col("doc_id") % 2 == 0)).withColumn("rate", F.explode(F.array(F.lit("0.05"), F.lit("auto"))))


def p3_minimum_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir).filter("rate = 'auto'")
    rate = pl.minimum_rate(F.col("pixels"), F.col("stored_bytes"), F.col("keyed"))
    return rows.select("doc_id", pl.rate_text(rate).alias("rate"), pl.supported(rate).alias("supported"))


def p4_decimal_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _payloads(spark, sf_dir).filter("rate = 'auto'")
    rate = pl.minimum_rate(F.col("pixels"), F.col("stored_bytes"), F.col("keyed"))
    return rows.select("doc_id", pl.decimal_rate(rate, F.col("pixels")).alias("rate"))


def p5_payload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = pl.plan(_payloads(spark, sf_dir).filter("rate = '0.05'"))
    return planned.select("doc_id", "chosen.*")


def p6_payload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen rate, the one suggested, and whether the payload fits."""
    planned = pl.plan(_payloads(spark, sf_dir))
    return planned.select("doc_id", F.col("rate").alias("requested_rate"), "chosen.chosen_rate", "chosen.fits", "chosen.supported", "chosen.deficit_bytes", F.col("suggested.frame_bytes").alias("suggested_frame_bytes"))


def p9_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that pass the size checks, which come before any kernel."""
    return pl.plan(_payloads(spark, sf_dir)).filter("chosen.fits and chosen.supported").select("doc_id", "rate")


def p12_frame_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.compare_frames(pl.plan(_payloads(spark, sf_dir).filter("rate = '0.05'")), "doc_id")


def p7_stored_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representation of every text: compressed or not, and its size."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    rows = docs.select("doc_id", pl.choose_representation(F.encode("text", "UTF-8")).alias("c"))
    return rows.select("doc_id", F.col("c.flag").alias("flag"), F.octet_length("c.data").alias("stored_bytes"))


def p8_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of every text as a message: its representation, and the chosen and suggested plan."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    rows = docs.select("doc_id", F.encode("text", "UTF-8").alias("message"), F.lit(PIXELS).cast("bigint").alias("pixels"), (F.col("doc_id") % 2 == 0).alias("keyed"), F.lit("0.05").alias("rate"))
    return pl.analyze(rows).select("doc_id", "message_bytes", "stored_bytes", "compressed", "chosen.fits", "chosen.deficit_bytes", "suggested.suggested_rate", "suggested.supported")


def p10_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame, padding and fit of every text at 0.05."""
    rows = pl.prepare(_payloads(spark, sf_dir).filter("rate = '0.05'"))
    return rows.select("doc_id", "frame_bytes", "padding_bytes", "remaining_bytes", "fits", "supported")


def p11_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the records as decimals for display."""
    return _rates(spark, sf_dir).select("rate", pl.decimal_rate(F.col("r"), F.lit(PIXELS)).alias("shown"))


def a25_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("image_id", "option", "changed_pixels")
    return rows.select("image_id", "option", F.round(pl.psnr(F.lit(PIXELS), F.col("changed_pixels")), 6).alias("psnr")).distinct()


def a26_change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("option").agg(F.sum("changed_pixels").alias("changed_pixels"), F.sum("distortion").alias("distortion"))


# names begin with the inventory's ids; q_ keeps the P items apart from the problems' p1 to p8
QUERIES = {
    "q_" + f.__name__: f
    for f in (p1_valid_rasters, p2_capacity, p3_minimum_rate, p4_decimal_rate, p5_payload_summary, p6_payload_plan, p7_stored_sizes, p8_analysis, p9_admitted, p10_prepare, p11_display, p12_frame_comparison)
} | {f.__name__: f for f in (a25_psnr, a26_change_totals)}

_PAYLOADS = """pay AS (SELECT doc_id, octet_length(encode(text)) AS s, 262144 AS n, doc_id % 2 = 0 AS keyed, unnest(['0.05', 'auto']) AS rate FROM documents WHERE text IS NOT NULL),
least AS (SELECT *, CASE WHEN keyed THEN 66 ELSE 54 END AS o, 8 * (s + CASE WHEN keyed THEN 66 ELSE 54 END) AS rn FROM pay),
least2 AS (SELECT *, CASE WHEN rn * 400 <= n THEN 1 ELSE rn // gcd(rn, n) END AS ln, CASE WHEN rn * 400 <= n THEN 400 ELSE n // gcd(rn, n) END AS ld FROM least),
rated AS (SELECT *, CASE WHEN rate = 'auto' THEN ln ELSE 5 END AS num, CASE WHEN rate = 'auto' THEN ld ELSE 100 END AS den,
  CASE WHEN ln = 1 AND ld = 400 THEN '0.0025' ELSE ln || '/' || ld END AS suggested FROM least2),
sized AS (SELECT *, n * num // (8 * den) AS total, n * ln // (8 * ld) AS suggested_total FROM rated),
plan AS (SELECT *, total - o AS room, CASE WHEN rate = 'auto' THEN suggested ELSE rate END AS chosen,
  num * 400 >= den AND num * 5 <= den AS supported FROM sized)
"""


def _decimal(num: str, den: str, n: str) -> str:
    """The rounded rate as SQL, places 8 to 12."""
    out = "CASE"
    for k in (8, 9, 10, 11, 12):
        v = f"((({num})::HUGEINT * {10**k} + {den} - 1) // {den})"
        out += f" WHEN {n} * {v} // {8 * 10**k} = {n} * ({num}) // (8 * {den}) THEN ({v} // {10**k}) || '.' || lpad(({v} % {10**k})::VARCHAR, {k}, '0')"
    return out + " END"


_RATES = r"""rates AS (SELECT rate, CASE WHEN rate LIKE '%/%' THEN split_part(rate, '/', 1)::BIGINT ELSE replace(rate, '.', '')::BIGINT END AS num,
  CASE WHEN rate LIKE '%/%' THEN split_part(rate, '/', 2)::BIGINT ELSE (10 ** length(regexp_extract(rate, '\.([0-9]+)$', 1)))::BIGINT END AS den
  FROM (SELECT DISTINCT rate FROM sample_record WHERE regexp_matches(rate, '^[0-9]+(/[0-9]+|\.[0-9]+)?$')))
"""

ORACLE = {
    "q_p1_valid_rasters": "SELECT DISTINCT image_id FROM source_image WHERE width BETWEEN 256 AND 8192 AND height BETWEEN 256 AND 8192 AND width::BIGINT * height BETWEEN 262144 AND 16777216",
    "q_p2_capacity": "WITH " + _RATES + "SELECT rate, CASE WHEN num * 400 >= den AND num * 5 <= den AND 262144 * num // (8 * den) >= 66 THEN 262144 * num // (8 * den) END AS capacity FROM rates",
    "q_p3_minimum_rate": "WITH " + _PAYLOADS + "SELECT doc_id, suggested AS rate, supported FROM plan WHERE rate = 'auto'",
    "q_p4_decimal_rate": "WITH " + _PAYLOADS + f"SELECT doc_id, {_decimal('ln', 'ld', 'n')} AS rate FROM plan WHERE rate = 'auto'",
    "q_p5_payload_summary": "WITH " + _PAYLOADS + """SELECT doc_id, s AS message_bytes, s AS stored_bytes, n::BIGINT AS pixels, keyed, room AS capacity_bytes, 8 * s / n AS net_bpp, 8 * s / n AS stored_net_bpp,
      8 * total / n AS gross_bpp, CASE WHEN room <> 0 THEN 100 * s / room END AS capacity_used_percent, false AS compressed, suggested AS suggested_rate, chosen AS chosen_rate,
      total AS frame_bytes, total - 32 AS body_bytes, 32::BIGINT AS salt_bytes, 18::BIGINT AS header_bytes, greatest(0, room - s) AS padding_bytes,
      CASE WHEN keyed THEN 16 ELSE 0 END::BIGINT AS authentication_tag_bytes, CASE WHEN keyed THEN 0 ELSE 4 END::BIGINT AS checksum_bytes,
      greatest(0, room - s) AS remaining_bytes, greatest(0, s - room) AS deficit_bytes, s <= room AS fits, supported FROM plan WHERE rate = '0.05'""",
    "q_p6_payload_plan": "WITH " + _PAYLOADS + """SELECT doc_id, rate AS requested_rate, chosen AS chosen_rate, s <= room AS fits, supported, greatest(0, s - room) AS deficit_bytes,
      suggested_total AS suggested_frame_bytes FROM plan""",
    "q_p9_admitted": "WITH " + _PAYLOADS + "SELECT doc_id, rate FROM plan WHERE s <= room AND supported",
    "q_p10_prepare": "WITH " + _PAYLOADS + """SELECT doc_id, total AS frame_bytes, greatest(0, room - s) AS padding_bytes, greatest(0, room - s) AS remaining_bytes, s <= room AS fits, supported
      FROM plan WHERE rate = '0.05'""",
    "q_p11_display": "WITH " + _RATES + f"SELECT rate, {_decimal('num', 'den', '262144')} AS shown FROM rates",
    "q_p12_frame_comparison": "WITH " + _PAYLOADS + """, x AS (SELECT * FROM plan WHERE rate = '0.05')
      SELECT doc_id, component, chosen, suggested, suggested - chosen AS difference FROM (
        SELECT doc_id, 'salt_bytes' AS component, 32::BIGINT AS chosen, 32::BIGINT AS suggested FROM x
        UNION ALL SELECT doc_id, 'header_bytes', 18, 18 FROM x
        UNION ALL SELECT doc_id, 'stored_bytes', s, s FROM x
        UNION ALL SELECT doc_id, 'padding_bytes', greatest(0, room - s), greatest(0, suggested_total - o - s) FROM x
        UNION ALL SELECT doc_id, 'authentication_tag_bytes', CASE WHEN keyed THEN 16 ELSE 0 END, CASE WHEN keyed THEN 16 ELSE 0 END FROM x
        UNION ALL SELECT doc_id, 'checksum_bytes', CASE WHEN keyed THEN 0 ELSE 4 END, CASE WHEN keyed THEN 0 ELSE 4 END FROM x
        UNION ALL SELECT doc_id, 'frame_bytes', total, suggested_total FROM x)""",
    "a25_psnr": "WITH " + SAMPLES + "SELECT DISTINCT image_id, option, round(10 * log10(65025 * 262144.0::DOUBLE / changed_pixels), 6) AS psnr FROM samples",
    "a26_change_totals": "WITH " + SAMPLES + "SELECT option, sum(changed_pixels)::BIGINT AS changed_pixels, sum(distortion)::BIGINT AS distortion FROM samples GROUP BY option",
}
