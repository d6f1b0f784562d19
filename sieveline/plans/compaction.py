"""Queries of problem 4 and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators.compaction import compact_files


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/result_file.parquet").select("content", "modified_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record at least one file holds complete, read back from the compacted files."""
    compacted, _ = compact_files(_table(spark, sf_dir))
    return compacted.filter("run_id is not null and image is not null and option is not null").select("run_id", "image", "option")


def p4_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, failures and changed pixels of the automatic rate per image, from the compacted files."""
    compacted, _ = compact_files(_table(spark, sf_dir))
    return (
        compacted.filter("option = 'auto' and image is not null and run_id is not null")
        .groupBy("image")
        .agg(F.count(F.lit(1)).alias("records"), F.count("failure").alias("failures"), F.sum("auto_changed_pixels").alias("changed_pixels"))
    )


def p4_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compaction committed: rows, files and checksum of its output."""
    _, done = compact_files(_table(spark, sf_dir))
    return spark.createDataFrame([(done.rows, done.files, str(done.total), done.mixed)], "rows bigint, files bigint, total string, mixed bigint")


QUERIES = {"p4_found": p4_found, "p4_auto": p4_auto, "p4_commit": p4_commit}

_RECORDS = r"""
WITH t AS (SELECT regexp_replace(content, '^[\s\x{FEFF}]+|\s+$', '', 'g') AS b FROM result_file WHERE content IS NOT NULL),
v AS (
  SELECT unnest(CASE
    WHEN json_valid(b) AND json_type(b) = 'ARRAY' THEN json_extract(b, '$[*]')
    WHEN json_valid(b) THEN [b::JSON]
    ELSE list_transform(list_filter(regexp_split_to_array(b, '[\r\n]+'), lambda x: json_valid(x)), lambda x: x::JSON)
  END) AS j FROM t WHERE b <> ''),
r AS (
  SELECT DISTINCT json_extract_string(j, '$.result.run') AS run_id,
    nullif(regexp_extract(json_extract_string(j, '$.result.image'), '(?:^|/)\s*([0-9]{9})(?:\.[A-Za-z0-9]+)?\s*$', 1), '') AS image,
    json_extract_string(j, '$.result.option') AS option,
    json_extract_string(j, '$.result.failure') AS failure
  FROM v WHERE json_type(j, '$.result') = 'OBJECT')
"""

ORACLE = {
    # of the copies of a record the one modified last, and of these the greatest; the sums of failures and changes do not depend on which
    "p4_auto": _RECORDS.replace("SELECT DISTINCT json_extract_string(j, '$.result.run')", "SELECT DISTINCT seen, j::VARCHAR AS whole, try_cast(json_extract_string(j, '$.auto.changed_pixels') AS BIGINT) AS changed, json_extract_string(j, '$.result.run')")
    .replace("AS b FROM result_file", "AS b, modified_at AS seen FROM result_file").replace("END) AS j FROM t", "END) AS j, seen FROM t")
    + """, last AS (SELECT image, arg_max(failure, (seen, whole)) AS failure, arg_max(changed, (seen, whole)) AS changed, max_by((failure IS NULL)::INT, (seen, whole)) AS ok
      FROM r WHERE option = 'auto' AND image IS NOT NULL AND run_id IS NOT NULL GROUP BY run_id, image, option)
      SELECT image, count(*) AS records, count(*) FILTER (ok = 0) AS failures, sum(CASE WHEN ok = 1 THEN changed END)::BIGINT AS changed_pixels FROM last GROUP BY image""",
    "p4_found": _RECORDS + "SELECT DISTINCT run_id, image, option FROM r WHERE run_id IS NOT NULL AND image IS NOT NULL AND option IS NOT NULL",
}
