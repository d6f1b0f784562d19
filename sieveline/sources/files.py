"""Sources and sinks for records, images, arrays, predictions, test reports and fingerprints."""

from __future__ import annotations

import secrets
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieveline.operators.image_jobs import decode

#: Records of experiments, declared rather than inferred.
SAMPLE = (
    "image string, option string, rate string, strategy string, gross_bits bigint, stored_bytes bigint, message_bytes bigint, changed_pixels bigint, "
    "distortion bigint, psnr double, seconds double, balance_flips bigint, balance_objective_before double, balance_objective_after double, "
    "verified_round_trips int, job_seconds double, failure string"
)
PREDICTION = "variant string, detector string, part string, image_id string, label int, score double"


def read_images(spark: SparkSession, path: str, kind: str = "pgm", any_size: bool = False, expected: int | None = None) -> DataFrame:
    """Decoded images of a folder, in the order of their numbers: image_id, width, height, pixels, fault.

    Files whose stem is no number come last, by name. Another number of files than expected, where that is given, is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path)
    if expected is not None:
        require_count(files.select("path"), expected)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    rows = decode(files.select(stem.alias("image_id"), "content"), "content", kind, any_size)
    return rows.orderBy(F.col("image_id").try_cast("bigint").asc_nulls_last(), "image_id")


def require_count(df: DataFrame, n: int) -> DataFrame:
    """df, after making sure that it has exactly n rows."""
    if (got := df.count()) != n:
        raise ValueError(f"expected {n} rows, found {got}")
    return df


def read_json(spark: SparkSession, path: str, schema: str | StructType, lines: bool = True) -> DataFrame:
    """JSON records with a declared schema: one object per line, or whole files. Damaged records are an error."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("mode", "FAILFAST").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append one object per line; readers see a finished append or none of it."""
    df.write.mode("append").json(path)


def create_json(df: DataFrame, path: str) -> None:
    """Write one object per line to a path that must not exist."""
    df.write.mode("errorifexists").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """Predictions by variant and part, so that readers of one prune the others."""
    df.write.mode("append").partitionBy("variant", "part").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).parquet(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Rows with array columns; an existing path is an error."""
    df.write.mode("errorifexists").parquet(path)


def junit_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all test suites of JUnit reports: tests, failures, errors, skipped; zeros without any."""
    names = ("tests", "failures", "errors", "skipped")
    schema = ", ".join(f"_{n} bigint" for n in names)
    rows = spark.read.format("xml").option("rowTag", "testsuite").schema(schema).load(path)
    return rows.agg(*[F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(n) for n in names])


def fingerprint(spark: SparkSession, path: str, patterns: Sequence[str] = ("*",)) -> DataFrame:
    """SHA-256 and size of every file below a path: rows (file, bytes, sha256)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def environment(spark: SparkSession) -> DataFrame:
    """One row of the versions in use, with all installed packages as name==version."""
    import platform
    from importlib import metadata

    packages = sorted({f"{d.metadata['Name']}=={d.version}" for d in metadata.distributions() if d.metadata["Name"]})
    return spark.createDataFrame([(platform.python_version(), spark.version, packages)], "python string, spark string, packages array<string>")


def new_key() -> bytes:
    """A key of 32 random bytes of the operating system; never a column."""
    return secrets.token_bytes(32)
