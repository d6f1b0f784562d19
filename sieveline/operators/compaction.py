"""Problem 4: many tiny result files become a few well-sized ones.

The records are read out of the files' texts with JVM-side JSON functions, made unique, spread with the
REBALANCE hint so that adaptive execution sizes the output partitions from runtime statistics, written to
a staging folder, and only moved to their place when the multiset checksum of what was written equals
that of what came in.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.ids import loose_id
from sieveline.session import drop_path, materialize, new_path, release, rename_path

#: Size the output files should come near to, as shuffled bytes.
TARGET_BYTES = 128 * 1024 * 1024


def _parsed(text: Column) -> Column:
    """JSON [value, 0] of a text that is one value; see _whole for what else may come out."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]")))


def _whole(parsed: Column) -> Column:
    """Whether the text was exactly one complete JSON value.

    The parser stops after the first value, so a text with a bracket too many would pass; the 0 behind
    the value tells, in one parse: it is only found where the array closed behind it.
    """
    return F.try_variant_get(parsed, "$[1]", "int") == 0


def read_records(files: DataFrame, content: str = "content", modified: str = "modified_at") -> DataFrame:
    """One row for each complete record in the files' texts.

    A text is one JSON value (an object or a list of objects) or one object per line; lines that are not
    complete JSON hold no record, nor do null, empty and unfinished texts. A value with neither run, image
    nor option in its `result` is no record; one that lacks some of them is kept with that column null.
    Columns of `files` other than the two named ones are not read.
    """
    trim = lambda c: F.regexp_replace(c, "^[\\s\\x{FEFF}]+|\\s+$", "")
    first = lambda p: F.try_variant_get(p, "$[0]", "variant")
    texts = files.select(trim(F.col(content)).alias("body"), F.col(modified).alias("modified_at")).filter("body <> ''")
    texts = texts.withColumn("p", _parsed(F.col("body")))
    # a text that is no single value is read line by line; the branches are only computed where they apply
    lines = F.transform(F.filter(F.transform(F.split("body", "[\\r\\n]+"), lambda x: _parsed(trim(x))), _whole), first)
    values = (
        F.when(_whole(F.col("p")) & F.col("body").startswith("["), F.try_variant_get("p", "$[0]", "array<variant>"))
        .when(_whole(F.col("p")), F.array(first(F.col("p"))))
        .otherwise(lines)
    )
    rows = texts.select(F.explode(values).alias("r"), "modified_at")
    get = lambda path, kind="string": F.try_variant_get("r", f"$.{path}", kind)
    return rows.select(
        get("result.run").alias("run_id"),
        loose_id(get("result.image")).alias("image"),
        get("result.option").alias("option"),
        get("result.changed_pixels", "bigint").alias("changed_pixels"),
        get("result.seconds", "double").alias("seconds"),
        get("result.failure").alias("failure"),
        get("auto.changed_pixels", "bigint").alias("auto_changed_pixels"),
        get("auto.rate").alias("auto_rate"),
        get("auto.stored_bytes", "bigint").alias("auto_stored_bytes"),
        F.to_json("r").alias("record"),
        "modified_at",
    ).filter("run_id is not null or image is not null or option is not null")


def unique_records(records: DataFrame) -> DataFrame:
    """Each record once: of the copies with one (run, image, option) the one modified last.

    Ties go to the greatest text. Records that lack one of the three are told apart by their whole text, so
    none of them is lost. The copies of one record are combined before the shuffle.
    """
    key = F.when(F.expr("run_id is null or image is null or option is null"), F.col("record"))
    value = [c for c in records.columns if c not in ("run_id", "image", "option")]
    order = F.struct("modified_at", "record", *[c for c in value if c not in ("modified_at", "record")])
    return (
        records.withColumn("_other", key)
        .groupBy("run_id", "image", "option", "_other")
        .agg(F.max(order).alias("_last"))
        .select("run_id", "image", "option", *[F.col("_last")[c].alias(c) for c in value])
    )


def _checksum(df: DataFrame) -> list[Column]:
    """Order-free checksum of a multiset of rows: their number and the sum and xor of their hashes."""
    h = F.xxhash64(*df.columns)
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"),
        F.coalesce(F.bit_xor(h), F.lit(0).cast("bigint")).alias("mixed"),
    ]


@dataclass(frozen=True)
class Commit:
    """What a compaction wrote: where, how many rows, files, and the checksum both sides agree on."""

    path: str
    rows: int
    files: int
    total: Decimal
    mixed: int


def compact(records: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> Commit:
    """Write records into few well-sized Parquet files at path, whole or not at all.

    The records are computed once, into a table of the shared folder in which a retried task leaves one output, and its
    checksum is what came in. The table is read back, spread with the REBALANCE hint and written to a staging
    folder. Should the checksum of the written files differ, the staging folder is dropped and an error raised. An existing
    path is an error. An empty input gives an empty table. The target size is set in a session of its own, so concurrent
    jobs do not see it.
    """
    spark = records.sparkSession
    staging, own = new_path(spark, "staging"), spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    table = materialize(records, "records")
    incoming = own.read.schema(records.schema).parquet(table._written_path)
    incoming.hint("rebalance").write.parquet(staging)
    want = incoming.agg(*_checksum(incoming)).head()
    written = own.read.schema(records.schema).parquet(staging)
    got = written.select("*", F.col("_metadata.file_path").alias("_file")).agg(*_checksum(written), F.count_distinct("_file").alias("files")).head()
    release(table)
    if any(want[k] != got[k] for k in ("n", "total", "mixed")):
        drop_path(spark, staging)
        raise ValueError(f"checksums differ: {want} came in, {got} was written")
    rename_path(spark, staging, path)
    return Commit(path, got["n"], got["files"], got["total"], got["mixed"])


def compact_files(files: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, Commit]:
    """Compact the listing of result files: every readable record exactly once, in few files at path."""
    spark = files.sparkSession
    records = unique_records(read_records(files))
    done = compact(records, path or new_path(spark, "compacted"), target_bytes)
    return spark.read.schema(records.schema).parquet(done.path), done
