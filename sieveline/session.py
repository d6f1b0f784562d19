"""Session settings and the shared folder that holds written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for local work; on a cluster the caller's own session is used instead."""
    builder = (
        SparkSession.builder.master(master)
        .appName("sieveline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master may go without the setting; it then gets a folder of its own. On a cluster a
    missing setting is an error, since a machine's own folder is lost with the machine.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        folder = getattr(shared_folder, "own", None)
        if folder is None or not os.path.isdir(folder):
            folder = shared_folder.own = tempfile.mkdtemp(prefix="sieveline-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/sieveline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks after the written table. The table
    is written once, where an eager checkpoint computes its last stage twice.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


#: Paths of the written tables that are still there, by application.
_WRITTEN: dict[str, list[str]] = {}


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more; anything but a `materialize`d table is left alone."""
    for df in tables:
        path = getattr(df, "_written_path", None)
        if path:
            left = _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [])
            if path in left:
                left.remove(path)
            drop_path(df.sparkSession, path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Delete all tables written inside the block at its end: results must have been read or saved by then."""
    left = _WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = set(left)
    try:
        yield
    finally:
        for path in [p for p in left if p not in before]:
            drop_path(spark, path)
            left.remove(path)


def input_partitions(df: DataFrame) -> int:
    """Shuffle width of the session: what explicit repartitions use, so that one setting sizes all."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename a path; an existing target is an error, so that nothing is overwritten."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b):
        raise FileExistsError(target)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"could not rename {source} to {target}")
