"""Shared folders, materialised intermediates and text kernels."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space: U+0020 and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
#: Rows that one Arrow batch may hold; documents can be long, so batches stay small.
BATCH_ROWS = 1000

_own_dirs: list[str] = []


def _drop_own_dirs() -> None:
    for path in _own_dirs:
        shutil.rmtree(path, ignore_errors=True)


def _only_one_machine(spark: SparkSession) -> None:
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A cluster must name one. Only where driver and executors are one process
    (tests) a temporary folder of it is set instead.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        _only_one_machine(spark)
        path = "file://" + tempfile.mkdtemp(prefix="pipeweave-")
        _own_dirs.append(path[len("file://"):])
        if len(_own_dirs) == 1:
            atexit.register(_drop_own_dirs)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it again; ``options`` are the writer's.

    The written table cuts the lineage: a lost executor costs no more than the
    tasks that were running on it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    schema = df.schema
    df.write.options(**options).parquet(path)
    free_shuffles(spark)
    return spark.read.schema(schema).parquet(path), path


def table(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this module that no later step reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files of finished jobs."""
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(0))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def worker_memory(key, make):
    """What ``make`` returned in this Python worker; it outlives a task.

    Only for what depends on ``key`` alone, so that a lost worker loses time and nothing else.
    """
    import sys
    import types

    home = sys.modules.setdefault("_pipeweave_worker", types.ModuleType("_pipeweave_worker"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]
