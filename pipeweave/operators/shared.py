"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: list[str] = []


def folder(spark) -> str:
    """``spark.checkpoint.dir``, which a cluster must name; a temporary folder only where all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own.append(tempfile.mkdtemp(prefix="pipeweave-"))
        atexit.register(shutil.rmtree, _own[-1], True)
        path = "file://" + _own[-1]
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def table(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read again: the lineage ends here."""
    path = f"{folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
