"""Intermediate tables in the folder that all executors share.

A job uses its pixels several times a step (for statistics and for the step itself), so without
tables in between, the work of earlier steps would double with every step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """Where intermediate tables go: spark.checkpoint.dir, else the folder given to setCheckpointDir.

    Without either, local sessions (tests) use a folder of this machine; on a cluster every executor would
    write to a disk of its own and results would lack rows, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.gettempdir()}/checkpoints"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it was running, and later
    stages read compressed columns instead of computing them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/frameloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete a table made by stored() that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tables_dropped_after() -> Iterator[None]:
    """Delete, at the end of the block, every table stored within it.

    Results are lazy and read some of these tables, so write or collect them inside the block.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            dropped(df)
