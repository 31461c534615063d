"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that become Python values at a time.
FEW = 64


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of FEW rows: where a row is a whole object, what is made of it in Python takes many times its own bytes."""
    for b in batches:
        for i in range(0, b.num_rows, FEW):
            yield b.slice(i, FEW)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver happens to collect its garbage; a stage that needs lost ones again makes them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(x: DataFrame) -> DataFrame:
    """x written to the shared folder and read again.

    For rounds of a loop: a checkpoint carries over what its plan knows of its
    columns, and of joins with itself that doubles and more with each round,
    until planning takes longer than all jobs. A table carries nothing.
    """
    path = f"{shared_dir(x.sparkSession)}/kept-{uuid.uuid4().hex}"
    with shuffles_dropped(x.sparkSession):
        x.write.option("compression", "zstd").parquet(path)
    return x.sparkSession.read.schema(x.schema).parquet(path)
