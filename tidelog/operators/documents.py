"""Versioned documents in a shared folder: append-only, merged on reading, compacted in place.

A version is a set of log rows with the columns document and version. Rows
that are saved together carry a mark that no other saving has, and a version
is dropped by a row in a second table that names the marks which were seen,
so nothing is rewritten, what arrives meanwhile stays even under the same
number, and a job that dies half-way leaves documents readable: the new
version is saved first, the old ones are dropped after, and merging both is
harmless.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.shared import shared_dir

KEY = ["document", "version"]
MARK = "_saved"


def save(versions: DataFrame, path: str) -> str:
    """Append versions; the first one makes the store. Returns the mark of what was saved."""
    mark = uuid.uuid4().hex
    versions.withColumn(MARK, F.lit(mark)).write.mode("append").parquet(f"{path}/versions")
    return mark


def drop(pairs: DataFrame, path: str) -> None:
    """Take versions (document, version) out as they are now; unknown and repeated ones do no harm."""
    _drop(_marked(pairs.sparkSession, path).join(pairs.select(*KEY), KEY, "left_semi"), path)


def _drop(seen: DataFrame, path: str) -> None:
    seen.select(*KEY, MARK).distinct().write.mode("append").parquet(f"{path}/dropped")


def _marked(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/versions")
    names = rows.select(*KEY, MARK).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dropped")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return rows
    return rows.join(spark.read.schema(names).parquet(f"{path}/dropped"), [*KEY, MARK], "left_anti")


def live(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the versions that are not dropped."""
    return _marked(spark, path).drop(MARK)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(document, versions, last) of each document."""
    return live(spark, path).groupBy("document").agg(F.count_distinct("version").alias("versions"), F.max("version").alias("last"))


def loaded(spark: SparkSession, path: str, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every document as the merge of its versions; reduce keeps the column document."""
    return reduce(live(spark, path).drop("version"))


def compact(spark: SparkSession, path: str, reduce: Callable[[DataFrame], DataFrame]) -> None:
    """Write each document of several versions as one, numbered after the last that was seen, and drop those; documents of one version are left alone."""
    shared_dir(spark)  # checkpoints need one
    rows = _marked(spark, path)
    many = rows.groupBy("document").agg(F.count_distinct(F.struct("version", MARK)).alias("_n"), F.max("version").alias("_last")).where("_n > 1").drop("_n")
    # what is dropped is what was read here, not what arrives meanwhile
    old = rows.select(*KEY, MARK).distinct().join(many, "document").checkpoint()
    last = old.select("document", "_last").distinct()
    merged = reduce(rows.join(old, [*KEY, MARK], "left_semi").drop("version", MARK)).join(last, "document").withColumn("version", F.col("_last") + 1)
    save(merged.select(*[c for c in rows.columns if c != MARK]), path)
    _drop(old, path)


def rename(spark: SparkSession, path: str, before: int, after: int) -> None:
    """Give a document another id, with what is saved meanwhile; ValueError, and all as before, if that is taken, be it meanwhile."""
    shared_dir(spark)
    kind = spark.read.parquet(f"{path}/versions").schema["document"].dataType
    mine: list[str] = []

    def taken() -> bool:
        return not _marked(spark, path).where((F.col("document") == after) & ~F.col(MARK).isin(mine)).isEmpty()

    while True:
        if taken():
            _drop(_marked(spark, path).where((F.col("document") == after) & F.col(MARK).isin(mine)), path)
            raise ValueError(f"document {after} exists")
        moved = _marked(spark, path).where((F.col("document") == before) & ~F.col(MARK).isin(mine)).checkpoint()
        if moved.isEmpty():
            break
        mine.append(save(moved.drop(MARK).withColumn("document", F.lit(after).cast(kind)), path))
        if taken():
            continue
        _drop(moved, path)
