"""Reads and writes of operation-log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import scans


def appended(log: DataFrame, more: DataFrame, op: str) -> DataFrame:
    """log and those ops of more that it lacks, each op once; of several of one id the greatest by the other columns, in order."""
    rest = [c for c in more.columns if c != op]
    fresh = more.join(log.select(op), op, "left_anti").groupBy(op).agg(F.max(F.struct(*rest)).alias("_r"))
    return log.unionByName(fresh.select(op, *[F.col(f"_r.`{c}`") for c in rest]))


def objects(log: DataFrame, object: str) -> DataFrame:
    return log.select(object).distinct()


def patch_runs(log: DataFrame, object: str, op: str, value: str, ranges: int | None = None) -> DataFrame:
    """Runs of consecutive ops, by op id, of one object: (first_op, last_op, object, n_ops, total).

    The order is global: ranges of ids are scanned where they lie, and a row
    a range tells the next whether its first op goes on with the run before.
    ranges: how many, if not as many as Spark shuffles to.
    """
    x = log.select(F.lit(0).alias("all"), F.col(object).alias("object"), F.col(op).alias("op"), F.col(value).alias("value"))
    x = scans.scanned(x, ["all"], ["op"], before={"last": F.col("object")}, ranges=ranges)
    x = scans.scanned(x, ["all"], ["op"], lasts={"first_op": F.when(~F.col("object").eqNullSafe(F.col("last")), F.col("op"))}, ranges=ranges)
    return x.groupBy("first_op").agg(F.max("op").alias("last_op"), F.max("object").alias("object"), F.count("*").alias("n_ops"), F.sum("value").alias("total"))


def dumped(log: DataFrame, order: list[str]) -> DataFrame:
    """log with line, the place of each op in the order of a dump of the whole store; rows lie in that order over the partitions."""
    return scans.numbered(log.withColumn("_all", F.lit(0)), ["_all"], order, "line").drop("_all").repartitionByRange("line").sortWithinPartitions("line")
