"""Live replication: late data is always accepted, so a stream's result is its batch's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.shared import shared_dir
from tidelog.streaming import states


def source(spark: SparkSession, folder: str, name: str, schema, files: int = 1) -> DataFrame:
    """The files of a table as a stream, files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet*")


def drained(stream: DataFrame, step) -> None:
    """Run every micro-batch that is there through step(batch, number)."""
    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()


def reduced(stream: DataFrame, reduce) -> DataFrame:
    """A reduced state kept up in runs of growing size, each batch adding its own; states.kept_up is the form with a place of one's own to go on from."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    state = states.State(spark, f"{base}/state", reduce, reduce(spark.createDataFrame([], stream.schema)).schema)
    states.kept_up(stream, state, f"{base}/place")
    return state.read()


def appended(stream: DataFrame, op: str, base: str | None = None) -> DataFrame:
    """An op log kept up by inserting only ops that it lacks; a batch that runs again replaces itself.

    Of several of one id in a batch the greatest by the other columns stays,
    as in a table. Earlier batches are read in the range of the batch's ids:
    where ids grow with time, statistics of their files leave most out.
    base: the log's folder, to go on from after a restart.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rest = [c for c in stream.columns if c != op]

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.groupBy(op).agg(F.max(F.struct(*rest)).alias("_r")).select(*[F.col(op) if c == op else F.col(f"_r.`{c}`") for c in stream.columns])
        if number:
            ends = batch.agg(F.min(op).alias("a"), F.max(op).alias("z")).first()
            seen = batch.sparkSession.read.schema(stream.schema).parquet(*[f"{base}/batch/{k}" for k in range(number)]).select(op).where(F.col(op).between(F.lit(ends["a"]), F.lit(ends["z"])))
            fresh = fresh.join(seen, op, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{base}/batch/{number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/place").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/batch")


def messages(patches: DataFrame, object: str, log: str) -> DataFrame:
    """Patches as messages to peers, JSON objects of Type, object and log."""
    return patches.select(F.to_json(F.struct(F.lit("NetPatch").alias("Type"), F.col(object).cast("string").alias("object"), F.col(log).alias("log"))).alias("value"))


def received(texts: DataFrame, value: str = "value") -> DataFrame:
    """(object, log) of well-formed patch messages; others are dropped."""
    m = F.from_json(value, "Type string, object string, log string")
    return texts.select(m.alias("m")).where("m.Type = 'NetPatch'").select("m.object", "m.log")
